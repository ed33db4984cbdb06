"""Governance, compilation, invariants of the metric layer and of the relations."""

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom import entry
from ledgerloom.functions.scalars import chi2_tail, month_index, month_label, month_label_rounded
from ledgerloom.operators import regression
from ledgerloom.plans import warehouse as w
from ledgerloom.plans.metrics import STANDARD, Dimension, Metric, standard, without_pharmacy
from ledgerloom.sources import payer

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def base(spark):
    return w.member_month(payer.Payer(spark, SF)).cache()


@pytest.fixture(scope="module")
def con():
    with duckdb.connect() as c:
        for t in TABLES.split():
            c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        yield c


def test_undeclared_and_repeated_names_are_refused(base):
    with pytest.raises(ValueError, match="unknown metric"):
        STANDARD.compile(base, "profit")
    with pytest.raises(ValueError, match="unknown dimension"):
        STANDARD.compile(base, "pmpm", ["zip"])
    registry = standard()
    with pytest.raises(ValueError, match="already defined"):
        registry.add_metric(STANDARD.get("pmpm"))
    with pytest.raises(ValueError, match="already defined"):
        registry.add_dimension(Dimension("plan", lambda: F.col("plan")))


@pytest.mark.parametrize("metric", sorted(STANDARD.metrics))
def test_every_metric_is_one_row_and_a_ratio_of_its_parts(base, metric):
    (row,) = STANDARD.compile(base, metric).collect()
    assert row.value == (row.numerator if STANDARD.get(metric).denominator is None else row.numerator / row.denominator)


@pytest.mark.parametrize("dim", ["plan", "region", "product"])
def test_slices_reconcile(base, dim):
    total = STANDARD.compile(base, "paid_amount").first().value
    assert abs(sum(r.value for r in STANDARD.compile(base, "paid_amount", [dim]).collect()) - total) < 0.01


def test_zero_denominator_filters_and_two_dimensions(base, spark):
    assert STANDARD.compile(base.filter("total_lines = 0"), "denial_rate").first().value is None
    assert STANDARD.compile(base, "pmpm", ["plan", "region"]).columns[:2] == ["plan", "region"]
    registry = standard()
    registry.add_metric(Metric("gold_months", "x", lambda: F.count("*").cast("double"), filters=(lambda: F.col("plan") == "BUILDING",)))
    assert registry.compile(base, "gold_months").first().value == base.filter("plan = 'BUILDING'").count()
    assert STANDARD.compile(base, "member_months", where=[F.col("plan") == "BUILDING"]).first().value == base.filter("plan = 'BUILDING'").count()


def test_relation_invariants(base, spark):
    assert w.fanout(base, payer.Payer(spark, SF).enrollment_spans).first().equal
    assert base.filter("denied_lines > total_lines").isEmpty() and not base.filter("total_lines = 0").isEmpty()
    assert w.grain_violations(base, ["member_id", "month_index"]).first().violations == 0
    assert all(r.passed for r in w.invariants(base, STANDARD).collect())


def test_exposure_equals_the_range_join(spark):
    rows = [("a", 0, 3), ("b", 2, 2), ("c", 5, 6), ("d", 3, 1)]
    spans = spark.createDataFrame(rows, "member_id string, start_month int, end_month int")
    assert sorted(map(tuple, w.exposure(spans).collect())) == sorted((m, i) for m, a, b in rows for i in range(a, b))


def test_month_labels(spark):
    rows = spark.range(24).select("id", month_label("id").alias("l"), month_label_rounded("id").alias("r")).collect()
    assert [r.l for r in rows][:13:6] == ["2024-01", "2024-07", "2025-01"] and rows[11].l == "2024-12"
    assert sum(r.l != r.r for r in rows[:23]) == 10
    back = spark.range(400).select("id", month_index(month_label("id")).alias("i")).filter("id <> i")
    assert back.isEmpty()


def test_chi2_tail_falls(spark):
    tails = [r.p for r in spark.range(1200).orderBy("id").select(chi2_tail(F.col("id") / 20.0).alias("p")).collect()]
    assert tails[0] == 1 and all(0 <= b < a for a, b in zip(tails, tails[1:]))


def test_blast_radius_moves_the_loss_ratio_alone(base, spark):
    whole = w.with_pharmacy(base, payer.Payer(spark, SF).claim_lines).cache()
    moves = regression.blast_radius(whole, STANDARD, without_pharmacy(STANDARD))
    assert {r.metric.split("|")[0] for r in moves.filter("moved").collect()} == {"loss_ratio"}
    assert moves.filter("material and not moved").isEmpty()
    assert regression.golden_status(None, regression.snapshot(base, STANDARD))[0] == "created"
    snap = regression.snapshot(base, STANDARD).cache()
    assert regression.golden_status(snap, snap)[0] == "clean"


def test_diff_treats_missing_figures_as_moved(spark):
    schema = "metric string, slice string, value double"
    a = spark.createDataFrame([("m", "x", 1.0), ("m", "gone", 2.0), ("m", "null", None), ("m", "tiny", 100.0), ("m", "zero", 0.0)], schema)
    b = spark.createDataFrame([("m", "x", 1.0), ("m", "new", 2.0), ("m", "null", 3.0), ("m", "tiny", 100.001), ("m", "zero", 1.0)], schema)
    got = {r.slice: (r.moved, r.material) for r in regression.diff(a, b).collect()}
    assert got == {"x": (False, False), "gone": (True, True), "new": (True, True), "null": (True, True), "tiny": (True, False), "zero": (True, True)}


def test_csv_json_and_table_round_trips(spark, tmp_path):
    p = payer.Payer(spark, SF)
    payer.write_csv(p.enrollment_spans, str(tmp_path), "enrollment_spans")
    back = payer.read_csv(spark, str(tmp_path), "enrollment_spans")
    assert back.schema == payer.SCHEMAS["enrollment_spans"] and sorted(map(str, back.collect())) == sorted(map(str, p.enrollment_spans.select(back.columns).collect()))
    payer.write_report({"a": float("nan"), "b": [1, float("inf")]}, f"{tmp_path}/r.json")
    assert payer.read_report(f"{tmp_path}/r.json") == {"a": None, "b": [1, None]} and payer.read_report(f"{tmp_path}/none.json") is None
    name = f"t_{tmp_path.name}".replace("-", "_")
    assert payer.replace_table(p.providers, name).count() == p.providers.count()
    spark.sql(f"drop table {name}")


SMALL = sorted(set(entry.ORACLE_SQL) - {f"m_{m}_{d}" for m in STANDARD.metrics for d in ("month", "product", "channel", "age_band")})


@pytest.mark.parametrize("name", SMALL)
def test_same_rows_as_sql(spark, con, name):
    got, want = entry.QUERIES[name](spark, SF).toPandas(), con.execute(entry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        return sorted(tuple("~" if pd.isna(v) else f"{float(v):.8g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))

    assert rows(got) == rows(want)
    spark.catalog.clearCache()
