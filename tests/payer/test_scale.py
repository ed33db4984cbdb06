"""Orders, fits and checks that take no global window and no driver: against plain numpy and plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import chi2_tail, erfc
from ledgerloom.operators import forecast, mutants, order, quality, regression, risk, survival
from ledgerloom.plans import warehouse as w
from ledgerloom.plans.metrics import STANDARD, Metric, without_pharmacy
from ledgerloom.plans.tables import Relations
from ledgerloom.sources.payer import Payer

SF = "/root/testdata/sf0.001"


def values(spark, n=500, seed=3):
    r = np.random.default_rng(seed)
    v = np.where(r.random(n) < 0.4, 0.0, r.integers(0, 60, n) / 4.0)
    return [(f"k{i:04d}", float(x)) for i, x in enumerate(v)], "key string, v double"


@pytest.mark.parametrize("common", [1, 4, 1024])
def test_positions_and_tied_ranks(spark, monkeypatch, common):
    monkeypatch.setattr(order, "COMMON", common)
    rows, schema = values(spark)
    df = spark.createDataFrame(rows, schema).repartition(7)
    want = {k: i + 1 for i, (v, k) in enumerate(sorted((v, k) for k, v in rows))}
    assert {r.key: r.position for r in order.positioned(df, "v", "key").collect()} == want
    v = np.array([x for _, x in rows])
    tied = {k: (v < x).sum() + ((v == x).sum() + 1) / 2 for k, x in rows}
    got = order.average_ranked(df, "v", "key", len(rows), "rank")
    assert sorted(got.columns) == ["key", "rank", "v"] and {r.key: r["rank"] for r in got.collect()} == tied


@pytest.mark.parametrize("n,parts", [(0, 3), (2, 5), (10, 10), (57, 10), (100, 7)])
def test_equal_parts(spark, n, parts):
    got = [r.p for r in spark.range(1, n + 1).select(order.equal_part(F.col("id"), n, parts).alias("p"), "id").orderBy("id").collect()]
    assert got == [i + 1 for i in range(parts) for _ in range(n // parts + (i < n % parts))]


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_ranges(spark, descending):
    r = np.random.default_rng(2)
    t, x = r.permutation(300), r.integers(-5, 9, 300)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, x)], "t int, x double")
    cuts = order.bounds(df, "t", 16)
    assert 8 <= len(cuts) <= 15
    got = {i.t: i.x for i in order.running(df.withColumn("part", order.range_of("t", cuts)), "part", "t", ["x"], descending).collect()}
    assert got == {int(a): float(x[(t >= a) if descending else (t <= a)].sum()) for a in t}
    assert order.bounds(df.limit(0), "t") == [] and df.limit(1).select(order.range_of("t", [])).first()[0] == 0


def test_error_function_and_tail(spark):
    xs = [-3.0, -0.5, 0.0, 1e-6, 0.1, 0.7, 1.5, 1.99999, 2.0, 2.5, 4.0, 7.0, 20.0, None]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("e"), chi2_tail("x").alias("p")).collect()
    for r in got:
        if r.x is None:
            assert r.e is None and r.p is None
        else:
            assert abs(r.e - math.erfc(r.x)) <= 1e-13 * max(math.erfc(r.x), 1e-3 if r.x < 2 else 0.0) * 10
            assert abs(r.p - math.erfc(math.sqrt(max(r.x, 0.0) / 2))) < 1e-13


def plain_cox(t, e, x, beta):
    value, gradient = 0.0, np.zeros(len(beta))
    for a, d, row in zip(t, e, x):
        if d:
            risk_ = np.exp(x[t >= a] @ beta)
            value += row @ beta - np.log(risk_.sum())
            gradient += row - (risk_ @ x[t >= a]) / risk_.sum()
    return value, gradient


def test_cox_sums_over_continuous_times(spark):
    r = np.random.default_rng(5)
    t, e, x = np.round(r.exponential(10, 240), 3), r.random(240) < 0.6, r.normal(size=(240, 2))
    df = spark.createDataFrame([(float(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x)], "t double, e int, x double, z double")
    sets = survival.RiskSets.of(df, ["x", "z"], "t", "e", parts=9)
    beta = np.array([0.4, -0.2])
    value, gradient, information = sets.likelihood(beta)
    want = plain_cox(t, e, x, beta)
    # Centring the covariates moves the value by nothing.
    assert abs(value - want[0]) < 1e-8 and np.allclose(gradient, want[1], atol=1e-8)
    near = [sets.likelihood(beta + h)[1] for h in (np.array([1e-5, 0]), np.array([0, 1e-5]))]
    assert np.allclose([(gradient - g) / 1e-5 for g in near], information, rtol=1e-3)
    fit = survival.cox(df, ["x", "z"], "t", "e")
    assert np.abs(plain_cox(t, e, x, np.array(fit["beta"]))[1]).max() < 1e-6


def test_logistic_slope_is_flat_at_the_fit(spark):
    r = np.random.default_rng(9)
    x, z = r.normal(size=600), r.normal(size=600)
    y = r.random(600) < 1 / (1 + np.exp(-(0.8 * x - 0.5 * z - 0.3)))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, z, y)], "x double, z double, y int")
    fit = survival.logistic(df, "y", ["x", "z"])
    assert all(abs(g.gradient) < 0.2 for g in survival.logistic_slope(df, "y", fit).collect())
    at = {g.covariate: g for g in survival.logistic_slope(df, "y", {"x": 900.0, "intercept": 0.0}).collect()}
    p = 1 / (1 + np.exp(-np.clip(900.0 * x, -700, 700)))
    assert abs(at["x"].gradient - ((y - p) * x).sum()) < 1e-3 and np.isfinite(at["x"].log_likelihood)


def test_log_rank_of_all_pairs(spark):
    r = np.random.default_rng(6)
    rows = [(int(a), int(b), g) for g, n in (("a", 50), ("b", 70), ("c", 3)) for a, b in zip(r.integers(1, 30, n), r.integers(0, 2, n))] + [(4, 1, None)]
    df = spark.createDataFrame(rows, "tenure_months int, event_observed int, g string")
    got = {(x.first, x.second): x for x in survival.log_rank_pairs(df, "g").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), x in got.items():
        one = survival.log_rank(df, F.col("g") == a, F.col("g") == b, p=True).first()
        assert (x.observed, x.expected, x.chi2, x.p_value) == (one.observed, one.expected, one.chi2, one.p_value)


def test_ridge_from_moments(spark):
    r = np.random.default_rng(7)
    x = np.round(np.column_stack([r.normal(50, 10, 400), r.integers(0, 4, 400), r.gamma(2, 5000, 400)]), 2)
    y = np.round(3 * x[:, 0] - 200 * x[:, 1] + 0.5 * x[:, 2] + r.normal(0, 30, 400), 2)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    m = risk.moments(df, ["a", "b", "c"], "y")
    beta, intercept, se = m.ridge(2.0)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.linalg.solve(z.T @ z + 2.0 * np.eye(3), z.T @ (y - y.mean())) / x.std(axis=0)
    assert np.allclose(beta, want, rtol=1e-9) and abs(intercept - (y.mean() - want @ x.mean(axis=0))) < 1e-6
    assert np.allclose(m.only(["c", "a"]).ridge(0.0)[0], np.linalg.lstsq(np.column_stack([x[:, [2, 0]], np.ones(400)]), y, rcond=None)[0][:2], rtol=1e-8)
    plain = np.linalg.lstsq(np.column_stack([x, np.ones(400)]), y, rcond=None)
    sigma = plain[1][0] / (400 - 4)
    cov = sigma * np.linalg.inv(np.column_stack([x, np.ones(400)]).T @ np.column_stack([x, np.ones(400)]))
    assert np.allclose(m.ridge(0.0)[2], np.sqrt(np.diag(cov))[:3], rtol=1e-6)
    assert (risk.moments(df.repartition(9), ["a", "b", "c"], "y").products == m.products).all()
    assert risk.moments(df.limit(0), ["a"], "y").n == 0


def test_reconciliation_is_least_squares(spark):
    r = np.random.default_rng(8)
    regions, products = "NSEW", ("h", "p", "x")
    leaf = [f"{a}|{b}" for a in regions for b in products if (a, b) != ("W", "x")]
    series = [("total", "all"), *(("region", a) for a in regions), *(("product", b) for b in products), *(("leaf", x) for x in leaf)]
    inside = lambda level, label, x: level == "total" or level == "leaf" and label == x or level == "region" and x.split("|")[0] == label or level == "product" and x.split("|")[1] == label
    s = np.array([[float(inside(*k, x)) for x in leaf] for k in series])
    base, spread = r.uniform(50, 900, (len(series), 3)), r.uniform(0.0, 40, len(series))
    spread[3] = 0.0
    rows = [(*k, m, float(base[i, m]), 0.0) for i, k in enumerate(series) for m in range(3)]
    fc = spark.createDataFrame(rows, "level string, label string, month_index int, base double, actual double")
    spreads = spark.createDataFrame([(*k, float(v)) for k, v in zip(series, spread)], "level string, label string, spread double")
    got = {(x.method, x.level, x.label, x.month_index): x.value for x in forecast.reconciled(fc, spreads).collect()}
    for method, weight in (("ols", np.ones(len(s))), ("mint", 1 / np.maximum(spread, 1e-9))):
        root = np.sqrt(weight)[:, None]
        want = s @ np.linalg.lstsq(root * s, root * base, rcond=None)[0]
        for i, k in enumerate(series):
            assert np.allclose([got[method, *k, m] for m in range(3)], want[i], rtol=1e-6, atol=1e-6)
    assert len(got) == 2 * 3 * len(series)


def test_one_pass_figures_are_the_compiled_ones(spark):
    p = Payer(spark, SF)
    base = w.with_pharmacy(w.member_month(p), p.claim_facts).cache()
    got = {(r.metric, r.slice): (r.before, r.after) for r in regression.figures(base, {"before": STANDARD, "after": without_pharmacy(STANDARD)}).collect()}
    for name, by in regression.SPECS:
        for registry, side in ((STANDARD, 0), (without_pharmacy(STANDARD), 1)):
            for r in registry.compile(base, name, by).collect():
                key = "|".join((name, *by)), "|".join(str(r[d]) for d in by) if by else "ALL"
                assert (got[key][side] is None) == (r.value is None) and (r.value is None or abs(got[key][side] - r.value) < 1e-6)
    narrow = without_pharmacy(STANDARD)
    narrow.metrics["loss_ratio"] = Metric("loss_ratio", "claimed only", STANDARD.get("loss_ratio").numerator, STANDARD.get("loss_ratio").denominator, filters=(lambda: F.col("total_lines") > 0,))
    both = regression.blast_radius(base, STANDARD, narrow)
    assert both.count() == len(got) and both.filter("moved and metric = 'loss_ratio'").count() == 1 and both.filter("moved and metric not like 'loss_ratio%'").isEmpty()
    rows = regression.first_drift(both, 5).collect()
    assert len(rows) == 5 and [(r.metric, r.slice) for r in rows] == sorted((r.metric, r.slice) for r in rows)


def test_relations_by_name(spark):
    rel = w.relations(Payer(spark, SF))
    value = STANDARD.compile(rel, "loss_ratio").first().value
    assert value == STANDARD.compile(w.member_month(Payer(spark, SF)), "loss_ratio").first().value
    assert without_pharmacy(STANDARD).compile(rel, "loss_ratio").first().value < value
    assert rel.order("member_month_with_pharmacy")[-1] == "member_month_with_pharmacy" and rel.order("member_month_with_pharmacy").index("member_month") < 5
    names = rel.views(spark, "member_month", prefix="t_")
    assert names[-1] == "t_member_month" and spark.sql("select count(*) n from t_member_month").first().n == rel.get("member_month").count()
    with pytest.raises(ValueError, match="unknown relation"):
        rel.get("nothing")
    with pytest.raises(ValueError, match="already declared"):
        rel.declare("members", lambda: None)
    loop = Relations()
    loop.declare("a", lambda x: x, "b")
    loop.declare("b", lambda x: x, "a")
    with pytest.raises(ValueError, match="a -> b -> a"):
        loop.get("a")


def test_mutants_are_noticed(spark):
    rows = mutants.caught(w.member_month(Payer(spark, SF)), STANDARD).collect()
    by = {}
    for r in rows:
        by.setdefault(r.mutant, {})[r.check] = r.noticed
    assert set(by) == set(mutants.mutants(STANDARD)) and all(any(c.values()) for c in by.values())
    assert by["loss_ratio: largest for sum"]["regions reconcile to the total"] and not by["loss_ratio: inverted"]["regions reconcile to the total"]
    assert by["denial_rate: inverted"]["rate is no more than one"] and all(c["figure equals the golden one"] for c in by.values())


def test_sealed_trail_shows_every_break(spark):
    rows = [(i * 3, f"e{i}", float(i) / 4) for i in range(70)]
    trail = quality.sealed(spark.createDataFrame(rows, "id int, what string, v double").repartition(5), ["what", "v"], "id", segment=4).cache()
    assert {r.level: r["count"] for r in trail.groupBy("level").count().collect()} == {0: 70, 1: 18, 2: 5, 3: 2}
    assert quality.breaks(trail).isEmpty()
    first = trail.filter("level = 0 and seq = 2").first()
    before = trail.filter("level = 0 and seq = 1").first()
    assert first.prev_hash == before.hash == hashlib.sha256("\x1f".join(["1", "0\x1fe0\x1f0.0", quality.START]).encode()).hexdigest()
    found = lambda t: sorted((r.level, r.seq, r.kind) for r in quality.breaks(t).collect())
    here = lambda seq: (F.col("level") == 0) & (F.col("seq") == seq)
    assert found(trail.withColumn("content", F.when(here(6), "x").otherwise(F.col("content")))) == [(0, 6, "content")]
    assert found(trail.filter(~here(6))) == [(0, 7, "link")]
    assert found(trail.filter(~here(8))) == [(1, 2, "seal")]
    assert found(trail.filter(~((F.col("level") == 0) & F.col("seq").between(9, 12)))) == [(1, 3, "seal")]
    # A forger who mends the hash of the last entry of a segment is seen one level up.
    forged = F.sha2(F.concat_ws("\x1f", F.lit("8"), F.lit("x"), F.col("prev_hash")), 256)
    mended = trail.withColumns({"hash": F.when(here(8), forged).otherwise(F.col("hash")), "content": F.when(here(8), "x").otherwise(F.col("content"))})
    assert found(mended) == [(1, 2, "seal")]
    assert quality.sealed(spark.createDataFrame([], "id int, v string"), ["v"], "id").count() == 0


def test_fingerprints_of_all_kinds_of_columns(spark):
    schema = "i int, d double, f array<float>, t timestamp, s struct<a:int,b:string>, m map<string,int>, x binary, c decimal(10,2), b boolean"
    rows = [(i, None if i % 5 == 0 else i / 7, [i / 3, None] if i % 4 else None, None, (i, "é") if i % 3 else None, {"k": i, "j": 1}, bytes([i]), None, i % 2 == 0) for i in range(40)] + [(1, float("nan"), [], None, None, {}, b"", None, None), (1, float("inf"), [], None, None, {}, b"", None, None), (1, 1e300, [], None, None, {}, b"", None, None)]
    df = spark.createDataFrame(rows, schema)
    one = quality.fingerprint(df).first()
    assert one.n == 43 and len(one.digest) == 32 and quality.fingerprint(df.repartition(9)).first() == one
    assert quality.fingerprint(df.withColumn("d", F.when(F.col("i") == 9, 1.5).otherwise(F.col("d")))).first().digest != one.digest
    assert quality.fingerprint(df.union(df.limit(1))).first().digest != one.digest
    pairs = [quality.fingerprint(spark.createDataFrame([r], "a string, b string")).first().digest for r in (("1", "23"), ("12", "3"), (None, "N"), ("N", None), ("", None), (None, ""))]
    assert len(set(pairs)) == 6 and quality.fingerprint(df.limit(0)).first()[:] == (0, "0" * 32)


def test_manifest_reads_changed_files_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(100).withColumn("v", F.col("id") * 2).repartition(4).write.parquet(path)
    old = spark.createDataFrame(quality.manifest(spark.read.parquet(path)).collect(), quality.manifest(spark.read.parquet(path)).schema)
    assert quality.total(old).first() == quality.fingerprint(spark.read.parquet(path)).first()
    assert quality.refreshed(spark, path, old).count() == old.count() == 4
    spark.range(100, 120).withColumn("v", F.col("id") * 2).coalesce(1).write.mode("append").parquet(path)
    new = quality.refreshed(spark, path, old)
    assert new.count() == 5 and quality.total(new).first() == quality.fingerprint(spark.read.parquet(path)).first()
    # Lines of files that stand are taken as they are.
    faked = old.withColumn("n", F.lit(1000).cast("long"))
    assert quality.total(quality.refreshed(spark, path, faked)).first().n == 4020


def test_orphans(spark):
    lines, orders = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    assert tuple(quality.orphans({"x": (lines, orders, "k")}).first()) == ("x", 3, 1)
