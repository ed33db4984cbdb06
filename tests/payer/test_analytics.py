"""Estimators against closed forms and planted effects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import copilot, forecast, quality, risk, survival, upcoding
from ledgerloom.plans import warehouse as w
from ledgerloom.plans.metrics import STANDARD
from ledgerloom.sources import synthetic
from ledgerloom.streaming import claims as stream

SCHEMA = "tenure_months int, event_observed int"


def frame(spark, t, e):
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(t, e)], SCHEMA)


def plain_km(t, e):
    s, g, out = 1.0, 0.0, []
    for x in sorted(set(t)):
        d, n = sum((t == x) & (e == 1)), sum(t >= x)
        if d:
            s *= 1 - d / n
            g += d / (n * (n - d)) if n > d else 0.0
            out.append((x, d, n, round(s, 5), round(max(s - 1.96 * s * g**0.5, 0), 5)))
    return out


def test_kaplan_meier(spark):
    r = np.random.default_rng(7)
    t, e = r.integers(1, 40, 300), r.integers(0, 2, 300)
    got = [(x.time, x.events, x.at_risk, x.survival, x.ci_lower) for x in survival.kaplan_meier(frame(spark, t, e)).orderBy("time").collect()]
    want = plain_km(t, e)
    assert [g[:3] for g in got] == [v[:3] for v in want] and np.allclose([g[3:] for g in got], [v[3:] for v in want], atol=2e-5)
    assert all(a[3] >= b[3] for a, b in zip(got, got[1:])) and all(a[2] > b[2] for a, b in zip(got, got[1:]))


def test_no_events_all_events_and_median(spark):
    assert survival.kaplan_meier(frame(spark, range(1, 51), [0] * 50)).count() == 0
    ends = survival.kaplan_meier(frame(spark, range(1, 41), [1] * 40)).orderBy(F.desc("time")).first()
    assert ends.survival == 0.0
    curve = spark.createDataFrame([(1, 0.9), (2, 0.7), (3, 0.45), (4, 0.2)], "time int, survival double")
    assert survival.median_survival(curve).first().median == 3


def test_log_rank_tells_groups_apart(spark):
    rows = [(i % 10 + 1, 1, "a") for i in range(60)] + [(i % 10 + 12, 1, "b") for i in range(60)]
    df = spark.createDataFrame(rows, "tenure_months int, event_observed int, g string")
    out = survival.log_rank(df, F.col("g") == "a", F.col("g") == "b").first()
    assert out.chi2 > 50 and survival.log_rank(df, F.col("g") == "a", F.col("g") == "b", p=True).first().p_value == 0.0
    assert survival.log_rank(df.filter("g = 'a'"), F.col("g") == "a", F.col("g") == "b").first().chi2 is None


def test_cox_finds_planted_effects_in_any_order(spark):
    r = np.random.default_rng(11)
    x, z = r.normal(size=1500), r.normal(size=1500)
    t = np.minimum(np.ceil(r.exponential(1 / (0.05 * np.exp(0.7 * x - 0.3 * z)))), 60)
    rows = [(float(a), float(b), int(c), int(c < 60)) for a, b, c in zip(x, z, t)]
    df = spark.createDataFrame(rows, "x double, z double, tenure_months int, event_observed int")
    one, two = survival.cox(df, ["x", "z"]), survival.cox(df.repartition(7), ["x", "z"])
    assert abs(one["beta"][0] - 0.7) < 0.1 and abs(one["beta"][1] + 0.3) < 0.1 and np.allclose(one["beta"], two["beta"], atol=1e-6)


def test_hazard_recovers_the_generator(spark):
    m = synthetic.members(spark, 6000)
    df = survival.subjects(synthetic.spans(m), m).cache()
    found = survival.hazard(df)
    assert all(abs(found[k] - v) < 0.2 for k, v in synthetic.EFFECTS.items())
    rows = survival.scored(spark.createDataFrame([("discrete", k, float(v)) for k, v in found.items()], "estimator string, covariate string, beta double"), synthetic.EFFECTS).collect()
    assert len(rows) == len(synthetic.EFFECTS) and all(r.mae < 0.12 for r in rows)
    assert sorted(r.exit_cause for r in df.select("exit_cause").distinct().collect() if r.exit_cause) == sorted(synthetic.CAUSES)


def test_generator_is_reproducible_and_ring_is_caught(spark):
    m = synthetic.members(spark, 6000)
    s, p = synthetic.spans(m), synthetic.providers(spark, 240, 4)
    c = synthetic.claims(m, s, p)
    assert quality.fingerprint(c, ["claim_line_id", "em_code", "paid_amount"]).first() == quality.fingerprint(synthetic.claims(synthetic.members(spark, 6000).repartition(5), s, p), ["claim_line_id", "em_code", "paid_amount"]).first()
    assert w.grain_violations(c, ["claim_line_id"]).first().violations == 0
    visits = w.professional(c.withColumn("line_key", F.col("claim_line_id")), "professional").drop("region").cache()
    found = upcoding.detect(visits, p).first()
    assert found.recall >= 0.5 and found.precision >= 0.5
    adapted = upcoding.detect(upcoding.evade(visits, p, "reduced_rate"), p).first()
    assert adapted.recall <= found.recall
    with pytest.raises(KeyError):
        upcoding.evade(visits, p, "unheard_of")


def test_peer_scores_of_a_lone_provider(spark):
    df = spark.createDataFrame([("a", "s1", 1.0, 0.5), ("b", "s2", 1.0, 0.1), ("c", "s2", 3.0, 0.9)], "provider_id string, specialty string, mean_intensity double, top_share double")
    got = {r.provider_id: r.z_intensity for r in upcoding.peer_scores(df).collect()}
    assert got == {"a": 0.0, "b": -1.0, "c": 1.0}


def risk_rows(spark, n=400):
    r = np.random.default_rng(1)
    x = r.gamma(2, 500, n)
    rows = [(f"m{i}", int(20 + 10 * (i % 7)), int(i % 4), "north" if i % 2 else "south", float(i % 100) / 100, float(x[i]), int(i % 9), int(i % 3), float(2 * x[i] + 300 * (i % 4) + r.normal(0, 50)), 6) for i in range(n)]
    return spark.createDataFrame(rows, "member_id string, age_band int, chronic_count int, region string, zip_deprivation_index double, prior_cost double, prior_lines int, prior_inpatient int, future_cost double, future_months int")


def test_ridge_is_calibrated_and_split_is_fixed(spark):
    rows = risk.split(risk_rows(spark)).cache()
    assert rows.filter("train").count() == 280
    assert {r.member_id for r in rows.filter("train").collect()} == {r.member_id for r in risk.split(risk_rows(spark).repartition(5)).filter("train").collect()}
    out = risk.evaluate(risk.ridge(rows.filter("train"), rows.filter("not train"))).first()
    assert out.r2 > 0.95 and out.well_calibrated and out.spearman > 0.9
    assert abs(risk.proxy_cost(rows.filter("train"), rows.filter("not train")).first().change) < 0.01


def test_flat_predictions_have_no_slope(spark):
    out = risk.evaluate(risk_rows(spark, 50).withColumn("predicted", F.lit(5.0))).first()
    assert out.spearman is None and out.calibration_slope is None and not out.well_calibrated
    sizes = [r.n for r in risk.calibration(risk.fixed_score(risk_rows(spark, 57))).orderBy("decile").collect()]
    assert sizes == [6] * 7 + [5] * 3


def plain_damped(values, steps, window, damping, uplift):
    n = len(values)
    if n < 15:
        return np.full(steps, values[-1] if n else 0.0)
    cycles = values[: n // 12 * 12].reshape(-1, 12)
    season = cycles.mean(axis=0) - cycles.mean()
    place = np.arange(n + steps) % 12
    recent = (values - season[place[:n]])[-min(window, n) :]
    slope, height = np.polyfit(np.arange(len(recent)) - (len(recent) - 1), recent, 1)
    ahead = damping * (1 - damping ** np.arange(1, steps + 1)) / (1 - damping)
    return (height + slope * ahead + season[place[n:]]) * (1 + uplift)


def test_damped_forecasts(spark):
    r = np.random.default_rng(4)
    known = {(level, str(n)): 100 + 2.0 * np.arange(n) + r.normal(0, 5, n) for n in (0, 1, 11, 12, 14, 15, 17, 24, 25, 40) for level in forecast.SETTINGS}
    rows = [(level, label, int(m), float(v)) for (level, label), y in known.items() for m, v in enumerate([*y, *range(6)])]
    got = {}
    for x in forecast.base_forecasts(spark.createDataFrame(rows, "level string, label string, month_index int, pmpm double")).orderBy("month_index").collect():
        got.setdefault((x.level, x.label), []).append(x.base)
        assert x.actual == x.month_index - int(x.label)
    assert set(got) == set(known)
    for (level, label), y in known.items():
        assert np.allclose(got[level, label], plain_damped(y, 6, *forecast.SETTINGS[level]), rtol=1e-10)


def test_reconciled_forecasts_add_up(spark):
    r = np.random.default_rng(2)
    rows = [(a, b, m, float(50 + 10 * i + m + r.normal(0, 4))) for i, (a, b) in enumerate((x, y) for x in "NS" for y in ("h", "p")) for m in range(23) if (a, m) not in {("N", 0), ("S", 9)}]
    panel = spark.createDataFrame(rows, "region string, product string, month_index int, pmpm double")
    full = forecast.filled(panel)
    assert full.count() == 4 * 23 and full.filter("pmpm is null").isEmpty() and full.filter("gap").count() == 4
    series = forecast.hierarchy(full).cache()
    methods = forecast.all_methods(series).cache()
    coherent = {x.method: x.coherent for x in forecast.incoherence(methods).collect()}
    assert coherent == {"base": False, "bottom_up": True, "top_down": True, "ols": True, "mint": True}
    assert {x.level for x in forecast.scores(methods).collect()} == {"ALL", "total", "region", "product", "leaf"}
    table = {(x.method, x.level): x.mape for x in forecast.scores(methods).collect()}
    best = forecast.best(methods).first()
    assert best.mape == min(v for (m, level), v in table.items() if level == "ALL") == table[best.method, "ALL"]
    assert best.worst_mape == max(v for (m, level), v in table.items() if m == best.method and level != "ALL")


def test_copilot(spark):
    q = copilot.questions(spark)
    one, two = (copilot.accuracy(copilot.marked(copilot.resolved(q, STANDARD, v))).first() for v in (1, 2))
    assert one.overall == 0.875 and two.overall == 1.0
    assert copilot.strict_reply("METRIC: pmpm\nDIMENSIONS: region, zip, region", STANDARD) == ("pmpm", ["region"])
    assert copilot.strict_reply("METRIC: profit", STANDARD) == (None, []) and copilot.strict_reply("", STANDARD) == (None, [])


def test_audit_and_traceability(spark):
    trail = quality.AuditTrail()
    for i in range(5):
        trail.append("a", "b", f"s{i}", "d", "2024")
    assert tuple(quality.verify(trail.frame(spark)).first()) == (True, None)
    trail.entries[2] = (*trail.entries[2][:4], "changed", *trail.entries[2][5:])
    assert tuple(quality.verify(trail.frame(spark)).first()) == (False, 3)
    needs = spark.createDataFrame([("r1", ["t1", "t9"]), ("r2", [])], "requirement string, tests array<string>")
    assert sorted(map(str, quality.untraced(needs, spark.createDataFrame([("t1",)], "test string")).collect())) == sorted(["Row(requirement='r1', test='t9')", "Row(requirement='r2', test=None)"])


def test_streams_add_up(spark, tmp_path):
    rows = [(f"m{i % 3}", i % 4, 1.25) for i in range(40)]
    src = f"{tmp_path}/in"
    df = spark.createDataFrame(rows, "member_id string, month_index int, paid_amount double")
    df.limit(20).write.parquet(src)
    for _ in range(2):
        stream.refresh_months(spark.readStream.schema(df.schema).parquet(src), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        if _ == 0:
            df.write.mode("append").parquet(src)
    assert stream.monthly(spark, f"{tmp_path}/out").agg(F.sum("paid_amount"), F.sum("total_lines")).first()[:] == (75.0, 60)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert stream.windowed(events).agg(F.sum("n")).first()[0] == events.count()


def test_synthetic_counts_are_of_the_whole_job(spark):
    m = synthetic.members(spark, 24000)
    sp, pr = synthetic.spans(m), synthetic.providers(spark, 900, 22)
    got = {r.relation: r.n for r in w.row_counts({"members": m, "providers": pr, "claim_lines": synthetic.claims(m, sp, pr)}).collect()}
    assert (got["members"], got["providers"]) == (24000, 900) and got["claim_lines"] > got["members"]
