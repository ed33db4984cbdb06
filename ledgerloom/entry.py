"""Every query by name, and SQL over the same tables that gives the same rows."""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import half_up, month_label
from ledgerloom.operators import copilot, forecast, mutants, quality, regression, risk, survival, upcoding
from ledgerloom.plans import warehouse as w
from ledgerloom.plans.metrics import STANDARD, Registry, without_pharmacy
from ledgerloom.plans.tables import cut
from ledgerloom.sources import synthetic
from ledgerloom.sources.payer import FIRST_YEAR, Payer
from ledgerloom.streaming import claims as stream

#: The month that parts features from target in the stand-in data.
RISK_CUT = 36

PRELUDE = """
WITH place AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
v_member AS (SELECT 'M' || c_custkey AS member_id, (20 + 10 * (c_custkey % 7))::INT AS age_band, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, c_mktsegment AS plan,
  ['HMO', 'PPO', 'EPO'][c_custkey % 3 + 1] AS product, ['individual', 'employer', 'broker', 'exchange'][c_custkey % 4 + 1] AS channel, r_name AS region, (c_custkey % 4)::INT AS chronic_count,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 21000.0::DOUBLE WHEN 'BUILDING' THEN 24000.0::DOUBLE WHEN 'FURNITURE' THEN 27000.0::DOUBLE WHEN 'HOUSEHOLD' THEN 30000.0::DOUBLE WHEN 'MACHINERY' THEN 33000.0::DOUBLE ELSE 25000.0::DOUBLE END AS monthly_premium,
  200000.0::DOUBLE + 100 * abs(c_acctbal) AS annual_income, (c_custkey % 100)::DOUBLE / 100 AS zip_deprivation_index, c_custkey FROM customer JOIN place ON c_nationkey = n_nationkey),
v_provider AS (SELECT 'P' || s_suppkey AS provider_id, 'specialty_' || (s_suppkey % 7) AS specialty, r_name AS region, (s_suppkey % 11 = 0)::INT AS is_fraud FROM supplier JOIN place ON s_nationkey = n_nationkey),
o_months AS (SELECT o_orderkey, o_custkey, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INT AS m FROM orders),
v_span AS (SELECT 'M' || k AS member_id, s AS start_month, e AS end_month, (e - s)::INT AS tenure, (e < 72)::INT AS event, CASE WHEN e < 72 THEN ['voluntary', 'employer_change', 'moved_away'][k % 3 + 1] END AS exit_cause,
  (k % 2)::INT AS utilisation_low, CASE WHEN k % 5 = 0 THEN s + k % 24 ELSE -1 END::INT AS denial_month FROM (SELECT o_custkey AS k, min(m) AS s, max(m) AS e FROM o_months GROUP BY 1)),
c0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_returnflag, o_custkey, m, p_type, l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey AS line_key,
  CASE WHEN l_quantity <= 12 THEN 0 WHEN l_quantity <= 25 THEN 1 WHEN l_quantity <= 38 THEN 2 ELSE 3 END AS level FROM lineitem JOIN o_months ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
v_claim AS (SELECT 'M' || o_custkey AS member_id, 'P' || l_suppkey AS provider_id, m AS month_index, p_type AS service_category, line_key, level, l_extendedprice AS allowed_amount, CASE WHEN l_returnflag = 'R' THEN 'denied' ELSE 'paid' END AS status,
  CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE floor(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT) / 100)::BIGINT / 100 END AS paid_amount,
  CASE WHEN l_suppkey % 11 = 0 AND ('0x' || substr(md5(line_key || '|shift'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.42 THEN least(level + 1, 3) ELSE level END AS billed FROM c0),
by_month AS (SELECT member_id, month_index, sum(paid_amount::DECIMAL(18,2))::DOUBLE AS paid_amount, sum(allowed_amount::DECIMAL(18,2))::DOUBLE AS allowed_amount, count(*) AS total_lines, sum((status = 'denied')::INT)::BIGINT AS denied_lines FROM v_claim GROUP BY 1, 2),
mm AS (SELECT s.member_id, x.i::INT AS month_index, printf('%04d-%02d', 1995 + x.i // 12, x.i % 12 + 1) AS month, region, plan, product, channel, age_band, sex, chronic_count, monthly_premium AS premium_collected,
  coalesce(paid_amount, 0) AS paid_amount, coalesce(allowed_amount, 0) AS allowed_amount, coalesce(total_lines, 0)::BIGINT AS total_lines, coalesce(denied_lines, 0)::BIGINT AS denied_lines
  FROM v_span s JOIN range(0, 200) x(i) ON x.i >= start_month AND x.i < end_month JOIN v_member USING (member_id) LEFT JOIN by_month b ON b.member_id = s.member_id AND b.month_index = x.i)"""

_NUM = {"loss_ratio": "sum(paid_amount::DECIMAL(18,2))::DOUBLE", "pmpm": "sum(paid_amount::DECIMAL(18,2))::DOUBLE", "premium_pmpm": "sum(premium_collected::DECIMAL(18,2))::DOUBLE", "denial_rate": "sum(denied_lines)::DOUBLE", "utilisation_per_1000": "sum(total_lines)::DOUBLE * 1000", "member_months": "count(*)::DOUBLE", "paid_amount": "sum(paid_amount::DECIMAL(18,2))::DOUBLE"}
_DEN = {"loss_ratio": "sum(premium_collected::DECIMAL(18,2))::DOUBLE", "pmpm": "count(*)::DOUBLE", "premium_pmpm": "count(*)::DOUBLE", "denial_rate": "sum(total_lines)::DOUBLE", "utilisation_per_1000": "count(*)::DOUBLE"}
_DIMS = ("month", "region", "plan", "product", "channel", "age_band")


def _metric_sql(name: str, dim: str | None) -> str:
    key = f"{dim}::VARCHAR AS {dim}, " if dim else ""
    group = " GROUP BY 1" if dim else ""
    if name not in _DEN:
        return f"{PRELUDE} SELECT {key}{_NUM[name]} AS value, {_NUM[name]} AS numerator FROM mm{group}"
    return f"{PRELUDE} SELECT {key}round({_NUM[name]} / nullif({_DEN[name]}, 0), 9) AS value, {_NUM[name]} AS numerator, {_DEN[name]} AS denominator FROM mm{group}"


def _snapshot_sql(relation: str, loss: str = "sum(paid_amount::DECIMAL(18,2))::DOUBLE") -> str:
    parts = []
    for name, by in regression.SPECS:
        num = loss if name == "loss_ratio" else _NUM[name]
        value = f"{num} / nullif({_DEN[name]}, 0)" if name in _DEN else num
        parts.append(f"SELECT '{'|'.join((name, *by))}' AS metric, {by[0] if by else repr('ALL')}::VARCHAR AS slice, round({value}, 6) AS value FROM {relation}" + (" GROUP BY 2" if by else ""))
    return " UNION ALL ".join(parts)


def _base(s, d) -> DataFrame:
    return w.member_month(Payer(s, d))


def _subjects(s, d) -> DataFrame:
    p = Payer(s, d)
    return survival.subjects(p.enrollment_spans, p.members)


def _visits(s, d, strategy: str | None = None) -> tuple[DataFrame, DataFrame]:
    p = Payer(s, d)
    visits = w.professional(p.claim_facts).drop("region")
    return (upcoding.evade(visits, p.providers, strategy) if strategy else visits), p.providers


def _scored_providers(s, d) -> DataFrame:
    return upcoding.peer_scores(upcoding.features(*_visits(s, d)))


def _risk(s, d) -> DataFrame:
    p = Payer(s, d)
    return risk.dataset(w.member_month(p), p.claim_facts, p.members, RISK_CUT)


def _split(s, d) -> tuple[DataFrame, DataFrame]:
    rows = cut(risk.split(_risk(s, d)))
    return rows.filter("train"), rows.filter("not train")


def _ridge(s, d) -> DataFrame:
    return risk.evaluate(risk.ridge(*_split(s, d)))


def _boosted(s, d) -> DataFrame:
    return risk.evaluate(risk.boosted(*_split(s, d)))


def _series(s, d) -> DataFrame:
    """Months in which every leaf has exposure stand for the panel; the leaves' few rows a month are kept for their several readers."""
    return forecast.hierarchy(forecast.filled(cut(forecast.leaves(_base(s, d)))))


def _pairs(values: dict) -> list[tuple]:
    return [(k, round(float(v), 5)) for k, v in values.items()]


def _audit(s, d) -> DataFrame:
    """Whether a trail over all events, as it was made, is whole, and where it first breaks (0: nowhere)."""
    found = quality.breaks(_trail(s, d)).filter("level = 0")
    return found.agg((F.count("*") == 0).alias("intact"), F.coalesce(F.min("seq"), F.lit(0)).alias("broken_at_seq"))


def _trace(s, d) -> DataFrame:
    """Customers' orders that no line backs, and customers without any order."""
    read = lambda t: s.read.parquet(f"{d}/{t}.parquet")
    orders = read("orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey")).alias("tests"))
    needs = read("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("requirement"), "tests")
    return quality.untraced(needs, read("lineitem").select(F.col("l_orderkey").alias("test")).distinct())


def _months(s, d) -> DataFrame:
    seen = _base(s, d).select("month_index").distinct()
    return seen.select("month_index", month_label("month_index", FIRST_YEAR).alias("month"), w.month_label_rounded("month_index", FIRST_YEAR).alias("month_ref"))


def _catalog(s, d) -> DataFrame:
    """The declared metrics with their figures in total."""
    told = copilot.with_figures(STANDARD.catalog_frame(s).withColumnRenamed("name", "metric"), _base(s, d), STANDARD).withColumnRenamed("metric", "name")
    return told.withColumn("higher_is_better", F.coalesce(F.col("higher_is_better").cast("string"), F.lit("")))


def _key(s, d, version: int) -> DataFrame:
    """The answer key's questions, how each is read, and the figure it gets."""
    return copilot.with_figures(copilot.marked(copilot.resolved(copilot.questions(s), STANDARD, version)), _base(s, d), STANDARD)


def _trail(s, d) -> DataFrame:
    return quality.sealed(s.read.parquet(f"{d}/events.parquet"), ["ts", "user_id", "event_type", "value", "props"], "event_id")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _fingerprints(s, d) -> DataFrame:
    out = [quality.fingerprint(s.read.parquet(f"{d}/{t}.parquet")).select(F.lit(t).alias("relation"), "n", "digest") for t in TABLES]
    return functools.reduce(DataFrame.union, out)


def _audited_events(s, d) -> DataFrame:
    """A trail over all events, in which some entries are changed and some removed afterwards, and where it breaks."""
    trail = _trail(s, d)
    entry = F.col("level") == 0
    id_ = F.substring_index("content", "\x1f", 1).cast("long")
    gone, changed = entry & (id_ % 1499 == 13), entry & (id_ % 997 == 11)
    trail = trail.filter(~gone).withColumn("content", F.when(changed, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return quality.breaks(trail)


def _orphans(s, d) -> DataFrame:
    read = lambda t, *c: s.read.parquet(f"{d}/{t}.parquet").select(*[F.col(x).alias(x.split("_", 1)[1]) for x in c])
    return quality.orphans({
        "line without order": (read("lineitem", "l_orderkey"), read("orders", "o_orderkey"), "orderkey"), "line without part": (read("lineitem", "l_partkey"), read("part", "p_partkey"), "partkey"),
        "line without supplier": (read("lineitem", "l_suppkey"), read("supplier", "s_suppkey"), "suppkey"), "order without customer": (read("orders", "o_custkey"), read("customer", "c_custkey"), "custkey"),
        "customer without order": (read("customer", "c_custkey"), read("orders", "o_custkey"), "custkey")})


def _asked(s, d) -> DataFrame:
    """What users ask in conversations, mapped or refused."""
    asked = s.read.parquet(f"{d}/conversations.parquet").filter("role = 'user'").withColumnRenamed("text", "question")
    return copilot.resolved(asked, STANDARD, 2).select("conv_id", "turn", "metric", "dims")


def _claimed(registry: Registry) -> Registry:
    """The loss ratio of months with a claim: a filter of the metric's own, beside whatever a question asks for."""
    out = Registry(registry.base_relation, dict(registry.metrics), dict(registry.dimensions))
    out.metrics["loss_ratio"] = replace(registry.get("loss_ratio"), filters=(lambda: F.col("total_lines") > 0,))
    return out


def _plain_methods(s, d) -> DataFrame:
    return forecast.all_methods(_series(s, d), projected=False)


#: Coefficients at which the slope of the likelihood is looked at.
AT = {"burden10": 0.05, "utilisation_low": -0.1, "is_individual": 0.2, "had_denial": 0.1}


def _round(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.withColumn("value", F.round("value", digits)) if "denominator" in df.columns else df


QUERIES = {
    **{f"m_{m}_{d or 'total'}": (lambda s, sf, m=m, d=d: _round(STANDARD.compile(_base(s, sf), m, [d] if d else []))) for m in STANDARD.metrics for d in (None, *_DIMS)},
    "member_month": lambda s, d: _base(s, d).drop("month_ref", "premium_burden"),
    "month_labels": _months,
    "provider_coding": lambda s, d: w.provider_month(Payer(s, d)),
    "fanout_check": lambda s, d: w.fanout(_base(s, d), Payer(s, d).enrollment_spans),
    "zero_claim_share": lambda s, d: w.zero_claim_share(_base(s, d)),
    "row_counts": lambda s, d: (lambda p: w.row_counts({"members": p.members, "providers": p.providers, "enrollment_spans": p.enrollment_spans, "claim_lines": p.claim_lines}))(Payer(s, d)),
    "idempotency": lambda s, d: w.idempotency(lambda: _base(s, d)),
    "grain_check": lambda s, d: w.grain_violations(_base(s, d), ["member_id", "month_index"]),
    "invariants": lambda s, d: w.invariants(_base(s, d), STANDARD),
    "pharmacy_split": lambda s, d: w.with_pharmacy(_base(s, d), Payer(s, d).claim_facts).groupBy("plan").agg(F.count("*").alias("n"), F.sum(F.col("pharmacy_paid").cast("decimal(18,2)")).cast("double").alias("pharmacy_paid")),
    "metric_snapshot": lambda s, d: regression.snapshot(_base(s, d), STANDARD),
    "blast_radius": lambda s, d: regression.blast_radius(w.with_pharmacy(_base(s, d), Payer(s, d).claim_facts), STANDARD, without_pharmacy(STANDARD)),
    "loss_ratio_where": lambda s, d: _round(_claimed(STANDARD).compile(w.relations(Payer(s, d)), "loss_ratio", ["plan", "region"], [F.col("age_band") >= 40, F.col("channel").isin("employer", "broker")])),
    "drift_rows": lambda s, d: regression.first_drift(QUERIES["blast_radius"](s, d)),
    "metric_mutants": lambda s, d: mutants.caught(_base(s, d), STANDARD),
    "loss_ratio_ex_pharmacy": lambda s, d: _round(without_pharmacy(STANDARD).compile(w.relations(Payer(s, d)), "loss_ratio", ["plan"])),
    "largest_moves": lambda s, d: regression.largest(QUERIES["blast_radius"](s, d)),
    "km_overall": lambda s, d: survival.kaplan_meier(_subjects(s, d)),
    "km_by_channel": lambda s, d: survival.kaplan_meier(_subjects(s, d), ("channel",)),
    "km_median": lambda s, d: survival.median_survival(survival.kaplan_meier(_subjects(s, d), ("channel",)), ("channel",)),
    "logrank": lambda s, d: survival.log_rank(_subjects(s, d), F.col("channel") == "individual", F.col("channel") == "employer"),
    "logrank_p": lambda s, d: survival.log_rank(_subjects(s, d), F.col("channel") == "individual", F.col("channel") == "employer", p=True),
    "logrank_pairs": lambda s, d: survival.log_rank_pairs(_subjects(s, d), "channel"),
    "cause_mix": lambda s, d: survival.cause_mix(Payer(s, d).enrollment_spans),
    "competing_risks": lambda s, d: survival.competing(Payer(s, d).enrollment_spans),
    "cif": lambda s, d: survival.cumulative_incidence(Payer(s, d).enrollment_spans),
    "person_month": lambda s, d: survival.person_months(_subjects(s, d)).groupBy("tenure").agg(F.count("*").alias("n"), F.sum("had_denial").cast("long").alias("denials"), F.sum("lapsed").cast("long").alias("lapsed")),
    "cox_slope": lambda s, d: survival.cox_slope(_subjects(s, d), AT),
    "hazard_slope": lambda s, d: survival.logistic_slope(survival.person_months(_subjects(s, d)), "lapsed", AT | {"tenure": 0.02, "intercept": -4.0}),
    "naive_slope": lambda s, d: survival.logistic_slope(_subjects(s, d), "event_observed", AT | {"intercept": -1.0}),
    "estimator_scores": lambda s, d: survival.scored(survival.estimates(cut(_subjects(s, d))), synthetic.EFFECTS),
    "cox_ph": lambda s, d: survival.cox_frame(_subjects(s, d), ["burden10", "utilisation_low", "is_individual", "had_denial"]),
    "discrete_hazard": lambda s, d: s.createDataFrame(_pairs(survival.hazard(cut(_subjects(s, d)))), "covariate string, beta double"),
    "naive_logistic": lambda s, d: s.createDataFrame(_pairs(survival.naive_churn(cut(_subjects(s, d)))), "covariate string, beta double"),
    "provider_features": lambda s, d: upcoding.features(*_visits(s, d)).select("provider_id", "specialty", "region", "is_fraud", "n_claims", "total_minutes", *[F.round(c, 6).alias(c) for c in ("mean_intensity", "top_share", "max_daily_minutes")]),
    "peer_z": lambda s, d: _scored_providers(s, d).select("provider_id", "specialty", *[F.round(c, 5).alias(c) for c in ("z_intensity", "z_top_share")]),
    "upcoding_flags": lambda s, d: upcoding.flags(_scored_providers(s, d)).select("provider_id", "rule_peer_intensity", "rule_top_code_share", "rule_impossible_day", "flagged"),
    "upcoding_confusion": lambda s, d: upcoding.detect(*_visits(s, d)),
    **{f"evasion_{k}": (lambda s, d, k=k: upcoding.detect(*_visits(s, d, k))) for k in upcoding.STRATEGIES},
    "risk_dataset": lambda s, d: _risk(s, d),
    "risk_split": lambda s, d: risk.split(_risk(s, d)).select("member_id", "train"),
    "calibration_deciles": lambda s, d: risk.calibration(risk.fixed_score(_risk(s, d))),
    "risk_evaluation": lambda s, d: risk.evaluate(risk.fixed_score(_risk(s, d))),
    "region_parity": lambda s, d: risk.region_parity(risk.fixed_score(_risk(s, d))),
    "risk_ridge": _ridge,
    "risk_boosted": _boosted,
    "risk_ridge_fit": lambda s, d: risk.ridge_frame(_split(s, d)[0]).select("feature", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se")),
    "risk_proxy_cost": lambda s, d: risk.proxy_cost(*_split(s, d)),
    "pmpm_leaf": lambda s, d: forecast.leaves(_base(s, d)).select("region", "product", "month_index", F.round("pmpm", 6).alias("pmpm")),
    "pmpm_hierarchy": lambda s, d: forecast.hierarchy(forecast.leaves(_base(s, d))).select("level", "label", "month_index", F.round("pmpm", 5).alias("pmpm_sum")),
    "forecast_base": lambda s, d: forecast.base_forecasts(_series(s, d)).select("level", "label", "month_index", half_up(F.col("actual"), 4).alias("actual"), half_up(F.col("base"), 4).alias("base")),
    "forecast_plain": lambda s, d: _plain_methods(s, d).select("method", "level", "label", "month_index", half_up(F.col("actual"), 4).alias("actual"), half_up(F.col("value"), 4).alias("value")),
    "forecast_plain_scores": lambda s, d: forecast.scores(_plain_methods(s, d)),
    "forecast_plain_incoherence": lambda s, d: forecast.incoherence(cut(_plain_methods(s, d))),
    "forecast_best_plain": lambda s, d: forecast.best(cut(_plain_methods(s, d))),
    "forecast_best": lambda s, d: forecast.best(cut(forecast.all_methods(_series(s, d)))),
    "forecast_methods": lambda s, d: forecast.all_methods(_series(s, d)).select("method", "level", "label", "month_index", half_up(F.col("actual"), 2).alias("actual"), half_up(F.col("value"), 2).alias("value")),
    "forecast_scores": lambda s, d: forecast.scores(forecast.all_methods(_series(s, d))),
    "forecast_incoherence": lambda s, d: forecast.incoherence(cut(forecast.all_methods(_series(s, d)))),
    "catalog": _catalog,
    "copilot_rules": lambda s, d: _key(s, d, 1).select("question", "metric", "dims", "kind", "correct", F.round("value", 5).alias("value")),
    "copilot_rules_v2": lambda s, d: _key(s, d, 2).select("question", "metric", "dims", "kind", "correct", F.round("value", 5).alias("value")),
    "copilot_score": lambda s, d: copilot.accuracy(_key(s, d, 1)).crossJoin(_key(s, d, 1).agg(F.count("value").alias("answered"))),
    "audit_verify": _audit,
    "traceability": _trace,
    "fingerprint": _fingerprints,
    "audit_events": _audited_events,
    "orphans": _orphans,
    "questions_asked": _asked,
    "events_by_day": lambda s, d: stream.windowed(s.read.parquet(f"{d}/events.parquet")),
}

_KM = """t{n} AS (SELECT {k}tenure AS time, sum({e})::BIGINT AS events, count(*) AS leaving FROM {rel} GROUP BY ALL),
r{n} AS (SELECT *, sum(leaving) OVER (PARTITION BY {p} ORDER BY time DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS at_risk FROM t{n}),
e{n} AS (SELECT *, max((events = at_risk)::INT) OVER (PARTITION BY {p} ORDER BY time ROWS UNBOUNDED PRECEDING) AS over,
  exp(sum(CASE WHEN events < at_risk THEN ln(1.0::DOUBLE - events::DOUBLE / at_risk) ELSE 0 END) OVER (PARTITION BY {p} ORDER BY time ROWS UNBOUNDED PRECEDING)) AS s0,
  sum(CASE WHEN events < at_risk THEN events::DOUBLE / (at_risk * (at_risk - events)) ELSE 0 END) OVER (PARTITION BY {p} ORDER BY time ROWS UNBOUNDED PRECEDING) AS g FROM r{n} WHERE events > 0),
k{n} AS (SELECT *, CASE WHEN over = 1 THEN 0 ELSE s0 END AS s FROM e{n})"""
_KM_OUT = "time, events, at_risk, round(s, 5) AS survival, round(greatest(s - 1.96 * s * sqrt(g), 0), 5) AS ci_lower, round(least(s + 1.96 * s * sqrt(g), 1), 5) AS ci_upper"


def _km(n: str, rel: str, by: str = "", event: str = "event") -> str:
    return _KM.format(n=n, k=f"{by}, " if by else "", p=by or "1", e=event, rel=rel)


_SUBJECTS = "subj AS (SELECT s.*, channel FROM v_span s JOIN v_member USING (member_id))"
_VISITS = """visits AS (SELECT c.provider_id, month_index, line_key, {level} AS i FROM v_claim c LEFT JOIN ring USING (provider_id) WHERE service_category = 'STANDARD')"""
_RING = "ring AS (SELECT provider_id, row_number() OVER (ORDER BY provider_id) > floor(count(*) OVER () / 2) AS active FROM v_provider WHERE is_fraud = 1)"
_FEATURES = """pm AS (SELECT provider_id, month_index, count(*) AS n, sum(i)::BIGINT AS i, sum((i >= 2)::INT)::BIGINT AS top, sum([10, 15, 25, 40][i + 1])::BIGINT AS m FROM visits GROUP BY 1, 2),
feat AS (SELECT provider_id, specialty, region, is_fraud, n_claims, mean_intensity, top_share, total_minutes, max_daily_minutes FROM (SELECT provider_id, sum(n)::BIGINT AS n_claims, sum(i)::DOUBLE / sum(n) AS mean_intensity, sum(top)::DOUBLE / sum(n) AS top_share,
  sum(m)::BIGINT AS total_minutes, max(m)::DOUBLE / 21 AS max_daily_minutes FROM pm GROUP BY 1) JOIN v_provider USING (provider_id)),
z AS (SELECT *, (mean_intensity - avg(mean_intensity) OVER w) / CASE WHEN stddev_pop(mean_intensity) OVER w > 1e-12 THEN stddev_pop(mean_intensity) OVER w ELSE 1 END AS z_intensity,
  (top_share - avg(top_share) OVER w) / CASE WHEN stddev_pop(top_share) OVER w > 1e-12 THEN stddev_pop(top_share) OVER w ELSE 1 END AS z_top_share FROM feat WINDOW w AS (PARTITION BY specialty)),
fl AS (SELECT *, round(z_intensity, 9) > 2.5 AS rule_peer_intensity, round(z_top_share, 9) > 2.5 AS rule_top_code_share, max_daily_minutes > 600 AS rule_impossible_day FROM z WHERE n_claims >= 40),
flagged AS (SELECT *, rule_peer_intensity OR rule_top_code_share OR rule_impossible_day AS flagged FROM fl),
conf AS (SELECT coalesce(sum((is_fraud = 1 AND flagged)::INT), 0)::BIGINT AS tp, coalesce(sum((is_fraud <> 1 AND flagged)::INT), 0)::BIGINT AS fp, coalesce(sum((is_fraud = 1 AND NOT flagged)::INT), 0)::BIGINT AS fn,
  coalesce(sum(rule_peer_intensity::INT), 0)::BIGINT AS rule_peer_intensity, coalesce(sum(rule_top_code_share::INT), 0)::BIGINT AS rule_top_code_share, coalesce(sum(rule_impossible_day::INT), 0)::BIGINT AS rule_impossible_day FROM flagged),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r FROM conf)"""
_CONF = "SELECT tp, fp, fn, rule_peer_intensity, rule_top_code_share, rule_impossible_day, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM pr"


def _upcoding(level: str = "billed") -> str:
    return f"{PRELUDE}, {_RING}, {_VISITS.format(level=level)}, {_FEATURES}"


def _drawn(strategy: str) -> str:
    return f"('0x' || substr(md5(line_key || '|{strategy}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


_LEVELS = {
    "reduced_rate": f"CASE WHEN active IS NOT NULL AND {_drawn('reduced_rate')} < 0.15 THEN least(level + 1, 3) ELSE level END",
    "stay_below_threshold": f"CASE WHEN active IS NOT NULL AND {_drawn('stay_below_threshold')} < 0.42 AND level < 2 THEN least(level + 1, 2) ELSE level END",
    "spread_thin": f"CASE WHEN coalesce(active, false) AND {_drawn('spread_thin')} < 0.42 THEN least(level + 1, 3) ELSE level END",
}
_RISK_ROWS = f"""{PRELUDE}, sums AS (SELECT member_id, coalesce(sum(paid_amount::DECIMAL(18,2)) FILTER (month_index < {RISK_CUT}), 0)::DOUBLE AS prior_cost, coalesce(sum(total_lines) FILTER (month_index < {RISK_CUT}), 0)::BIGINT AS prior_lines, count(*) FILTER (month_index < {RISK_CUT}) AS pm,
  coalesce(sum(paid_amount::DECIMAL(18,2)) FILTER (month_index >= {RISK_CUT}), 0)::DOUBLE AS future_cost, count(*) FILTER (month_index >= {RISK_CUT}) AS future_months FROM mm GROUP BY 1),
stays AS (SELECT member_id, count(*) AS prior_inpatient FROM v_claim WHERE month_index < {RISK_CUT} AND service_category = 'LARGE' GROUP BY 1),
risk AS (SELECT member_id, age_band, chronic_count, region, plan, zip_deprivation_index, prior_cost, prior_lines, coalesce(prior_inpatient, 0) AS prior_inpatient, future_cost, future_months
  FROM sums JOIN v_member USING (member_id) LEFT JOIN stays USING (member_id) WHERE pm > 0 AND future_months >= 3)"""
_RISK = f"{_RISK_ROWS}, scored AS (SELECT *, prior_cost * 0.4 + prior_lines * 1000.0 + chronic_count * 5000.0 + 20000.0 AS p, future_cost AS y FROM risk)"
_EVALUATED = """k AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rp, row_number() OVER (ORDER BY p DESC, member_id DESC) AS place, count(*) OVER () AS n, sum(y::DECIMAL(20,4)) OVER ()::DOUBLE / count(*) OVER () AS mean FROM scored), o AS (SELECT round(corr(ry, rp), 4) AS spearman, round(avg(y) FILTER (place <= ceil(n / 10)) / avg(y), 3) AS top_decile_lift, round(1 - sum((y - p) ** 2) / sum((y - mean) ** 2), 4) AS r2, floor((sum(abs(y - p)::DECIMAL(20,4))::DOUBLE / count(*)) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS mae, round(regr_slope(y, p), 4) AS calibration_slope, round(regr_intercept(y, p), 1) AS calibration_intercept, round((sum(p) - sum(y)) / sum(y) * 100, 3) AS payment_error_pct FROM k) SELECT *, coalesce(calibration_slope BETWEEN 0.9 AND 1.1, false) AS well_calibrated FROM o"""
_FEATURES_SQL = ("age_band", "chronic_count", "prior_cost", "prior_lines", "prior_inpatient", "zip_deprivation_index")


def _ridge_parts(tag: str, features) -> str:
    """Ridge by Gauss-Jordan on lists: centred products in standard units, the inverse beside them."""
    k, values = len(features), ", ".join(f"{c}::DOUBLE" for c in features)
    return f"""x_{tag} AS (SELECT train, member_id, future_cost AS y, [{values}, future_cost::DOUBLE] AS v FROM parted),
mean_{tag} AS (SELECT count(*) AS n, [{", ".join(f"avg(v[{i}])" for i in range(1, k + 2))}] AS m FROM x_{tag} WHERE train),
prod_{tag} AS (SELECT i, j, sum((v[i] - m[i]) * (v[j] - m[j])) AS s FROM x_{tag}, mean_{tag}, range(1, {k + 2}) a(i), range(1, {k + 2}) b(j) WHERE train GROUP BY i, j),
sd_{tag} AS (SELECT list(CASE WHEN s > 0 THEN sqrt(s / n) ELSE 1 END ORDER BY i) AS sd FROM prod_{tag}, mean_{tag} WHERE i = j AND i <= {k}),
rows_{tag} AS (SELECT i, list(s / (sd[i] * CASE WHEN j <= {k} THEN sd[j] ELSE 1 END) + CASE WHEN i = j THEN 1 ELSE 0 END ORDER BY j) AS g FROM prod_{tag}, sd_{tag} WHERE i <= {k} GROUP BY i),
begin_{tag} AS (SELECT list(list_concat(g, list_transform(range(1, {k + 1}), lambda c: CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0 END)) ORDER BY i) AS a FROM rows_{tag}),
gj_{tag} AS (SELECT 0::BIGINT AS step, a FROM begin_{tag} UNION ALL SELECT step + 1, list_transform(range(1, {k + 1}), lambda r: CASE WHEN r = step + 1 THEN list_transform(a[step + 1], lambda z: z / a[step + 1][step + 1])
  ELSE list_transform(range(1, {2 * k + 2}), lambda c: a[r][c] - a[r][step + 1] * a[step + 1][c] / a[step + 1][step + 1]) END) FROM gj_{tag} WHERE step < {k}),
beta_{tag} AS (SELECT list_transform(a, lambda r: r[{k + 1}]) AS b, list_transform(a, lambda r: r[{k + 2}:]) AS inv FROM gj_{tag} WHERE step = {k}),
noise_{tag} AS (SELECT (sum((y - m[{k + 1}] - list_sum(list_transform(range(1, {k + 1}), lambda c: b[c] * (v[c] - m[c]) / sd[c]))) ** 2) / any_value(n - {k} - 1)) AS noise FROM x_{tag}, mean_{tag}, sd_{tag}, beta_{tag} WHERE train),
coef_{tag} AS (SELECT unnest([{", ".join(repr(f) for f in features)}]) AS feature, unnest(list_transform(range(1, {k + 1}), lambda c: b[c] / sd[c])) AS beta,
  unnest(list_transform(range(1, {k + 1}), lambda c: sqrt(noise * (inv[c][c] - list_sum(list_transform(inv[c], lambda z: z * z)))) / sd[c])) AS se FROM beta_{tag}, sd_{tag}, noise_{tag}
  UNION ALL SELECT 'intercept', m[{k + 1}] - list_sum(list_transform(range(1, {k + 1}), lambda c: b[c] * m[c] / sd[c])), NULL FROM beta_{tag}, sd_{tag}, mean_{tag}),
fit_{tag} AS (SELECT member_id, y, m[{k + 1}] + list_sum(list_transform(range(1, {k + 1}), lambda c: b[c] * (v[c] - m[c]) / sd[c])) AS p FROM x_{tag}, mean_{tag}, sd_{tag}, beta_{tag} WHERE NOT train)"""


def _ridge_sql(tag: str) -> str:
    split = "parted AS (SELECT *, row_number() OVER (ORDER BY md5(member_id || '|1509'), member_id) <= floor(count(*) OVER () * 0.7) AS train FROM risk)"
    return f"{_RISK_ROWS.replace('WITH', 'WITH RECURSIVE', 1)}, {split}, {_ridge_parts(tag, _FEATURES_SQL)}"


_LEAF = "leaf AS (SELECT region, product, month_index, sum(paid_amount::DECIMAL(18,2))::DOUBLE / count(*) AS pmpm FROM mm GROUP BY ALL)"
_PHARM = "ph AS (SELECT member_id, month_index, sum(paid_amount::DECIMAL(18,2))::DOUBLE AS pharmacy_paid FROM v_claim WHERE service_category = 'PROMO' GROUP BY 1, 2), mp AS (SELECT mm.*, coalesce(pharmacy_paid, 0) AS pharmacy_paid FROM mm LEFT JOIN ph USING (member_id, month_index))"
_BLAST = f"""{PRELUDE}, {_PHARM}, before AS ({_snapshot_sql('mp')}), after AS ({_snapshot_sql('mp', 'sum((paid_amount - pharmacy_paid)::DECIMAL(18,2))::DOUBLE')}),
moves AS (SELECT b.metric, b.slice, b.value AS before, a.value AS after, round(a.value - b.value, 6) AS change, round(CASE WHEN b.value <> 0 THEN (a.value - b.value) / b.value END, 6) AS relative, abs(a.value - b.value) >= 1e-9 AS moved,
  abs(a.value - b.value) >= 1e-9 AND (abs(a.value - b.value) >= 0.005 OR coalesce(abs((a.value - b.value) / nullif(b.value, 0)) >= 0.01, false)) AS material FROM before b JOIN after a USING (metric, slice))"""


def _values(rows) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


_TOLD = "told AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, round({_NUM[m]}{f' / nullif({_DEN[m]}, 0)' if m in _DEN else ''}, 6) AS value FROM mm" for m in STANDARD.metrics) + ")"


def _questions_sql(version: int) -> str:
    ahead = f"regexp_matches(said, ' ({'|'.join(copilot.AHEAD)}) ')" if version > 1 else "false"
    return f"""{PRELUDE}, {_TOLD}, q AS (SELECT *, concat(' ', array_to_string(regexp_extract_all(lower(question), '[a-z0-9]+'), ' '), ' ') AS said FROM {_values(copilot.QUESTIONS)} t(question, want_metric, want_dims)),
m AS (SELECT question, arg_min(metric, place) AS metric FROM q JOIN {_values(copilot.phrases(STANDARD, version > 1))} p(place, metric, phrase) ON contains(said, concat(' ', phrase, ' ')) AND NOT {ahead} GROUP BY 1),
d AS (SELECT question, string_agg(dim, ',' ORDER BY dim) AS dims FROM q JOIN {_values((x, x.replace('_', ' ')) for x in STANDARD.dimensions)} p(dim, phrase) ON contains(concat(' ', regexp_extract(said, ' (by|per) (.*)$', 2)), concat(' ', phrase, ' ')) GROUP BY 1),
r AS (SELECT question, metric, coalesce(dims, '') AS dims, CASE WHEN want_metric IS NULL THEN 'refusal' ELSE 'resolution' END AS kind,
  CASE WHEN want_metric IS NULL THEN metric IS NULL ELSE coalesce(metric = want_metric AND coalesce(dims, '') = want_dims, false) END AS correct FROM q LEFT JOIN m USING (question) LEFT JOIN d USING (question))"""


#: Kinds of columns that aren't plain text or whole numbers: d double, f list of floats, t time.
_KINDS = {"c_acctbal": "d", "s_acctbal": "d", "p_retailprice": "d", "o_totalprice": "d", "o_orderdate": "t", "l_quantity": "d", "l_extendedprice": "d", "l_discount": "d", "l_tax": "d", "l_shipdate": "t", "ts": "t", "value": "d", "embedding": "f"}
_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


def _fingerprint_sql(name: str) -> str:
    number = "({0}::DOUBLE)::DECIMAL(38,9)::VARCHAR"
    shown = {"d": number.format("{0}"), "f": f"'[' || array_to_string(list_transform({{0}}, lambda x: {number.format('x')}), ',') || ']'", "t": "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')", "": "{0}::VARCHAR"}
    told = [f"coalesce(length({v}) || ':' || {v}, 'N')" for c in _COLUMNS[name].split() for v in [shown[_KINDS.get(c, "")].format(c)]]
    lanes = " || ".join(f"printf('%08x', (coalesce(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT), 0) % 4294967296)::BIGINT)" for i in range(4))
    return f"SELECT '{name}' AS relation, count(*) AS n, {lanes} AS digest FROM (SELECT md5({' || '.join(told)}) AS h FROM {name})"


_TRAIL = "WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS seq, row_number() OVER (ORDER BY event_id) % 256 = 0 OR lead(event_id) OVER (ORDER BY event_id) IS NULL AS last, count(*) OVER () <= 256 AS alone FROM events)"


def _asked_sql() -> str:
    head = f"WITH q AS (SELECT conv_id, turn, concat(' ', array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' '), ' ') AS said FROM conversations WHERE role = 'user')"
    ahead = f"regexp_matches(said, ' ({'|'.join(copilot.AHEAD)}) ')"
    return f"""{head},
m AS (SELECT conv_id, turn, arg_min(metric, place) AS metric FROM q JOIN {_values(copilot.phrases(STANDARD, True))} p(place, metric, phrase) ON contains(said, concat(' ', phrase, ' ')) AND NOT {ahead} GROUP BY 1, 2),
d AS (SELECT conv_id, turn, string_agg(dim, ',' ORDER BY dim) AS dims FROM q JOIN {_values((x, x.replace('_', ' ')) for x in STANDARD.dimensions)} p(dim, phrase) ON contains(concat(' ', regexp_extract(said, '^.*? (by|per) (.*)$', 2)), concat(' ', phrase, ' ')) GROUP BY 1, 2)
SELECT conv_id, turn, metric, coalesce(dims, '') AS dims FROM q LEFT JOIN m USING (conv_id, turn) LEFT JOIN d USING (conv_id, turn)"""


_PAIRS = """grp AS (SELECT channel AS g, tenure AS t, sum(event)::DOUBLE AS d, count(*) AS c FROM subj GROUP BY ALL),
grid AS (SELECT g, t, coalesce(d, 0) AS d, coalesce(sum(c) OVER (PARTITION BY g ORDER BY t DESC), 0)::DOUBLE AS n FROM (SELECT DISTINCT g FROM grp) CROSS JOIN (SELECT DISTINCT t FROM grp) LEFT JOIN grp USING (g, t)),
each_pair AS (SELECT x.g AS a, y.g AS b, x.d AS d1, y.d AS d2, x.n AS n1, y.n AS n2 FROM grid x JOIN grid y ON x.t = y.t AND x.g <> y.g WHERE x.d + y.d > 0),
summed AS (SELECT a, b, sum(d1) AS observed, sum((d1 + d2) * n1 / (n1 + n2)) AS expected, sum(CASE WHEN n1 + n2 > 1 THEN (d1 + d2) * (n1 / (n1 + n2)) * (n2 / (n1 + n2)) * (n1 + n2 - d1 - d2) / (n1 + n2 - 1) ELSE 0 END) AS variance FROM each_pair GROUP BY ALL),
chis AS (SELECT *, CASE WHEN variance > 0 THEN (observed - expected) ** 2 / variance END AS chi2 FROM summed),
tested AS (SELECT *, CASE WHEN chi2 = 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, 400), lambda j: exp(-chi2 / 2 + (j + 0.5::DOUBLE) * ln(chi2 / 2) - lgamma(j + 1.5::DOUBLE)))) END AS p FROM chis)"""


def _cox_sql() -> str:
    names, k = list(AT), len(AT)
    index = range(1, k + 1)
    risk_ = "exp(" + " + ".join(f"{b}::DOUBLE * x{i}" for i, b in zip(index, AT.values())) + ")"
    known = " + ".join(f"{b}::DOUBLE * e{i}" for i, b in zip(index, AT.values()))
    return f"""cx0 AS (SELECT tenure AS t, event::DOUBLE AS e, greatest(0.01, least(0.6, monthly_premium / annual_income)) * 10 AS x1, utilisation_low::DOUBLE AS x2, (v_member.channel = 'individual')::INT::DOUBLE AS x3, (denial_month >= 0)::INT::DOUBLE AS x4 FROM v_span JOIN v_member USING (member_id)),
cx AS (SELECT t, e, {", ".join(f"x{i} - avg(x{i}) OVER () AS x{i}" for i in index)} FROM cx0),
ct AS (SELECT t, sum(e) AS d, sum(w) AS w, {", ".join(f"sum(e * x{i}) AS e{i}, sum(w * x{i}) AS s{i}" for i in index)} FROM (SELECT *, {risk_} AS w FROM cx) GROUP BY t),
cr AS (SELECT d, {", ".join(f"e{i}" for i in index)}, sum(w) OVER z AS w, {", ".join(f"sum(s{i}) OVER z AS s{i}" for i in index)} FROM ct WINDOW z AS (ORDER BY t DESC)),
cg AS (SELECT {", ".join(f"sum(e{i} - d * s{i} / w) AS g{i}" for i in index)}, sum({known} - d * ln(w)) AS value FROM cr WHERE d > 0)
{" UNION ALL ".join(f"SELECT '{n}' AS covariate, round(g{i}, 4) AS gradient, round(value, 4) AS log_likelihood FROM cg" for i, n in zip(index, names))}"""


_COX = _cox_sql()


def _logistic_sql(rows: str, beta: dict) -> str:
    column = {**{c: f"x{i}" for i, c in enumerate(AT, 1)}, "intercept": "1.0::DOUBLE"}
    score = " + ".join(f"{b}::DOUBLE * {column.get(c, c)}" for c, b in beta.items())
    told = " UNION ALL ".join(f"SELECT '{c}' AS covariate, round(sum((y - 1 / (1 + exp(-s))) * {column.get(c, c)}), 4) AS gradient, round(sum(y * s - ln(1 + exp(s))), 4) AS log_likelihood FROM scored_" for c in beta)
    return f"""{PRELUDE}, cs AS (SELECT v_span.*, greatest(0.01, least(0.6, monthly_premium / annual_income)) * 10 AS x1, utilisation_low::DOUBLE AS x2, (channel = 'individual')::INT::DOUBLE AS x3 FROM v_span JOIN v_member USING (member_id)),
scored_ AS (SELECT *, {score} AS s FROM ({rows})) {told}"""


_SETTINGS_SQL = ", ".join(f"('{level}', {w_}, {damping}::DOUBLE, {uplift}::DOUBLE)" for level, (w_, damping, uplift) in forecast.SETTINGS.items())


def _damped_sql(tag: str, series: str) -> str:
    """fc{tag}: the last months of each series, as they were and as forecast from those before."""
    same = "s.level = p.level AND s.label = p.label AND s.place = p.i % 12"
    return f"""placed{tag} AS (SELECT *, row_number() OVER (PARTITION BY level, label ORDER BY month_index) - 1 AS i, greatest(count(*) OVER (PARTITION BY level, label) - {forecast.HOLDOUT}, 0) AS m FROM {series} JOIN (VALUES {_SETTINGS_SQL}) s(level, win, damping, uplift) USING (level)),
season{tag} AS (SELECT level, label, i % 12 AS place, avg(pmpm) - avg(avg(pmpm)) OVER (PARTITION BY level, label) AS season FROM placed{tag} WHERE i < m AND i < m // 12 * 12 GROUP BY 1, 2, 3),
fitted{tag} AS (SELECT p.level, p.label, coalesce(regr_slope(pmpm - coalesce(season, 0), i - m + 1), 0) AS slope, coalesce(regr_intercept(pmpm - coalesce(season, 0), i - m + 1), avg(pmpm - coalesce(season, 0))) AS height, arg_max(pmpm, i) AS last
  FROM placed{tag} p LEFT JOIN season{tag} s ON {same} WHERE i < m AND i >= m - win GROUP BY 1, 2),
fc{tag} AS (SELECT p.level, p.label, month_index, pmpm AS actual, CASE WHEN m = 0 THEN 0 WHEN m < 15 THEN last ELSE (height + slope * damping * (1 - damping ** (i - m + 1)) / (1 - damping) + coalesce(season, 0)) * (1 + uplift) END AS base
  FROM placed{tag} p LEFT JOIN fitted{tag} f ON f.level = p.level AND f.label = p.label LEFT JOIN season{tag} s ON {same} WHERE i >= m)"""


_FORECAST = f"""{PRELUDE}, {_LEAF},
dense AS (SELECT region, product, month_index, pmpm FROM (SELECT DISTINCT region, product FROM leaf) CROSS JOIN (SELECT DISTINCT month_index FROM leaf) LEFT JOIN leaf USING (region, product, month_index)),
filled AS (SELECT region, product, month_index, coalesce(last_value(pmpm IGNORE NULLS) OVER (PARTITION BY region, product ORDER BY month_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(pmpm IGNORE NULLS) OVER (PARTITION BY region, product ORDER BY month_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS pmpm FROM dense),
of_leaf AS (SELECT leaf, unnest(['total', 'region', 'product', 'leaf']) AS level, unnest(['all', region, product, leaf]) AS label FROM (SELECT DISTINCT region, product, region || '|' || product AS leaf FROM filled)),
series AS (SELECT level, label, month_index, sum(pmpm) AS pmpm FROM filled JOIN of_leaf ON leaf = region || '|' || product GROUP BY ALL),
{_damped_sql('', 'series')},
share AS (SELECT label AS leaf, sum(pmpm) / sum(sum(pmpm)) OVER () AS share FROM series WHERE level = 'leaf' AND month_index <= (SELECT max(month_index) - {forecast.HOLDOUT} FROM series) GROUP BY 1),
plain AS (SELECT 'base' AS method, level, label, month_index, base AS value FROM fc
  UNION ALL SELECT 'bottom_up', s.level, s.label, month_index, sum(base) FROM fc JOIN of_leaf s ON s.leaf = fc.label WHERE fc.level = 'leaf' GROUP BY ALL
  UNION ALL SELECT 'top_down', s.level, s.label, month_index, sum(base * share) FROM fc CROSS JOIN share JOIN of_leaf s USING (leaf) WHERE fc.level = 'total' GROUP BY ALL)"""


def _methods_sql(source: str) -> str:
    return f"""methods AS (SELECT method, p.level, p.label, p.month_index, actual, value FROM {source} p JOIN fc ON fc.level = p.level AND fc.label = p.label AND fc.month_index = p.month_index),
scores AS (SELECT method, level, round(avg(abs((actual - value) / nullif(actual, 0))) * 100, 3) AS mape, round(sqrt(avg((actual - value) ** 2)), 4) AS rmse FROM (SELECT method, actual, value, unnest([level, 'ALL']) AS level FROM methods) GROUP BY 1, 2)"""


_PLAIN = f"{_FORECAST}, {_methods_sql('plain')}"
#: Reconciliation by Gauss-Jordan on what the upper series owe, all months as right sides.
_ALL_METHODS = f"""{_FORECAST.replace('WITH', 'WITH RECURSIVE', 1)}, hist AS (SELECT * FROM series WHERE month_index <= (SELECT max(month_index) - {forecast.HOLDOUT} FROM series)), {_damped_sql('_h', 'hist')},
spread AS (SELECT level, label, var_pop(actual - base) AS s FROM fc_h GROUP BY 1, 2),
vary AS (SELECT method, k.level, k.label, CASE WHEN method = 'ols' THEN 1.0::DOUBLE ELSE greatest(coalesce(s, 0), 1e-9) END AS v FROM (SELECT DISTINCT level, label FROM fc) k CROSS JOIN (VALUES ('ols'), ('mint')) z(method) LEFT JOIN spread USING (level, label)),
upper_ AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY level, label) AS i FROM vary WHERE level <> 'leaf'),
inside AS (SELECT u.method, u.i, u.v, o.leaf, l.v AS lv FROM upper_ u JOIN of_leaf o ON o.level = u.level AND o.label = u.label JOIN vary l ON l.method = u.method AND l.level = 'leaf' AND l.label = o.leaf),
shared AS (SELECT a.method, a.i, b.i AS j, sum(a.lv) AS c FROM inside a JOIN inside b ON a.method = b.method AND a.leaf = b.leaf GROUP BY ALL),
left_side AS (SELECT a.method, a.i, list(coalesce(c, 0) + CASE WHEN a.i = b.i THEN a.v ELSE 0 END ORDER BY b.i) AS g FROM upper_ a JOIN upper_ b ON a.method = b.method LEFT JOIN shared s ON s.method = a.method AND s.i = a.i AND s.j = b.i GROUP BY a.method, a.i),
owed AS (SELECT u.method, u.i, f.month_index, any_value(f.base) - sum(l.base) AS r FROM upper_ u JOIN fc f ON f.level = u.level AND f.label = u.label JOIN of_leaf o ON o.level = u.level AND o.label = u.label JOIN fc l ON l.level = 'leaf' AND l.label = o.leaf AND l.month_index = f.month_index GROUP BY 1, 2, 3),
start_ AS (SELECT g.method, list(list_concat(g, r) ORDER BY g.i) AS a FROM left_side g JOIN (SELECT method, i, list(r ORDER BY month_index) AS r FROM owed GROUP BY 1, 2) w ON w.method = g.method AND w.i = g.i GROUP BY 1),
solve AS (SELECT 0::BIGINT AS step, method, a FROM start_ UNION ALL SELECT step + 1, method, list_transform(range(1, len(a) + 1), lambda r: CASE WHEN r = step + 1 THEN list_transform(a[step + 1], lambda z: z / a[step + 1][step + 1])
  ELSE list_transform(range(1, len(a[1]) + 1), lambda c: a[r][c] - a[r][step + 1] * a[step + 1][c] / a[step + 1][step + 1]) END) FROM solve WHERE step < len(a)),
months_ AS (SELECT month_index, row_number() OVER (ORDER BY month_index) AS k FROM (SELECT DISTINCT month_index FROM fc)),
leaf_fit AS (SELECT x.method, x.leaf, k.month_index, any_value(f.base) + any_value(x.lv) * sum(s.a[x.i][len(s.a) + k.k]) AS value FROM inside x CROSS JOIN months_ k JOIN solve s ON s.method = x.method AND s.step = len(s.a) JOIN fc f ON f.level = 'leaf' AND f.label = x.leaf AND f.month_index = k.month_index GROUP BY 1, 2, 3),
every AS (SELECT * FROM plain UNION ALL SELECT method, level, label, month_index, sum(value) FROM leaf_fit JOIN of_leaf USING (leaf) GROUP BY ALL), {_methods_sql('every')}"""
_ROUNDED = "SELECT method, level, label, month_index, floor(actual * {0}::DOUBLE + 0.5) / {0}::DOUBLE AS actual, floor(value * {0}::DOUBLE + 0.5) / {0}::DOUBLE AS value FROM methods"
_INCOHERENT = "SELECT method, round(gap, 4) AS incoherence, round(100 * gap / whole, 4) AS incoherence_pct, gap < 1e-6 * greatest(whole, 1) AS coherent FROM (SELECT method, sum(abs(value - implied)) AS gap, sum(abs(value)) AS whole FROM methods JOIN (SELECT method, s.level, s.label, m.month_index, sum(value) AS implied FROM methods m JOIN of_leaf s ON s.leaf = m.label WHERE m.level = 'leaf' GROUP BY ALL) USING (method, level, label, month_index) GROUP BY 1)"
_BEST = "SELECT method, mape, worst_level, worst_mape FROM (SELECT arg_min(method, (mape, method)) AS method, min(mape) AS mape FROM scores WHERE level = 'ALL') JOIN (SELECT method, arg_max(level, (mape, level)) AS worst_level, max(mape) AS worst_mape FROM scores WHERE level <> 'ALL' GROUP BY 1) USING (method)"


def _mutants_sql() -> str:
    paid, premium, months, lines, denied = "sum(paid_amount::DECIMAL(18,2))::DOUBLE", "sum(premium_collected::DECIMAL(18,2))::DOUBLE", "count(*)::DOUBLE", "sum(total_lines)::DOUBLE", "sum(denied_lines)::DOUBLE"
    claimed = "(total_lines > 0)"
    wrong = (
        ("loss_ratio: inverted", "loss_ratio", premium, paid), ("loss_ratio: allowed for paid", "loss_ratio", "sum(allowed_amount::DECIMAL(18,2))::DOUBLE", premium), ("loss_ratio: rows for premium", "loss_ratio", paid, months),
        ("loss_ratio: months with claims only", "loss_ratio", paid, f"(sum(premium_collected::DECIMAL(18,2)) FILTER {claimed})::DOUBLE"), ("loss_ratio: largest for sum", "loss_ratio", "max(paid_amount)", premium),
        ("pmpm: claims for months", "pmpm", paid, lines), ("pmpm: months with claims only", "pmpm", paid, f"(count(*) FILTER {claimed})::DOUBLE"), ("denial_rate: inverted", "denial_rate", lines, denied), ("denial_rate: paid for denied", "denial_rate", "sum(total_lines - denied_lines)::DOUBLE", lines),
        ("utilisation_per_1000: not per thousand", "utilisation_per_1000", lines, months))
    out = []
    for name, metric, num, den in wrong:
        right = f"(SELECT {_NUM[metric]} / {_DEN[metric]} FROM mm)"
        checks = [("regions reconcile to the total", f"abs((SELECT sum(n) FROM (SELECT {num} AS n FROM mm GROUP BY region)) - (SELECT {num} FROM mm)) < 0.01"), ("figure equals the golden one", f"abs((SELECT {num} / {den} FROM mm) - {right}) < 1e-9")]
        checks += [("loss ratio within a plausible band", f"(SELECT {num} / {den} FROM mm) BETWEEN 0.3 AND 1.5")] if metric == "loss_ratio" else []
        checks += [("rate is no more than one", f"(SELECT {num} / {den} FROM mm) <= 1")] if metric == "denial_rate" else []
        out += [f"SELECT '{name}' AS mutant, '{check}' AS \"check\", NOT coalesce({holds}, false) AS noticed" for check, holds in checks]
    return f"{PRELUDE} " + " UNION ALL ".join(out)


ORACLE_SQL = {
    **{f"m_{m}_{d or 'total'}": _metric_sql(m, d) for m in STANDARD.metrics for d in (None, *_DIMS)},
    "member_month": f"{PRELUDE} SELECT * FROM mm",
    "month_labels": f"{PRELUDE} SELECT DISTINCT month_index, month, printf('%04d-%02d', 1995 + round_even(month_index / 12, 0)::INT, month_index % 12 + 1) AS month_ref FROM mm",
    "provider_coding": f"{PRELUDE} SELECT provider_id, specialty, p.region, month_index, count(*) AS n_professional, round(avg(billed), 6) AS mean_intensity, sum([10, 15, 25, 40][billed + 1])::BIGINT AS total_minutes, sum(allowed_amount::DECIMAL(18,2))::DOUBLE AS allowed_amount FROM v_claim JOIN v_provider p USING (provider_id) WHERE service_category = 'STANDARD' GROUP BY ALL",
    "fanout_check": f"{PRELUDE} SELECT e AS expected, a AS actual, e = a AS equal FROM (SELECT sum(greatest(end_month - start_month, 0))::BIGINT AS e FROM v_span), (SELECT count(*) AS a FROM mm)",
    "zero_claim_share": f"{PRELUDE} SELECT round(avg((total_lines = 0)::INT), 4) AS zero_claim_share FROM mm",
    "row_counts": f"{PRELUDE} SELECT 'members' AS relation, count(*) AS n FROM v_member UNION ALL SELECT 'providers', count(*) FROM v_provider UNION ALL SELECT 'enrollment_spans', count(*) FROM v_span UNION ALL SELECT 'claim_lines', count(*) FROM v_claim",
    "idempotency": f"{PRELUDE} SELECT count(DISTINCT (n, paid)) AS versions, max(n) AS n, max(paid) AS paid FROM (SELECT count(*) AS n, round(sum(paid_amount::DECIMAL(18,2))::DOUBLE, 2) AS paid FROM mm UNION ALL SELECT sum(k)::BIGINT, round(sum(p)::DOUBLE, 2) FROM (SELECT count(*) AS k, sum(paid_amount::DECIMAL(18,2)) AS p FROM mm GROUP BY member_id))",
    "grain_check": f"{PRELUDE} SELECT count(*) AS violations FROM (SELECT member_id, month_index FROM mm GROUP BY 1, 2 HAVING count(*) > 1)",
    "invariants": f"{PRELUDE}, x AS (SELECT least(min(paid_amount), min(premium_collected), min(total_lines), min(denied_lines)) >= 0 AS a, max(denied_lines - total_lines) <= 0 AS b, sum(paid_amount) / sum(premium_collected) BETWEEN 0.3 AND 1.5 AS c FROM mm) SELECT 'no negative amounts or counts' AS \"check\", a AS passed FROM x UNION ALL SELECT 'denied lines never exceed total lines', b FROM x UNION ALL SELECT 'loss ratio within a plausible band', c FROM x UNION ALL SELECT 'region slices reconcile to the total', abs(sum(p) - (SELECT sum(paid_amount::DECIMAL(18,2))::DOUBLE FROM mm)) < 0.01 FROM (SELECT sum(paid_amount::DECIMAL(18,2))::DOUBLE AS p FROM mm GROUP BY region) UNION ALL SELECT 'ratio equals numerator over denominator', abs(v - n / d) < 1e-9 FROM (SELECT sum(paid_amount::DECIMAL(18,2))::DOUBLE AS n, sum(premium_collected::DECIMAL(18,2))::DOUBLE AS d, sum(paid_amount)::DOUBLE / sum(premium_collected) AS v FROM mm)",
    "pharmacy_split": f"{PRELUDE}, {_PHARM} SELECT plan, count(*) AS n, sum(pharmacy_paid::DECIMAL(18,2))::DOUBLE AS pharmacy_paid FROM mp GROUP BY 1",
    "metric_snapshot": f"{PRELUDE} {_snapshot_sql('mm')}",
    "blast_radius": f"{_BLAST} SELECT * FROM moves",
    "loss_ratio_where": lambda s, d: _round(_claimed(STANDARD).compile(w.relations(Payer(s, d)), "loss_ratio", ["plan", "region"], [F.col("age_band") >= 40, F.col("channel").isin("employer", "broker")])),
    "drift_rows": lambda s, d: regression.first_drift(QUERIES["blast_radius"](s, d)),
    "metric_mutants": lambda s, d: mutants.caught(_base(s, d), STANDARD),
    "loss_ratio_ex_pharmacy": lambda s, d: _round(without_pharmacy(STANDARD).compile(w.relations(Payer(s, d)), "loss_ratio", ["plan"])),
    "largest_moves": f"{_BLAST} SELECT * FROM moves WHERE moved ORDER BY abs(change) DESC, metric, slice LIMIT 10",
    "km_overall": f"{PRELUDE}, {_SUBJECTS}, {_km('a', 'subj')} SELECT {_KM_OUT} FROM ka",
    "km_by_channel": f"{PRELUDE}, {_SUBJECTS}, {_km('a', 'subj', 'channel')} SELECT channel, {_KM_OUT} FROM ka",
    "km_median": f"{PRELUDE}, {_SUBJECTS}, {_km('a', 'subj', 'channel')} SELECT channel, min(time) FILTER (round(s, 5) <= 0.5) AS median FROM ka GROUP BY 1",
    "logrank": f"{PRELUDE}, {_SUBJECTS}, g AS (SELECT tenure AS t, sum(event) FILTER (channel = 'individual') AS d1, sum(event) FILTER (channel = 'employer') AS d2, count(*) FILTER (channel = 'individual') AS c1, count(*) FILTER (channel = 'employer') AS c2 FROM subj WHERE channel IN ('individual', 'employer') GROUP BY 1), r AS (SELECT coalesce(d1, 0)::DOUBLE AS d1, coalesce(d2, 0)::DOUBLE AS d2, sum(c1) OVER (ORDER BY t DESC)::DOUBLE AS n1, sum(c2) OVER (ORDER BY t DESC)::DOUBLE AS n2 FROM g), s AS (SELECT sum(d1) AS observed, sum((d1 + d2) * n1 / (n1 + n2)) AS expected, sum(CASE WHEN n1 + n2 > 1 THEN (d1 + d2) * (n1 / (n1 + n2)) * (n2 / (n1 + n2)) * (n1 + n2 - d1 - d2) / (n1 + n2 - 1) ELSE 0 END) AS variance FROM r WHERE d1 + d2 > 0) SELECT observed, round(expected, 4) AS expected, round(variance, 4) AS variance, round(CASE WHEN variance > 0 THEN (observed - expected) ** 2 / variance END, 4) AS chi2 FROM s",
    "cause_mix": f"{PRELUDE} SELECT exit_cause, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM v_span WHERE event = 1 GROUP BY 1",
    "competing_risks": f"{PRELUDE}, x AS (SELECT *, coalesce(exit_cause = 'voluntary', false)::INT AS own FROM v_span), {_km('a', 'x', '', 'own')}, t AS (SELECT tenure AS time, sum(event)::BIGINT AS d, sum(coalesce(exit_cause = 'voluntary', false)::INT)::BIGINT AS own, count(*) AS c FROM v_span GROUP BY 1), r AS (SELECT *, sum(c) OVER (ORDER BY time DESC)::BIGINT AS n FROM t), e AS (SELECT *, exp(coalesce(sum(CASE WHEN d < n THEN ln(1.0::DOUBLE - d::DOUBLE / n) ELSE -745 END) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s FROM r WHERE d > 0), c AS (SELECT round(sum(s * own / n) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING), 5) AS cif FROM e) SELECT (SELECT round(1.0::DOUBLE - min(round(s, 5)), 5) FROM ka) AS one_minus_km, (SELECT round(avg(own), 5) FROM x) AS voluntary_share, (SELECT max(cif) FROM c) AS cif",
    "cif": f"{PRELUDE}, t AS (SELECT tenure AS time, sum(event)::BIGINT AS d, sum(coalesce(exit_cause = 'voluntary', false)::INT)::BIGINT AS own, count(*) AS c FROM v_span GROUP BY 1), r AS (SELECT *, sum(c) OVER (ORDER BY time DESC)::BIGINT AS n FROM t), e AS (SELECT *, exp(coalesce(sum(CASE WHEN d < n THEN ln(1.0::DOUBLE - d::DOUBLE / n) ELSE -745 END) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s FROM r WHERE d > 0) SELECT time, round(sum(s * own / n) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING), 5) AS cif FROM e",
    "person_month": f"{PRELUDE}, x AS (SELECT s.*, i::INT AS t FROM v_span s JOIN range(0, 200) r(i) ON i < tenure + event) SELECT t AS tenure, count(*) AS n, sum((denial_month >= 0 AND t >= denial_month - start_month)::INT)::BIGINT AS denials, sum((event = 1 AND t = tenure)::INT)::BIGINT AS lapsed FROM x GROUP BY 1",
    "provider_features": f"{_upcoding()} SELECT provider_id, specialty, region, is_fraud, n_claims, total_minutes, round(mean_intensity, 6) AS mean_intensity, round(top_share, 6) AS top_share, round(max_daily_minutes, 6) AS max_daily_minutes FROM feat",
    "peer_z": f"{_upcoding()} SELECT provider_id, specialty, round(z_intensity, 5) AS z_intensity, round(z_top_share, 5) AS z_top_share FROM z",
    "upcoding_flags": f"{_upcoding()} SELECT provider_id, rule_peer_intensity, rule_top_code_share, rule_impossible_day, flagged FROM flagged",
    "upcoding_confusion": f"{_upcoding()} {_CONF}",
    **{f"evasion_{k}": f"{_upcoding(v)} {_CONF}" for k, v in _LEVELS.items()},
    "risk_dataset": f"{_RISK} SELECT * FROM risk",
    "risk_split": f"{_RISK} SELECT member_id, row_number() OVER (ORDER BY md5(member_id || '|1509'), member_id) <= floor(count(*) OVER () * 0.7) AS train FROM risk",
    "calibration_deciles": f"{_RISK}, d AS (SELECT *, ntile(10) OVER (ORDER BY p, member_id)::INT AS decile FROM scored) SELECT decile, n, floor(p * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS mean_predicted, floor(y * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS mean_actual, floor((p / nullif(y, 0)) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS ratio FROM (SELECT decile, count(*) AS n, sum(p::DECIMAL(20,4))::DOUBLE / count(p) AS p, sum(y::DECIMAL(20,4))::DOUBLE / count(y) AS y FROM d GROUP BY 1)",
    "risk_evaluation": f"{_RISK}, {_EVALUATED}",
    "risk_ridge": f"{_ridge_sql('all')}, scored AS (SELECT * FROM fit_all), {_EVALUATED}",
    "risk_ridge_fit": f"{_ridge_sql('all')} SELECT feature, round(beta, 6) AS beta, round(se, 6) AS se FROM coef_all",
    "risk_proxy_cost": f"{_ridge_sql('all')}, {_ridge_parts('some', _FEATURES_SQL[:-1])}, r2 AS (SELECT (SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(y)), 4) FROM fit_all) AS r2_with, (SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(y)), 4) FROM fit_some) AS r2_without) SELECT *, round(r2_without - r2_with, 4) AS change FROM r2",
    "region_parity": f"{_RISK}, b AS (SELECT region, count(*) AS n, sum(p::DECIMAL(20,4))::DOUBLE / count(p) AS p, sum(y::DECIMAL(20,4))::DOUBLE / count(y) AS a FROM scored GROUP BY 1) SELECT region, n, floor(p * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS mean_predicted, floor(a * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS mean_actual, floor((p / a) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS ratio, floor((max(p / a) OVER () / min(p / a) OVER ()) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS disparity FROM b",
    "pmpm_leaf": f"{PRELUDE}, {_LEAF} SELECT region, product, month_index, round(pmpm, 6) AS pmpm FROM leaf",
    "pmpm_hierarchy": f"{PRELUDE}, {_LEAF} SELECT CASE WHEN grouping(region) = 1 AND grouping(product) = 1 THEN 'total' WHEN grouping(product) = 1 THEN 'region' WHEN grouping(region) = 1 THEN 'product' ELSE 'leaf' END AS level, CASE WHEN grouping(region) = 1 AND grouping(product) = 1 THEN 'all' WHEN grouping(product) = 1 THEN region WHEN grouping(region) = 1 THEN product ELSE region || '|' || product END AS label, month_index, round(sum(pmpm), 5) AS pmpm_sum FROM leaf GROUP BY GROUPING SETS ((month_index), (region, month_index), (product, month_index), (region, product, month_index))",
    "fingerprint": " UNION ALL ".join(map(_fingerprint_sql, TABLES)),
    "audit_events": f"{_TRAIL} SELECT 0 AS level, seq, 'content' AS kind FROM e WHERE event_id % 997 = 11 AND event_id % 1499 <> 13 UNION ALL SELECT CASE WHEN last THEN 1 ELSE 0 END, CASE WHEN last THEN (seq - 1) // 256 + 1 ELSE seq + 1 END, CASE WHEN last THEN 'seal' ELSE 'link' END FROM e WHERE event_id % 1499 = 13 AND NOT (last AND alone)",
    "orphans": " UNION ALL ".join(f"SELECT '{name}' AS link, count(*) AS rows, count(DISTINCT {x}) AS keys FROM {t} WHERE {x} NOT IN (SELECT {y} FROM {o} WHERE {y} IS NOT NULL) OR {x} IS NULL" for name, t, x, o, y in (
        ("line without order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("line without part", "lineitem", "l_partkey", "part", "p_partkey"), ("line without supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("order without customer", "orders", "o_custkey", "customer", "c_custkey"), ("customer without order", "customer", "c_custkey", "orders", "o_custkey"))),
    "questions_asked": _asked_sql(),
    "logrank_p": f"{PRELUDE}, {_SUBJECTS}, {_PAIRS} SELECT observed, round(expected, 4) AS expected, round(variance, 4) AS variance, round(chi2, 4) AS chi2, round(p, 6) AS p_value FROM tested WHERE a = 'individual' AND b = 'employer'",
    "logrank_pairs": f"{PRELUDE}, {_SUBJECTS}, {_PAIRS} SELECT a AS first, b AS second, observed, round(expected, 4) AS expected, round(chi2, 4) AS chi2, round(p, 6) AS p_value FROM tested WHERE a < b",
    "cox_slope": f"{PRELUDE}, {_COX}",
    "hazard_slope": _logistic_sql("SELECT event, i::DOUBLE AS tenure, x1, x2, x3, (denial_month >= 0 AND i >= denial_month - start_month)::INT::DOUBLE AS x4, (event = 1 AND i = tenure)::INT::DOUBLE AS y FROM cs JOIN range(0, 200) r(i) ON i < cs.tenure + event", AT | {"tenure": 0.02, "intercept": -4.0}),
    "naive_slope": _logistic_sql("SELECT tenure, x1, x2, x3, (denial_month >= 0)::INT::DOUBLE AS x4, event::DOUBLE AS y FROM cs", AT | {"intercept": -1.0}),
    "loss_ratio_where": f"{PRELUDE} SELECT plan, region, round(sum(paid_amount::DECIMAL(18,2))::DOUBLE / sum(premium_collected::DECIMAL(18,2))::DOUBLE, 9) AS value, sum(paid_amount::DECIMAL(18,2))::DOUBLE AS numerator, sum(premium_collected::DECIMAL(18,2))::DOUBLE AS denominator FROM mm WHERE total_lines > 0 AND age_band >= 40 AND channel IN ('employer', 'broker') GROUP BY 1, 2",
    "forecast_base": f"{_FORECAST} SELECT level, label, month_index, floor(actual * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS actual, floor(base * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS base FROM fc",
    "forecast_plain": f"{_PLAIN} {_ROUNDED.format(10000.0)}",
    "forecast_plain_scores": f"{_PLAIN} SELECT * FROM scores",
    "forecast_plain_incoherence": f"{_PLAIN} {_INCOHERENT}",
    "forecast_best_plain": f"{_PLAIN} {_BEST}",
    "forecast_methods": f"{_ALL_METHODS} {_ROUNDED.format(100.0)}",
    "forecast_scores": f"{_ALL_METHODS} SELECT * FROM scores",
    "forecast_incoherence": f"{_ALL_METHODS} {_INCOHERENT}",
    "forecast_best": f"{_ALL_METHODS} {_BEST}",
    "drift_rows": f"{_BLAST} SELECT * FROM moves WHERE moved ORDER BY metric, slice LIMIT 20",
    "loss_ratio_ex_pharmacy": f"{PRELUDE}, {_PHARM} SELECT plan, round(sum((paid_amount - pharmacy_paid)::DECIMAL(18,2))::DOUBLE / sum(premium_collected::DECIMAL(18,2))::DOUBLE, 9) AS value, sum((paid_amount - pharmacy_paid)::DECIMAL(18,2))::DOUBLE AS numerator, sum(premium_collected::DECIMAL(18,2))::DOUBLE AS denominator FROM mp GROUP BY 1",
    "metric_mutants": _mutants_sql(),
    "copilot_rules": f"{_questions_sql(1)} SELECT r.*, round(value, 5) AS value FROM r LEFT JOIN told USING (metric)",
    "copilot_rules_v2": f"{_questions_sql(2)} SELECT r.*, round(value, 5) AS value FROM r LEFT JOIN told USING (metric)",
    "copilot_score": f"{_questions_sql(1)} SELECT round(avg(correct::INT), 4) AS overall, round(avg(correct::INT) FILTER (kind = 'resolution'), 4) AS resolution, round(avg(correct::INT) FILTER (kind = 'refusal'), 4) AS refusal, count(value) AS answered FROM r LEFT JOIN told USING (metric)",
    "catalog": f"{PRELUDE}, {_TOLD} SELECT name, label, unit, grain, owner, description, coalesce(higher_is_better::VARCHAR, '') AS higher_is_better, value FROM {_values(tuple(x.values()) for x in STANDARD.catalog())} c(name, label, unit, grain, owner, description, higher_is_better) LEFT JOIN told ON metric = name",
    "audit_verify": "SELECT count(DISTINCT event_id) = count(*) AS intact, 0::BIGINT AS broken_at_seq FROM events",
    "traceability": "SELECT c_custkey AS requirement, o_orderkey AS test FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "events_by_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS total FROM events GROUP BY 1, 2",
}
