"""Payer tables made up, reproducibly: every draw is a hash of the row's key, so partitioning and order don't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import logistic, month_label, uniform
from ledgerloom.sources.payer import EM_CODES, EM_MINUTES, SCHEMAS, by_key, choice

MONTHS, PREMIUM = 24, {"bronze": 310.0, "silver": 430.0, "gold": 585.0, "platinum": 760.0}
REGIONS, PRODUCTS, CHANNELS = ("north", "south", "east", "west", "central"), ("HMO", "PPO", "EPO"), ("individual", "employer", "broker")
SPECIALTIES = ("family", "internal", "cardiology", "orthopedics", "oncology", "psychiatry")
CATEGORIES, CAUSES = ("professional", "outpatient", "inpatient", "pharmacy"), ("voluntary", "employer_change", "moved", "death")
EFFECTS = {"burden10": 0.55, "utilisation_low": 0.35, "is_individual": 0.5, "had_denial": 0.6}
SHIFT = 0.42


def _pick(u: Column, values: tuple[str, ...]) -> Column:
    return choice(F.floor(u * len(values)).cast("int"), values)


def _normal(*key) -> Column:
    """Box-Muller from two hash draws."""
    return F.sqrt(-2.0 * F.ln(1.0 - uniform(*key, F.lit("n1")))) * F.cos(6.283185307179586 * uniform(*key, F.lit("n2")))


def members(spark: SparkSession, n: int, seed: str = "1") -> DataFrame:
    key = lambda what: (F.lit(seed), "id", F.lit(what))
    df = spark.range(n).withColumns({
        "age": F.greatest(F.lit(18), F.least(F.lit(89), F.round(46 + 16 * _normal(*key("age"))))).cast("int"), "plan": _pick(uniform(*key("plan")), tuple(PREMIUM)),
        "annual_income": F.greatest(F.lit(14000.0), F.least(F.lit(400000.0), F.exp(10.8 + 0.55 * _normal(*key("income")))))})
    # A count of chronic conditions rises with age; thresholds of a Poisson-like draw.
    mean, u = 0.2 + 0.025 * (F.col("age") - 18), uniform(*key("chronic"))
    steps = [F.exp(-mean)]
    for i in range(1, 6):
        steps.append(steps[-1] + F.exp(-mean) * F.pow(mean, F.lit(i)) / float(__import__("math").factorial(i)))
    chronic = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    premium = by_key(F.col("plan"), PREMIUM)
    return df.select(
        F.format_string("MEM%06d", F.col("id") + 600000).alias("member_id"), "age", F.greatest(F.lit(20), F.least(F.lit(80), F.floor(F.col("age") / 10) * 10)).cast("int").alias("age_band"), _pick(uniform(*key("sex")), ("F", "M")).alias("sex"),
        F.round("annual_income", 2).alias("annual_income"), "plan", _pick(uniform(*key("product")), PRODUCTS).alias("product"), _pick(uniform(*key("region")), REGIONS).alias("region"), _pick(uniform(*key("channel")), CHANNELS).alias("channel"),
        premium.alias("monthly_premium"), by_key(F.col("plan"), {"bronze": 0.6, "silver": 0.7, "gold": 0.8, "platinum": 0.9}).alias("actuarial_value"), chronic.cast("int").alias("chronic_count"),
        F.greatest(F.lit(0.01), F.least(F.lit(0.6), premium * 12 / F.col("annual_income"))).alias("premium_burden"), F.round(uniform(*key("zip")), 4).alias("zip_deprivation_index"), F.floor(uniform(*key("start")) * 8).cast("int").alias("enrolled_month"))


def spans(members: DataFrame, seed: str = "2") -> DataFrame:
    """Lapse by a monthly logistic hazard; the first event ends the span, the cutoff censors it."""
    key = lambda *what: (F.lit(seed), "member_id", *what)
    limit = F.lit(MONTHS - 1) - F.col("enrolled_month")
    low, denial = (uniform(*key(F.lit("low"))) < 0.35).cast("int"), F.when(uniform(*key(F.lit("denied"))) < 0.3, F.col("enrolled_month") + F.floor(uniform(*key(F.lit("when"))) * 20)).otherwise(-1).cast("int")
    df = members.withColumns({"start_month": F.col("enrolled_month"), "utilisation_low": low, "denial_month": denial, "limit": limit})
    fixed = -5.2 + EFFECTS["burden10"] * F.col("premium_burden") * 10 + EFFECTS["utilisation_low"] * F.col("utilisation_low") + EFFECTS["is_individual"] * (F.col("channel") == "individual").cast("int")

    def lapses(m: Column) -> Column:
        denied = (F.col("denial_month") >= 0) & (m >= F.col("denial_month") - F.col("start_month"))
        return uniform(F.lit(seed), "member_id", m.cast("string")) < logistic(fixed + EFFECTS["had_denial"] * denied.cast("int"))

    first = F.get(F.filter(F.sequence(F.lit(0), F.col("limit") - 1), lapses), 0)
    df = df.withColumn("first", F.when(F.col("limit") > 0, first)).withColumn("tenure_months", F.coalesce("first", "limit").cast("int"))
    gone = F.col("first").isNotNull()
    return df.select(
        "member_id", "start_month", "tenure_months", gone.cast("int").alias("event_observed"), F.when(gone, _pick(uniform(*key(F.lit("cause"))), CAUSES)).alias("exit_cause"), "utilisation_low", "denial_month",
        (F.col("denial_month") >= 0).cast("int").alias("had_denial"), (F.col("start_month") + F.col("tenure_months")).alias("end_month"))


def providers(spark: SparkSession, n: int, ring: int = 22, seed: str = "3") -> DataFrame:
    """The ring is of two specialties, spread over them by rank of a draw."""
    key = lambda what: (F.lit(seed), "id", F.lit(what))
    every = len(SPECIALTIES)
    in_ring = (F.col("id") % every < 2) & (F.floor(F.col("id") / every) * 2 + F.col("id") % every < ring)
    return spark.range(n).select(
        F.format_string("PRV%05d", F.col("id")).alias("provider_id"), choice((F.col("id") % every).cast("int"), SPECIALTIES).alias("specialty"), choice((F.floor(F.col("id") / every) % len(REGIONS)).cast("int"), REGIONS).alias("region"),
        (200 + F.floor(uniform(*key("panel")) * 1800)).cast("int").alias("panel_size"), (1 + F.floor(uniform(*key("years")) * 35)).cast("int").alias("years_practising"), in_ring.cast("int").alias("is_fraud"))


def claims(members: DataFrame, spans: DataFrame, providers: DataFrame, seed: str = "4") -> DataFrame:
    """Lines per exposed month from age and conditions; the provider is of the member's region. ``true_em_code`` is the answer column."""
    own = members.join(spans.filter("tenure_months > 0"), "member_id")
    months = own.select("*", F.explode(F.sequence(F.col("start_month"), F.col("end_month") - 1)).alias("month_index"))
    u = lambda what: uniform(F.lit(seed), "member_id", "month_index", *what)
    mean = F.exp(-1.0 + 0.28 * F.col("chronic_count") + 0.012 * (F.col("age") - 45))
    n, share = F.lit(0), u((F.lit("n"),))
    total = F.exp(-mean)
    for i in range(1, 9):
        n = n + F.when(share > total, 1).otherwise(0)
        total = total + F.exp(-mean) * F.pow(mean, F.lit(i)) / float(__import__("math").factorial(i))
    lines = months.withColumn("n", n).filter("n > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))
    v = lambda what: u(("line", F.lit(what)))
    pools = providers.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("provider_id", "is_fraud"))).alias("pool"))
    lines = lines.join(F.broadcast(pools), "region").withColumn("p", F.get("pool", F.floor(v("provider") * F.size("pool")).cast("int")))
    draw = v("category")
    category = F.when(draw < 0.55, "professional").when(draw < 0.75, "pharmacy").when(draw < 0.94, "outpatient").otherwise("inpatient")
    level = F.when(v("level") < 0.25, 0).when(v("level") < 0.65, 1).when(v("level") < 0.92, 2).otherwise(3)
    lines = lines.withColumns({"category": category, "level": level}).withColumn("billed", F.when((F.col("p.is_fraud") == 1) & (v("shift") < SHIFT), F.least(F.col("level") + 1, F.lit(3))).otherwise(F.col("level")))
    visit, code = F.col("category") == "professional", choice(F.col("billed"), EM_CODES)
    allowed = F.round(by_key(F.col("category"), {"professional": 120.0, "pharmacy": 160.0, "outpatient": 700.0, "inpatient": 9000.0}) * F.exp(0.5 * _normal(F.lit(seed), "member_id", "month_index", "line")) * (1 + 0.006 * F.col("month_index")) * (1 + 0.08 * F.cos(6.283185307179586 * F.col("month_index") / 12)), 2)
    denied = v("denied") < 0.08
    out = lines.select(
        F.concat_ws("-", F.lit("CL"), "member_id", "month_index", "line").alias("claim_line_id"), "member_id", F.col("p.provider_id").alias("provider_id"), F.col("month_index"), month_label("month_index").alias("month"), F.col("category").alias("service_category"),
        _pick(v("place"), ("office", "hospital", "home", "telehealth")).alias("place_of_service"), F.when(visit, code).alias("em_code"), F.when(visit, by_key(code, EM_MINUTES)).otherwise(0).alias("encounter_minutes"), allowed.alias("allowed_amount"),
        F.when(denied, 0.0).otherwise(F.round(allowed * F.col("actuarial_value"), 2)).alias("paid_amount"), F.when(denied, "denied").otherwise("paid").alias("status"), F.when(denied, _pick(v("reason"), ("not_covered", "no_authorisation", "duplicate"))).alias("denial_reason"),
        "region", "plan", "product", F.when(visit, choice(F.col("level"), EM_CODES)).alias("true_em_code"))
    assert set(SCHEMAS["claim_lines"].names) <= set(out.columns)
    return out
