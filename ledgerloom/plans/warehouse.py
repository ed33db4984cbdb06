"""The conformed relations and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import money, month_label, month_label_rounded
from ledgerloom.plans.tables import Relations
from ledgerloom.sources.payer import EM_INTENSITY, EM_MINUTES, FIRST_YEAR, PHARMACY, PROFESSIONAL, Payer, by_key


def exposure(spans: DataFrame) -> DataFrame:
    """A row for each month from start to before end; spans without a month give none."""
    some = spans.filter("end_month > start_month")
    return some.select("member_id", F.explode(F.sequence(F.col("start_month"), F.col("end_month") - 1)).alias("month_index"))


def claims_by_month(claims: DataFrame) -> DataFrame:
    """Claims are summed to the grain before any join, so a join can't repeat them."""
    return claims.groupBy("member_id", "month_index").agg(
        money("paid_amount").alias("paid_amount"), money("allowed_amount").alias("allowed_amount"), F.count("*").alias("total_lines"),
        F.sum(F.when(F.col("status") == "denied", 1).otherwise(0)).alias("denied_lines"))


def member_month(p: Payer, first_year: int = FIRST_YEAR) -> DataFrame:
    """One row per member and enrolled month, months without a claim included."""
    dim = p.members.select("member_id", "region", "plan", "product", "channel", "age_band", "sex", "chronic_count", "premium_burden", F.col("monthly_premium").alias("premium_collected"))
    rows = exposure(p.enrollment_spans).join(dim, "member_id").join(claims_by_month(p.claim_money), ["member_id", "month_index"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "member_id", "month_index", month_label("month_index", first_year).alias("month"), month_label_rounded("month_index", first_year).alias("month_ref"), "region", "plan", "product", "channel", "age_band", "sex", "chronic_count", "premium_burden",
        "premium_collected", zero("paid_amount"), zero("allowed_amount"), zero("total_lines"), zero("denied_lines"))


def with_pharmacy(base: DataFrame, claims: DataFrame) -> DataFrame:
    pharmacy = claims.filter(F.col("service_category") == PHARMACY).groupBy("member_id", "month_index").agg(money("paid_amount").alias("pharmacy_paid"))
    return base.join(pharmacy, ["member_id", "month_index"], "left").withColumn("pharmacy_paid", F.coalesce("pharmacy_paid", F.lit(0.0)))


def professional(claims: DataFrame, category: str | None = PROFESSIONAL) -> DataFrame:
    """Visits with a code, their level and minutes; without a category, whatever has a code."""
    rows = claims.filter(F.col("em_code").isNotNull())
    rows = rows if category is None else rows.filter(F.col("service_category") == category)
    return rows.withColumns({"intensity": by_key(F.col("em_code"), EM_INTENSITY), "minutes": by_key(F.col("em_code"), EM_MINUTES)})


def relations(p: Payer) -> Relations:
    """The conformed relations and what they are made of, by name."""
    out = Relations()
    for name in ("members", "providers", "enrollment_spans", "claim_money", "claim_facts"):
        out.declare(name, lambda name=name: getattr(p, name))
    out.declare("member_month", lambda *_: member_month(p), "members", "enrollment_spans", "claim_money")
    out.declare("member_month_with_pharmacy", with_pharmacy, "member_month", "claim_facts")
    out.declare("provider_month", lambda *_: provider_month(p), "providers", "claim_facts")
    return out


def provider_month(p: Payer) -> DataFrame:
    rows = professional(p.claim_facts).drop("region").join(p.providers.select("provider_id", "specialty", "region"), "provider_id")
    return rows.groupBy("provider_id", "specialty", "region", "month_index").agg(
        F.count("*").alias("n_professional"), F.round(F.avg("intensity"), 6).alias("mean_intensity"), F.sum("minutes").cast("long").alias("total_minutes"), money("allowed_amount").alias("allowed_amount"))


def fanout(base: DataFrame, spans: DataFrame) -> DataFrame:
    """Months by the spans' lengths and by the rows; they must be equal."""
    expected = spans.agg(F.sum(F.greatest(F.col("end_month") - F.col("start_month"), F.lit(0))).cast("long").alias("expected"))
    return expected.join(base.agg(F.count("*").alias("actual")), how="full", on=F.lit(True)).withColumn("equal", F.col("expected") == F.col("actual"))


def zero_claim_share(base: DataFrame) -> DataFrame:
    return base.agg(F.round(F.avg(F.when(F.col("total_lines") == 0, 1.0).otherwise(0.0)), 4).alias("zero_claim_share"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("relation"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


def idempotency(build) -> DataFrame:
    """Count and cents of the relation, built twice."""
    sums = lambda df, n: df.agg(F.lit(n).alias("build"), F.count("*").alias("n"), F.round(money("paid_amount"), 2).alias("paid"))
    return sums(build(), 1).union(sums(build(), 2)).agg(F.countDistinct("n", "paid").alias("versions"), F.max("n").alias("n"), F.max("paid").alias("paid"))


def grain_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("violations"))


def invariants(base: DataFrame, registry) -> DataFrame:
    """(check, passed): what must hold whatever the definitions say. One pass over the relation by region, then over its few rows."""
    paid, premium = money("paid_amount"), money("premium_collected")
    by = base.groupBy("region").agg(paid.alias("paid"), premium.alias("premium"), *[F.min(c).alias(f"min_{c}") for c in ("paid_amount", "premium_collected", "total_lines", "denied_lines")], F.max(F.col("denied_lines") - F.col("total_lines")).alias("over"))
    total = registry.compile(base, "loss_ratio").select("value", "numerator", "denominator")
    one = by.agg(F.sum("paid").alias("paid"), F.least(*[F.min(f"min_{c}").cast("double") for c in ("paid_amount", "premium_collected", "total_lines", "denied_lines")]).alias("low"), F.max("over").alias("over")).join(total, how="full", on=F.lit(True))
    # The names of the checks and the plausible band.
    checks = {
        "no negative amounts or counts": F.col("low") >= 0, "denied lines never exceed total lines": F.col("over") <= 0, "loss ratio within a plausible band": F.col("value").between(0.3, 1.5),
        "region slices reconcile to the total": F.abs(F.col("paid") - F.col("numerator")) < 0.01, "ratio equals numerator over denominator": F.abs(F.col("value") - F.col("numerator") / F.col("denominator")) < 1e-9}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()])).alias("x")).select("x.*")
