"""Peer-relative outliers among providers, and how they hold against evasion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import uniform
from ledgerloom.plans.warehouse import professional
from ledgerloom.sources.payer import EM_CODES, EM_INTENSITY, by_key, choice

FLOOR, FLAG_Z, DAY_MINUTES, WORKDAYS = 40, 2.5, 600.0, 21.0
SHIFT, REDUCED = 0.42, 0.15
STRATEGIES = ("reduced_rate", "stay_below_threshold", "spread_thin")


def features(visits: DataFrame, providers: DataFrame) -> DataFrame:
    """Per provider: visits, mean level, share of the upper levels, minutes, and the busiest month's minutes a workday."""
    month = visits.groupBy("provider_id", "month_index").agg(F.count("*").alias("n"), F.sum("intensity").alias("i"), F.sum(F.when(F.col("intensity") >= 2, 1).otherwise(0)).alias("top"), F.sum("minutes").alias("m"))
    each = month.groupBy("provider_id").agg(
        F.sum("n").cast("long").alias("n_claims"), (F.sum("i") / F.sum("n")).alias("mean_intensity"), (F.sum("top") / F.sum("n")).alias("top_share"),
        F.sum("m").cast("long").alias("total_minutes"), (F.max("m") / WORKDAYS).alias("max_daily_minutes"))
    return each.join(providers.select("provider_id", "specialty", "region", "is_fraud"), "provider_id")


def peer_scores(df: DataFrame) -> DataFrame:
    """z against all of the specialty; a spread of zero counts as one."""
    peers = Window.partitionBy("specialty")

    def z(c: str):
        spread = F.stddev_pop(c).over(peers)
        return (F.col(c) - F.avg(c).over(peers)) / F.when(spread > 1e-12, spread).otherwise(1.0)

    return df.withColumns({"z_intensity": z("mean_intensity"), "z_top_share": z("top_share")})


def flags(scored: DataFrame, floor: int = FLOOR) -> DataFrame:
    """The floor comes after the scores: small providers are peers, but are not judged."""
    out = scored.filter(F.col("n_claims") >= floor).withColumns({
        "rule_peer_intensity": F.round("z_intensity", 9) > FLAG_Z, "rule_top_code_share": F.round("z_top_share", 9) > FLAG_Z, "rule_impossible_day": F.col("max_daily_minutes") > DAY_MINUTES})
    return out.withColumn("flagged", F.col("rule_peer_intensity") | F.col("rule_top_code_share") | F.col("rule_impossible_day"))


def confusion(flagged: DataFrame) -> DataFrame:
    """Precision, recall and F1 against the known ring, 0 where undefined, and the hits of each rule."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    bad, hit = F.col("is_fraud") == 1, F.col("flagged")
    out = flagged.agg(n(bad & hit).alias("tp"), n(~bad & hit).alias("fp"), n(bad & ~hit).alias("fn"), *[n(F.col(r)).alias(r) for r in ("rule_peer_intensity", "rule_top_code_share", "rule_impossible_day")])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(share(2 * p * r, p + r), 4)})


def evade(visits: DataFrame, providers: DataFrame, strategy: str) -> DataFrame:
    """The visits as an adapted ring would bill them, from the honest levels on. Draws depend on line and strategy alone."""
    ring = providers.filter("is_fraud = 1").select("provider_id", (F.row_number().over(Window.orderBy("provider_id")) > F.floor(F.count("*").over(Window.partitionBy(F.lit(0))) / 2)).alias("active"))
    rows = visits.join(ring, "provider_id", "left")
    base = by_key(F.coalesce("true_em_code", "em_code"), EM_INTENSITY)
    drawn, member = uniform("line_key", F.lit(strategy)), F.col("active").isNotNull()
    bump, top = {
        "reduced_rate": (member & (drawn < REDUCED), 3),
        "stay_below_threshold": (member & (drawn < SHIFT) & (base < 2), 2),
        "spread_thin": (F.coalesce("active", F.lit(False)) & (drawn < SHIFT), 3),
    }[strategy]
    level = F.when(bump, F.least(base + 1, F.lit(top))).otherwise(base)
    return professional(rows.withColumn("em_code", choice(level, EM_CODES)).drop("active", "intensity", "minutes"), None)


def detect(visits: DataFrame, providers: DataFrame) -> DataFrame:
    return confusion(flags(peer_scores(features(visits, providers))))
