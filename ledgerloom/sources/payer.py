"""Payer tables: schemas, CSV and JSON in and out, and stand-ins made from order data."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.scalars import month_label, months_since, uniform

_KINDS = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split(":") for x in text.split())])


SCHEMAS = {
    "members": _schema("member_id:s age:i age_band:i sex:s annual_income:d plan:s product:s region:s channel:s monthly_premium:d actuarial_value:d chronic_count:i premium_burden:d zip_deprivation_index:d enrolled_month:i"),
    "providers": _schema("provider_id:s specialty:s region:s panel_size:i years_practising:i is_fraud:i"),
    "enrollment_spans": _schema("member_id:s start_month:i tenure_months:i event_observed:i exit_cause:s utilisation_low:i denial_month:i had_denial:i end_month:i"),
    "claim_lines": _schema("claim_line_id:s member_id:s provider_id:s month_index:i month:s service_category:s place_of_service:s em_code:s encounter_minutes:i allowed_amount:d paid_amount:d status:s denial_reason:s region:s plan:s product:s"),
    "claim_scoring": _schema("claim_line_id:s em_code:s true_em_code:s"),
}
#: Fixed values of the coding domain: level and minutes of each visit code.
EM_CODES = ("99212", "99213", "99214", "99215")
EM_INTENSITY = {"99212": 0, "99213": 1, "99214": 2, "99215": 3}
EM_MINUTES = {"99212": 10, "99213": 15, "99214": 25, "99215": 40}
GRAINS = {"members": ["member_id"], "providers": ["provider_id"], "enrollment_spans": ["member_id"], "member_month": ["member_id", "month_index"], "provider_month": ["provider_id", "month_index"]}


def read_csv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by its declared schema, never inferred; codes stay strings, empty fields are null."""
    return spark.read.csv(f"{folder}/{name}.csv", header=True, schema=SCHEMAS[name])


def write_csv(df: DataFrame, folder: str, name: str, drop: tuple[str, ...] = ()) -> None:
    df.drop(*drop).write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)


def replace_table(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    df.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(name)
    return df.sparkSession.table(name)


def clean(value):
    """JSON-safe: NaN and infinities are None, at any depth."""
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(clean(report), indent=2))


def read_report(path: str) -> dict | None:
    """None if there is none yet."""
    return json.loads(Path(path).read_text()) if Path(path).exists() else None


def choice(index: Column, values: tuple[str, ...]) -> Column:
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(index == i, v).otherwise(out)
    return out


def by_key(column: Column, mapping: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


#: Of the stand-ins.
FIRST_YEAR, CUTOFF = 1995, 72
PREMIUMS = {"AUTOMOBILE": 21000.0, "BUILDING": 24000.0, "FURNITURE": 27000.0, "HOUSEHOLD": 30000.0, "MACHINERY": 33000.0}
PRODUCTS, CHANNELS, CAUSES = ("HMO", "PPO", "EPO"), ("individual", "employer", "broker", "exchange"), ("voluntary", "employer_change", "moved_away")
REASONS, PROFESSIONAL, PHARMACY, INPATIENT = ("not_covered", "no_authorisation", "duplicate"), "STANDARD", "PROMO", "LARGE"


class Payer:
    """The payer tables made from order data, each a lazy DataFrame; columns are pruned by what a query asks for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.read = spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def _place(self, key: str) -> DataFrame:
        nation, region = self.read("nation"), self.read("region")
        return nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").alias(key), F.col("r_name").alias("region"))

    @property
    def members(self) -> DataFrame:
        k, c = F.col("c_custkey"), self.read("customer").join(F.broadcast(self._place("c_nationkey")), "c_nationkey")
        income = F.lit(200000.0) + 100 * F.abs("c_acctbal")
        premium = by_key(F.col("c_mktsegment"), PREMIUMS, 25000.0)
        return c.select(
            F.concat(F.lit("M"), k).alias("member_id"), (18 + k % 70).cast("int").alias("age"), (20 + 10 * (k % 7)).cast("int").alias("age_band"), choice(k % 2, ("F", "M")).alias("sex"),
            income.alias("annual_income"), F.col("c_mktsegment").alias("plan"), choice(k % 3, PRODUCTS).alias("product"), "region", choice(k % 4, CHANNELS).alias("channel"),
            premium.alias("monthly_premium"), (0.6 + 0.1 * (k % 4)).alias("actuarial_value"), (k % 4).cast("int").alias("chronic_count"),
            F.greatest(F.lit(0.01), F.least(F.lit(0.6), premium / income)).alias("premium_burden"), ((k % 100) / 100.0).alias("zip_deprivation_index"), F.lit(0).alias("enrolled_month"))

    @property
    def providers(self) -> DataFrame:
        k, s = F.col("s_suppkey"), self.read("supplier").join(F.broadcast(self._place("s_nationkey")), "s_nationkey")
        return s.select(F.concat(F.lit("P"), k).alias("provider_id"), F.concat(F.lit("specialty_"), k % 7).alias("specialty"), "region", (100 + k % 900).cast("int").alias("panel_size"), (1 + k % 40).cast("int").alias("years_practising"), (k % 11 == 0).cast("int").alias("is_fraud"))

    @property
    def enrollment_spans(self) -> DataFrame:
        o = self.read("orders").groupBy("o_custkey").agg(F.min(months_since("o_orderdate", FIRST_YEAR)).alias("start_month"), F.max(months_since("o_orderdate", FIRST_YEAR)).alias("end_month"))
        k = F.col("o_custkey")
        denied = F.when(k % 5 == 0, F.col("start_month") + k % 24).otherwise(-1).cast("int")
        left = F.col("end_month") < CUTOFF
        return o.select(
            F.concat(F.lit("M"), k).alias("member_id"), "start_month", (F.col("end_month") - F.col("start_month")).alias("tenure_months"), left.cast("int").alias("event_observed"),
            F.when(left, choice(k % 3, CAUSES)).alias("exit_cause"), (k % 2).cast("int").alias("utilisation_low"), denied.alias("denial_month"), (denied >= 0).cast("int").alias("had_denial"), "end_month")

    @property
    def claim_lines(self) -> DataFrame:
        """Claim lines with what is copied from the member."""
        return self.claim_facts.join(self.members.select("member_id", "region", "plan", "product"), "member_id")

    @property
    def claim_money(self) -> DataFrame:
        """Amounts and states of the claim lines; parts, which only say what kind of service it was, aren't read."""
        return self._lines(F.lit(None).cast("string"), False).select("member_id", "provider_id", "month_index", "allowed_amount", "paid_amount", "status")

    @property
    def claim_facts(self) -> DataFrame:
        """One row an order line, without the member's columns; the line id is not unique in these data, so nothing may rely on it."""
        return self._lines(F.col("p_type"), True)

    def _lines(self, category: Column, parts: bool) -> DataFrame:
        line, orders, part = self.read("lineitem"), self.read("orders"), self.read("part")
        x = line.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), line["l_orderkey"] == F.col("o_orderkey"))
        x = x.join(part.select("p_partkey", "p_type"), line["l_partkey"] == F.col("p_partkey")) if parts else x
        level = F.when(F.col("l_quantity") <= 12, 0).when(F.col("l_quantity") <= 25, 1).when(F.col("l_quantity") <= 38, 2).otherwise(3)
        # A ring of providers bills part of its visits one level higher.
        drawn = uniform("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("shift"))
        billed = F.when((F.col("l_suppkey") % 11 == 0) & (drawn < 0.42), F.least(level + 1, F.lit(3))).otherwise(level)
        visit, denied = category == PROFESSIONAL, F.col("l_returnflag") == "R"
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        paid = F.floor(cents * (100 - F.round(F.col("l_discount") * 100).cast("long")) / 100).cast("long")
        month = months_since("o_orderdate", FIRST_YEAR)
        return x.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_line_id"), F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_key"), F.concat(F.lit("M"), "o_custkey").alias("member_id"), F.concat(F.lit("P"), "l_suppkey").alias("provider_id"),
            month.alias("month_index"), month_label(month, FIRST_YEAR).alias("month"), category.alias("service_category"), choice((F.col("l_linenumber") % 3).cast("int"), ("office", "hospital", "home")).alias("place_of_service"),
            F.when(visit, choice(billed, EM_CODES)).alias("em_code"), F.when(visit, choice(level, EM_CODES)).alias("true_em_code"), F.when(visit, by_key(choice(billed, EM_CODES), EM_MINUTES)).otherwise(0).alias("encounter_minutes"),
            F.col("l_extendedprice").alias("allowed_amount"), F.when(denied, 0.0).otherwise(paid / 100.0).alias("paid_amount"), F.when(denied, "denied").otherwise("paid").alias("status"), F.when(denied, choice((F.col("l_linenumber") % 3).cast("int"), REASONS)).alias("denial_reason"))
