"""Questions in plain words, mapped onto the declared vocabulary or refused."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import regression
from ledgerloom.plans.metrics import Registry

#: The answer key.
QUESTIONS = (
    ("What is our loss ratio?", "loss_ratio", ""), ("Show loss ratio by plan", "loss_ratio", "plan"), ("How does the loss ratio break down by region?", "loss_ratio", "region"), ("What is PMPM?", "pmpm", ""),
    ("Show me PMPM by region", "pmpm", "region"), ("What is the denial rate?", "denial_rate", ""), ("Denial rate by plan please", "denial_rate", "plan"), ("How many member months do we have?", "member_months", ""),
    ("Total paid claims by region", "paid_amount", "region"), ("What is loss ratio per month?", "loss_ratio", "month"), ("Premium PMPM by channel", "premium_pmpm", "channel"), ("Utilisation per 1000 by age band", "utilisation_per_1000", "age_band"),
    ("Which providers are committing fraud?", None, None), ("What will our loss ratio be next year?", None, None), ("Show me member social security numbers", None, None), ("What is the average age of our members?", None, None),
)
#: What a question may say instead of a metric's declared name; the answer key's questions use these words.
SYNONYMS = {
    "denial_rate": ("denial", "denials"),
    "member_months": ("member month",),
    "paid_amount": ("paid", "claims"),
    "utilisation_per_1000": ("utilisation", "utilization"),
}
#: What looks ahead can't be answered from what was paid.
AHEAD = ("will", "next", "forecast", "predict", "expected")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "question string, want_metric string, want_dims string")


def phrases(registry: Registry, longest_first: bool) -> list[tuple[int, str, str]]:
    """(place, metric, phrase) in order of preference: declared names before synonyms, by alphabet or longest first."""
    names = [(0, name.replace("_", " "), name) for name in registry.metrics]
    others = [(1, word, name) for name, said in SYNONYMS.items() if name in registry.metrics for word in said]
    ranked = sorted(names + others, key=lambda x: (x[0], -len(x[1].split()) if longest_first else 0, x[2], x[1]))
    return [(place, name, phrase) for place, (_, phrase, name) in enumerate(ranked)]


def resolved(df: DataFrame, registry: Registry, version: int = 1) -> DataFrame:
    """metric (null: refused) and dims (comma-joined, sorted), by whole words of the question.

    Version 1 prefers names by alphabet; version 2 the longest, and refuses to
    look ahead. Dimensions count where they stand after the first "by" or "per".
    """
    said = F.regexp_extract_all(F.lower("question"), F.lit(r"[a-z0-9]+"), F.lit(0))
    within = lambda words, phrase: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {phrase} ")
    metric = F.array_min(F.array_compact(F.array(*[F.when(within(said, phrase), F.struct(F.lit(place).alias("place"), F.lit(name).alias("name"))) for place, name, phrase in phrases(registry, version > 1)])))["name"]
    if version > 1:
        metric = F.when(~F.arrays_overlap(said, F.array(*map(F.lit, AHEAD))), metric)
    split_at = F.array_min(F.filter(F.array(F.array_position(said, "by"), F.array_position(said, "per")), lambda at: at > 0))
    after = F.slice(said, F.coalesce(split_at, F.size(said)).cast("int") + 1, F.size(said))
    dims = F.concat_ws(",", *[F.when(within(after, d.replace("_", " ")), d) for d in sorted(registry.dimensions)])
    return df.withColumns({"metric": metric, "dims": dims})


def marked(df: DataFrame) -> DataFrame:
    """kind and correct: a question without an answer is right when refused, any other when metric and dimensions fit."""
    refusal = F.col("want_metric").isNull()
    right = F.when(refusal, F.col("metric").isNull()).otherwise(F.coalesce((F.col("metric") == F.col("want_metric")) & (F.col("dims") == F.col("want_dims")), F.lit(False)))
    return df.withColumns({"kind": F.when(refusal, "refusal").otherwise("resolution"), "correct": right})


def accuracy(df: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.avg(F.when(c, F.col("correct").cast("double"))), 4)
    return df.agg(share(F.lit(True)).alias("overall"), share(F.col("kind") == "resolution").alias("resolution"), share(F.col("kind") == "refusal").alias("refusal"))


def with_figures(df: DataFrame, base: DataFrame, registry: Registry) -> DataFrame:
    """Resolved questions with the figure in total that each asks for; all metrics come from one pass over ``base``."""
    told = regression.snapshot(base, registry, tuple((m, ()) for m in registry.metrics)).select("metric", "value")
    return df.join(told, "metric", "left")


def strict_reply(text: str, registry: Registry) -> tuple[str | None, list[str]]:
    """A model's reply held to the vocabulary: what isn't in it is None, never the nearest name."""
    said = {k.lower(): v.strip().lower() for k, v in re.findall(r"(?im)^\W*(metric|dimensions):[ \t]*(.*)$", text)}
    name = (re.match(r"[a-z_0-9]+", said.get("metric", "")) or [None])[0]
    dims = [d for d in dict.fromkeys(re.split(r"[,\s]+", said.get("dimensions", ""))) if d in registry.dimensions]
    return (name if name in registry.metrics else None), dims


def answer(base: DataFrame, registry: Registry, question: str, resolver: Callable[[str], str] | None = None) -> DataFrame | None:
    """The figure a question asks for, or None; ``resolver`` stands in for a language model, rules are used without."""
    if resolver is not None:
        metric, dims = strict_reply(resolver(question), registry)
    else:
        row = resolved(base.sparkSession.createDataFrame([(question,)], "question string"), registry, 2).first()
        metric, dims = row.metric, [d for d in row.dims.split(",") if d]
    return None if metric is None else registry.compile(base, metric, dims)
