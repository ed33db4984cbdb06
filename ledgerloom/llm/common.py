"""Helpers that several operators share: cutting lineage, portable draws, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where none is named and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    return spark.sparkContext.getCheckpointDir()


def releasing(work):
    """``work`` over batches, which at its end gives memory that Arrow and the allocator still hold back to the machine: workers live on, and an executor has several."""
    def run(batches):
        import ctypes

        import pyarrow as pa

        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, with no lineage behind them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def keep(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, so that later reads prune columns."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    (df.select(*columns) if columns else df).write.parquet(path)
    return df.sparkSession.read.schema(df.select(*columns).schema if columns else df.schema).parquet(path)


def free(name: str, df: DataFrame) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def draw(*parts: Column | str) -> Column:
    """A number from 0 to 2**32 - 1 that depends on the given values alone, alike in every engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns a, b): the least node it is connected with.

    Alternates large-star and small-star steps (Kiveris et al. 2014): every
    step is a grouping and a join on the edges, rewires each node to the
    least neighbour it knows and never adds edges. Loops, repeats and either
    direction are allowed; no edges give no rows.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        out = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = out.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        to_least = out.join(least, "a")
        kept = to_least.filter("b > a") if large else to_least
        new = kept.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            new = new.union(least.select("a", F.col("m").alias("b")))
        return new.filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").filter("a <> b").distinct())
    before = None
    for _ in range(rounds):
        edges = cut(star(star(edges, True), False))
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(edges.select(F.col("b"), F.col("b")).distinct())
