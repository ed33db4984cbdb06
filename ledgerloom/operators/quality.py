"""Audit trail, traceability, fingerprints."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.order import positioned
from ledgerloom.plans.tables import cut

AUDIT = "seq int, actor string, action string, subject string, detail string, recorded_at string, prev_hash string, hash string"
START = "0" * 64


@dataclass
class AuditTrail:
    """Entries that each hash the one before, so that no later change goes unseen."""

    entries: list[tuple] = field(default_factory=list)

    def append(self, actor: str, action: str, subject: str, detail: str, recorded_at: str) -> str:
        previous = self.entries[-1][-1] if self.entries else START
        content = (len(self.entries) + 1, actor, action, subject, detail, recorded_at, previous)
        digest = hashlib.sha256("\x1f".join(map(str, content)).encode()).hexdigest()
        self.entries.append((*content, digest))
        return digest

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.entries, AUDIT)


def _content(*columns: str) -> Column:
    return F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns])


def _follows(trail: DataFrame, *within: str) -> DataFrame:
    """``trail`` with ``before``: the hash of the entry one number lower, by a join, so that a trail of any length is in many tasks."""
    last = trail.select(*within, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    return trail.join(last, [*within, "seq"], "left").withColumn("before", F.coalesce("before", F.lit(START)))


def verify(trail: DataFrame) -> DataFrame:
    """intact, and the first seq whose hash or link is broken."""
    content = _content("seq", "actor", "action", "subject", "detail", "recorded_at", "prev_hash")
    broken = F.when((F.sha2(content, 256) != F.col("hash")) | (F.col("prev_hash") != F.col("before")), F.col("seq"))
    return _follows(trail).select(broken.alias("b")).agg(F.min("b").alias("broken_at_seq")).select(F.col("broken_at_seq").isNull().alias("intact"), "broken_at_seq")


SEGMENT = 256


def sealed(rows: DataFrame, columns: list[str], order: str, segment: int = SEGMENT) -> DataFrame:
    """(level, seq, segment, content, prev_hash, hash): a trail over a table of any size.

    Level 0 has an entry a row, in ``order``, which must be unique. A hash covers
    the entry and the one before it in its segment; the last hash of each segment
    is an entry of the next level, up to a level of one segment. So each link is
    made in a group of ``segment`` rows, and what is changed, even with all later
    hashes of its segment, shows in the level above.
    """
    rows = positioned(rows.select(order, _content(order, *columns).alias("content")), order, name="seq").select("seq", "content")
    out, level = None, 0
    while True:
        grouped = rows.withColumn("segment", F.floor((F.col("seq") - 1) / segment)).groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("all"))
        link = lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat_ws("\x1f", x["seq"].cast("string"), x["content"], F.element_at(acc, -1)), 256)))
        hashes = F.aggregate("all", F.array(F.lit(START)), link)
        entries = grouped.withColumn("h", hashes).select("segment", F.posexplode("all").alias("i", "x"), "h")
        entries = cut(entries.select(F.lit(level).alias("level"), F.col("x.seq").alias("seq"), "segment", F.col("x.content").alias("content"), F.col("h")[F.col("i")].alias("prev_hash"), F.col("h")[F.col("i") + 1].alias("hash")))
        out = entries if out is None else out.union(entries)
        rows = entries.groupBy("segment").agg(F.max_by("hash", "seq").alias("content")).select((F.col("segment") + 1).alias("seq"), "content")
        level += 1
        if entries.agg(F.max("segment")).first()[0] in (None, 0):
            return out


def breaks(trail: DataFrame) -> DataFrame:
    """(level, seq, kind): entries whose content doesn't give their hash, that don't follow the one before, or that don't hold the last hash of the segment they seal."""
    content = F.sha2(F.concat_ws("\x1f", F.col("seq").cast("string"), "content", "prev_hash"), 256) != F.col("hash")
    link = F.col("prev_hash") != F.col("before")
    below = trail.groupBy((F.col("level") + 1).alias("level"), (F.col("segment") + 1).alias("seq")).agg(F.max_by("hash", "seq").alias("sealed"))
    # A segment that is gone altogether leaves its seal behind; one that nothing seals is the last level's.
    checked = _follows(trail, "level", "segment").join(below, ["level", "seq"], "left")
    seal = (F.col("level") > 0) & F.coalesce(F.col("content") != F.col("sealed"), F.lit(True))
    kinds = F.array_compact(F.array(F.when(content, "content"), F.when(link, "link"), F.when(seal, "seal")))
    return checked.select("level", "seq", F.explode(kinds).alias("kind"))


def untraced(requirements: DataFrame, tests: DataFrame) -> DataFrame:
    """(requirement, test) that no available test backs; a requirement without any test is there with a null."""
    named = requirements.select("requirement", F.explode_outer("tests").alias("test"))
    return named.join(tests, "test", "left_anti").select("requirement", "test")


def orphans(links: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """(link, rows, keys): rows of the first relation whose key the second doesn't have, and how many such keys; an anti join each."""
    out = None
    for name, (rows, known, key) in links.items():
        one = rows.select(key).join(known.select(key).distinct(), key, "left_anti").agg(F.lit(name).alias("link"), F.count("*").alias("rows"), F.countDistinct(key).alias("keys"))
        out = one if out is None else out.union(one)
    return out


def canonical(value: Column, kind: T.DataType) -> Column:
    """A value as text that doesn't depend on the engine: numbers with a point to nine places, times to microseconds, lists item by item."""
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        double = value.cast("double")
        odd = F.isnan(double) | (F.abs(double) >= 1e28) if not isinstance(kind, T.DecimalType) else F.lit(False)
        return F.when(odd, double.cast("string")).otherwise((value if isinstance(kind, T.DecimalType) else F.when(~odd, double)).cast("decimal(38,9)").cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: F.coalesce(canonical(x, kind.elementType), F.lit("N"))), ","), F.lit("]"))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.concat(F.lit("{"), *[_told(canonical(value[f.name], f.dataType)) for f in kind], F.lit("}")))
    if isinstance(kind, T.MapType):
        return canonical(F.array_sort(F.map_entries(value)), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    return value.cast("string")


def _told(text: Column) -> Column:
    """With its length before it, so that no two rows read alike; null is a letter of its own."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("N"))


LANES = tuple(f"lane{i}" for i in range(4))


def _lanes(df: DataFrame, columns: list[str] | None) -> list[Column]:
    fields = [f for f in df.schema if columns is None or f.name in columns]
    row = F.md5(F.concat(*[_told(canonical(F.col(f.name), f.dataType)) for f in fields]))
    return [F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(lane) for i, lane in enumerate(LANES)]


def _digest() -> Column:
    """128 bits: four sums modulo 2**32."""
    return F.concat(*[F.lpad(F.lower(F.hex((F.coalesce(F.col(lane), F.lit(0)) % F.lit(1 << 32)).cast("long"))), 8, "0") for lane in LANES])


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n and digest over all columns or those named: the same for the same rows in any order, partition or process; repeated rows count."""
    return df.agg(F.count("*").alias("n"), *_lanes(df, columns)).select("n", _digest().alias("digest"))


def manifest(files: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A line for each file of a table read from files: name, size, time, rows and sums, from which ``total`` makes the table's fingerprint."""
    meta = F.col("_metadata")
    named = files.select("*", meta["file_path"].alias("_file"), meta["file_size"].alias("_size"), meta["file_modification_time"].alias("_time"))
    sums = _lanes(files, columns)
    return named.groupBy(F.col("_file").alias("file"), F.col("_size").alias("size"), F.col("_time").alias("time")).agg(F.count("*").alias("n"), *sums)


def total(lines: DataFrame) -> DataFrame:
    """n and digest of all the files of a manifest."""
    return lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.sum(lane).alias(lane) for lane in LANES]).select("n", _digest().alias("digest"))


def refreshed(spark: SparkSession, path: str, old: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The manifest as the table stands now; only files that are new or differ in size or time are read. Files without rows have no line."""
    now = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("time"))
    kept = old.join(now, ["file", "size", "time"], "left_semi")
    # A file's name and no more for each that changed.
    changed = [r.file for r in now.join(old, ["file", "size", "time"], "left_anti").select("file").collect()]
    return kept.unionByName(manifest(spark.read.parquet(*changed), columns)) if changed else kept
