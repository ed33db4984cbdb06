"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of all documents are a budget that the sources share by weight. The
budget is cut into equal blocks; the blocks go to the sources by highest
quotient, then in the same way to the shards of each source, which gives every
shard an integer quota. A shard lays its documents end to end in a seeded
order, takes whole passes, and then a run of blocks from a seeded start.

Everything is grouping, joining and windows over the shards; a shard holds
``shard_rows`` documents or so, whatever its source's size.

Nulls: a null text counts 0 words; a null source is a source, the last.
Documents without words are returned and take 0. Repeated rows are documents
of their own. Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, draw, free

WORD = r"[^\x20\x09-\x0D]+"


def apportion(cells: DataFrame, group: list[str], key: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """``cells`` with its seats: each group's ``seats`` go to its cells by the highest weight / (2 j - 1).

    Only seats near the outcome are ranked: rounding weight / divisor gives a
    total within half the number of cells, so the fitting divisor lies within
    cells / (2 seats) of the mean one. That leaves a few candidates per cell.
    Ties go to the smaller key. A group of weight 0 has no seats.
    """
    g = Window.partitionBy(*group)
    w, n = F.col(weight).cast("double"), F.col(seats)
    near = cells.withColumns({"_total": F.sum(w).over(g), "_cells": F.count(F.lit(1)).over(g)})
    share = w * n / F.nullif(F.col("_total"), F.lit(0.0))
    slack = F.coalesce(F.col("_cells") / F.nullif(2.0 * n, F.lit(0.0)), F.lit(0.0))
    near = near.withColumns({
        "_low": F.greatest(F.coalesce(F.floor(share * (1.0 - slack) - 0.5), F.lit(0)), F.lit(0)).cast("long"),
        "_high": F.coalesce(F.floor(share * (1.0 + slack) + 1.5), F.lit(0)).cast("long"),
    })
    near = near.withColumn("_left", n - F.sum("_low").over(g))
    ranked = near.filter("_high > _low").select("*", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_j"))
    order = Window.partitionBy(*group).orderBy(F.desc(F.col(weight).cast("double") / (2 * F.col("_j") - 1)), *key)
    won = ranked.withColumn("_rank", F.row_number().over(order)).filter("_rank <= _left").groupBy(*group, *key).agg(F.count("*").alias("_won"))
    joined = near.join(won, [*dict.fromkeys(group + key)], "left")
    return joined.select(*cells.columns, (F.col("_low") + F.coalesce(F.col("_won"), F.lit(0))).alias(out))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 16, shard_rows: int = 4096, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and, of its shard, quota in blocks.

    ``weights`` repeat over the sources by code point, null last; no source's
    target exceeds ``most`` times its size, the excess is shared again by
    weight. ``taken`` counts the words the mix takes of the document, passes
    included, ``most`` times its size at most.
    """
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    every = Window.partitionBy(F.lit(0))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = sources.withColumn("source_no", F.row_number().over(every.orderBy(F.asc_nulls_last("source"))).cast("long"))
    pick = F.lit(weights[-1])
    for i in range(len(weights) - 1):
        pick = F.when((F.col("source_no") - 1) % len(weights) == i, weights[i]).otherwise(pick)
    sources = sources.withColumn("weight", pick.cast("long")).withColumn("cap", most * F.col("source_size"))
    # Water-filling: with the sources by cap / weight, those before some point are full and the rest share what is left.
    rising = every.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sources = sources.withColumns({"total": F.sum("source_size").over(every), "level": (F.sum("source_size").over(every) - before) / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))})
    sources = sources.withColumn("fill", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every))
    sources = sources.withColumn("target", F.least(F.col("cap").cast("double"), F.col("fill") * F.col("weight")))
    sources = sources.withColumns({"blocks": F.floor((F.col("total") + block_words // 2) / block_words).cast("long"), "all": F.lit(0)})
    sources = cut(apportion(sources, ["all"], ["source_no"], "target", "blocks", "source_blocks").select("source", "source_no", "source_size", "target", "source_blocks", F.greatest(F.floor(F.col("rows") / shard_rows), F.lit(1)).cast("long").alias("shards")))

    dealt = sized.withColumnRenamed("source", "_s").join(sources, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    dealt = dealt.withColumns({"place": F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), "shard": draw(F.lit(seed), F.lit("shard"), "doc_id") % F.col("shards")})
    shards = dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    shards = apportion(shards, ["source_no"], ["shard"], "shard_size", "source_blocks", "quota").select("source_no", "shard", "shard_size", "quota")
    z, words = F.col("shard_size"), F.col("quota") * block_words
    passes = F.least(F.floor(words / F.nullif(z, F.lit(0))), F.lit(most)).cast("long")
    shards = shards.withColumns({"passes": F.coalesce(passes, F.lit(0))})
    shards = shards.withColumns({"rest": F.when(F.col("passes") < most, words - F.col("passes") * z).otherwise(F.lit(0)), "start": F.coalesce(block_words * (draw(F.lit(seed), F.lit("start"), "source_no", "shard") % F.nullif(F.ceil(z / block_words), F.lit(0))), F.lit(0))})
    line = Window.partitionBy("source_no", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("end", F.sum("size").over(line)).join(shards, ["source_no", "shard"])
    begin, stop = F.col("end") - F.col("size"), F.col("start") + F.col("rest")
    first = F.greatest(F.least(F.col("end"), stop) - F.greatest(begin, F.col("start")), F.lit(0))
    again = F.greatest(F.least(F.col("end"), stop - z) - begin, F.lit(0))
    return laid.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.when(F.col("size") > 0, first + again).otherwise(0)).cast("long").alias("taken"), "quota")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, as rows of ``docs``: a document stands there once for each begun time that the mix takes it.

    Documents of which the mix takes nothing are gone. The mix works per doc_id,
    so rows with one doc_id must be copies of one another. Rows without a doc_id
    are told apart by source and size; those alike in both stand as often as the
    most taken of them. Columns of any name stay; texts of any length are whole.
    """
    id_col, text_col, source_col = (options.get(f"{c}_col", d) for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    i, g, z, n, x = (free(c, docs) for c in ("taken_id", "taken_source", "taken_size", "taken_times", "taken_time"))
    times = mixture(docs, **options).filter("taken > 0").groupBy(F.col("doc_id").alias(i), F.col("source").alias(g), F.col("size").alias(z)).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(n))
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    out = docs.join(times, docs[id_col].eqNullSafe(times[i]) & docs[source_col].eqNullSafe(times[g]) & (size == times[z]))
    return out.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), F.col(n))).alias(x)).drop(x)


def op10_mixture(spark, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.common import table

    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _apportion_sql(cells: str, group: str, key: str, weight: str, seats: str, out: str) -> str:
    """The plain form: every quotient of every cell, the highest win."""
    return f"""
  SELECT c.*, coalesce(w.won, 0)::BIGINT AS {out} FROM {cells} c LEFT JOIN (
    SELECT {group}, {key}, count(*) AS won FROM (
      SELECT {group}, {key}, {seats} AS seats, row_number() OVER (PARTITION BY {group} ORDER BY {weight}::DOUBLE / (2 * j - 1) DESC, {key}) AS r
      FROM (SELECT *, unnest(range(1, {seats} + 1)) AS j FROM {cells} WHERE {weight} > 0))
    WHERE r <= seats GROUP BY ALL) w ON c.{group} = w.{group} AND c.{key} = w.{key}"""


OP10_SQL = rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
src1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no, 3 * source_size AS cap FROM src0),
src2 AS (SELECT *, (source_no - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM src1),
src3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM src2),
src4 AS (SELECT *, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS fill FROM src3),
src5 AS (SELECT *, least(cap::DOUBLE, fill * weight) AS target, floor((total + 8) / 16)::BIGINT AS blocks, 0 AS one FROM src4),
src AS ({_apportion_sql("src5", "one", "source_no", "target", "blocks", "source_blocks")}),
dealt AS (SELECT d.doc_id, d.size, s.source_no, s.source_size, s.target, s.source_blocks, md5('mix:' || d.doc_id) AS place,
  ('0x' || substr(md5('mix:shard:' || d.doc_id), 1, 8))::BIGINT % greatest(floor(s.n / 4096), 1)::BIGINT AS shard
  FROM sized d JOIN src s ON d.source IS NOT DISTINCT FROM s.source),
sh0 AS (SELECT source_no, shard, sum(size)::BIGINT AS z, any_value(source_blocks) AS source_blocks FROM dealt GROUP BY ALL),
sh1 AS ({_apportion_sql("sh0", "source_no", "shard", "z", "source_blocks", "quota")}),
sh2 AS (SELECT *, coalesce(least(floor(quota * 16 / nullif(z, 0)), 3), 0)::BIGINT AS passes FROM sh1),
sh AS (SELECT *, CASE WHEN passes < 3 THEN quota * 16 - passes * z ELSE 0 END AS rest,
  coalesce(16 * (('0x' || substr(md5('mix:start:' || source_no || ':' || shard), 1, 8))::BIGINT % nullif(ceil(z / 16)::BIGINT, 0)), 0) AS start FROM sh2),
laid AS (SELECT d.*, sum(size) OVER (PARTITION BY source_no, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop FROM dealt d)
SELECT doc_id, size, source_size, target, (passes * size + CASE WHEN size > 0 THEN
  greatest(least(stop, start + rest) - greatest(stop - size, start), 0) + greatest(least(stop, start + rest - z) - (stop - size), 0) ELSE 0 END)::BIGINT AS taken
FROM laid JOIN sh USING (source_no, shard)"""
