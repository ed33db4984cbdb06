"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt to shards by a hash of their id. A shard's tree splits at
the median of the widest dimension and keeps a tight box for every node; the
best product that a box allows bounds what is below it. A query goes through a
tree best-first and stops when no bound reaches its k-th score so far. Each
query first searches the shard it was dealt to; the k-th score it finds there
goes with it to all others.

A task holds one shard and one block of queries, both of bounded size, so
nothing is sent to every executor and no query gathers more than k rows from a
shard. Scores are exact: sums stay in the range in which doubles hold every
integer, or are done in Python's integers.

Vectors that are null or hold null or non-finite components, and rows without
an id, take no part. Repeated rows are one vector. Vectors of other lengths
than the query's are no candidates. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut

LEAF, SHARD_ROWS, BLOCK_ROWS = 64, 16_384, 1_024


class BoxTree:
    """Median splits on the widest dimension, tight boxes, at most LEAF rows in a leaf."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.low, self.high, self.span, self.children = [], [], [], []
        self._split(x, 0, len(x))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, x: np.ndarray, start: int, stop: int) -> int:
        rows = x[self.order[start:stop]]
        low, high, me = rows.min(axis=0), rows.max(axis=0), len(self.span)
        self.low.append(low)
        self.high.append(high)
        self.span.append((start, stop))
        self.children.append(None)
        if stop - start > LEAF and (high > low).any():
            half = (stop - start) // 2
            self.order[start:stop] = self.order[start:stop][np.argpartition(rows[:, np.argmax(high - low)], half)]
            self.children[me] = (self._split(x, start, start + half), self._split(x, start + half, stop))
        return me

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> list[tuple]:
    """(query id, vector id, score) of each query's best k rows in a shard that reach its floor."""
    most = int(max(np.abs(x).max(initial=0), 1)) * int(max(np.abs(queries).max(initial=0), 1)) * x.shape[1]
    kind = np.float64 if most < 1 << 53 else object
    x, queries = x.astype(kind), queries.astype(kind)
    tree, out = BoxTree(x), []
    bounds = tree.bounds(queries)
    for q, query_id, floor, bound in zip(queries, query_ids, floors, bounds):
        best: list[tuple] = []
        open_nodes = [(-bound[0], 0)]
        while open_nodes and -open_nodes[0][0] >= floor:
            _, node = heapq.heappop(open_nodes)
            if tree.children[node]:
                for child in tree.children[node]:
                    if bound[child] >= floor:
                        heapq.heappush(open_nodes, (-bound[child], child))
                continue
            start, stop = tree.span[node]
            rows = tree.order[start:stop]
            scores = x[rows] @ q
            ok = (scores >= floor) & (ids[rows] != query_id)
            if ok.any():
                best = heapq.nsmallest(k, best + list(zip((-scores[ok]).tolist(), ids[rows[ok]].tolist())))
                if len(best) == k:
                    floor = max(floor, -best[-1][0])
        out += [(query_id, vec_id, int(-score)) for score, vec_id in best]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score; both frames have (vec_id long, v array<long>)."""
    empty = -float("inf")
    vectors = cut(vectors.filter("vec_id is not null and v is not null").distinct().withColumn("dim", F.size("v")))
    queries = cut(queries.filter("vec_id is not null and v is not null").distinct().withColumn("dim", F.size("v")))
    n_shards, n_blocks = max(1, -(-vectors.count() // shard_rows)), max(1, -(-queries.count() // block_rows))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(n_blocks)).cast("int").alias("block")

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = np.stack(left["v"].to_list()), np.stack(right["q_v"].to_list())
        found = search(x, left["vec_id"].to_numpy(), q, right["q_vec_id"].to_numpy(), right["q_floor"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def run(v: DataFrame, q: DataFrame) -> DataFrame:
        keys = ["dim", "shard", "block"]
        q = q.select(*[F.col(c).alias(f"q_{c}") for c in (*keys, "vec_id", "v", "floor")])
        return v.groupBy(*keys).cogroup(q.groupBy(*[f"q_{c}" for c in keys])).applyInPandas(work, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # At home: each query in the one shard it is dealt to; a shard's own queries are one block.
    home = cut(run(vectors.select("vec_id", "v", "dim", shard, F.lit(0).alias("block")), queries.select("vec_id", "v", "dim", shard, F.lit(0).alias("block"), F.lit(empty).alias("floor"))))
    floors = home.groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count("*").alias("n"))
    floors = floors.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    sent = queries.join(floors, "vec_id", "left").select("vec_id", "v", "dim", block, F.coalesce("kth", F.lit(empty)).alias("floor"), shard.alias("home"), each(n_shards, "shard")).filter("shard <> home")
    away = run(vectors.select("vec_id", "v", "dim", shard, each(n_blocks, "block")), sent)
    return best(home.union(away)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scaled(embedding: Column, by: int = 256) -> Column:
    """floor(by * x) of each component; null for a vector that is null or holds null or non-finite ones."""
    x = lambda c: c.cast("double")
    fine = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(x(c)) < float("inf")))
    return F.when(fine, F.transform(embedding, lambda c: F.floor(F.lit(float(by)) * x(c))))


def op4_topk(spark, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.common import table

    v = table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("v"))
    return top_k(v, v.filter("vec_id % 50 = 0"))


OP4_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores) WHERE rank <= 5"""
