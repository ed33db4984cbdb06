"""Exact n-gram Jaccard join with count-vector R-trees.

A document's distinct shingles are hashed into groups; the group counts are a
point. Two documents share at most the sum of the smaller counts, and a tree
node, which keeps the largest count of each group below it, at most the same
sum with its box. Pairs that pass this bound are verified on their whole sets.

One tree over everything would have to see every query, so the trees are
sharded without loss: in a fixed order of all shingles, two sets that are
similar enough share some of their first few (the prefix), more the larger they
are. Each prefix shingle that two sets have is a shard, and a pair must come up
in enough shards. A crowded shard is dealt out in pairs of blocks. Boxes have
coarse counts; pairs that these leave are bounded by finer ones before any set
is read. Frequent shingles stand last in the order; which are found frequent
changes the work and never the result.

Copies with one set are one node. Groups of near copies don't turn into all
their pairs: each set is first compared with the leader that it meets most
often, and what links becomes a class; after that, a shard only yields pairs of
classes that are still different. So what comes out is the classes, exact, and
a spanning set of links, not every link.

Texts that are null or have no words link with nothing and are classes of
their own. Ids must be unique but for repeated rows, which are one document.
Empty input gives empty output; only the id and the text column are read, so
further columns of any name don't matter. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, cut, keep, releasing
from ledgerloom.llm.shingles import mix, shingle_set

#: Groups of a point, and those that tree boxes and the first look at a pair have.
GROUPS, COARSE = 128, 32
LEAF = 16
#: A shard of more rows is dealt out in pairs of blocks.
BLOCK = 8192
#: Frequent shingles that are put last: the heaviest of those in so many sets at least.
FREQUENT, MOST_FREQUENT = 64, 50_000
#: Ids up to this many (a few MB) may be sent to every executor; beyond, both sides are shuffled.
BROADCAST_IDS = 500_000


def shared_at_least(n):
    """How many prefix shingles a pair must share: those of its smaller set count."""
    return 1 + n // 32


def prefix_size(n: int, percent: int) -> int:
    """So many shingles, the first in the common order, that a similar set no smaller must share ``shared_at_least`` of them."""
    return min(n, n - -(-percent * n // 100) + shared_at_least(n))


def packed(s: np.ndarray) -> bytes:
    """A set's point in bytes: a shift, then the counts shifted down and rounded up, so that no minimum is ever too small."""
    counts = np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    shift = max(0, int(counts.max(initial=0) - 1).bit_length() - 8)
    return bytes((shift,)) + (-(-counts >> shift)).astype(np.uint8).tobytes()


def unpacked(points: Iterable[bytes]) -> np.ndarray:
    """Points as rows, in bytes where they fit."""
    x = np.frombuffer(b"".join(points), dtype=np.uint8).reshape(-1, GROUPS + 1)
    return x[:, 1:].astype(np.int32) << x[:, :1] if x[:, 0].any() else x[:, 1:]


def coarser(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), COARSE, -1).sum(axis=2, dtype=np.int32)


def summary(s: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[int, int, int, bytes, list[int], float]:
    """n, a 128-bit signature, the group counts and the prefix of a sorted set, and the share of frequent shingles in it."""
    if not len(s):
        return 0, 0, 0, b"", [], 0.0
    one, two = (int(mix(s * np.uint64(k)).sum().astype(np.int64)) for k in (3, 5))
    ordered, common = s, 0.0
    if len(frequent):
        hit = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        ordered, common = (np.concatenate([s[~hit], s[hit]]) if hit.any() else s), float(hit.mean())
    return len(s), one, two, packed(s), ordered[: prefix_size(len(s), percent)].astype(np.int64).tolist(), common


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """The heaviest shingles over all documents: counted where a task sees several, then summed."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                sets = {s.tobytes(): s for s in (shingle_set(t, width) for t in b["text"].iloc[at : at + 1000])}
                if sets:
                    tokens, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                    many = n >= max(3, len(sets) // 200)
                    yield pd.DataFrame({"token": tokens[many].astype(np.int64), "n": n[many]})

    counted = docs.select("text").mapInPandas(releasing(work), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r.token for r in rows], dtype=np.int64).astype(np.uint64))


def _summaries(docs: DataFrame, frequent: np.ndarray, width: int, percent: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [summary(shingle_set(t, width), shared.value, percent) for t in b["text"]]
            yield pd.DataFrame(rows, columns=["n", "sig1", "sig2", "counts", "prefix", "common"]).assign(doc_id=b["doc_id"].to_numpy())

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(releasing(work), f"n long, sig1 long, sig2 long, counts binary, prefix array<long>, common double, doc_id {kind}")


def _bound(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the summed minima of two points leave the asked overlap possible."""
    return (100 + percent) * np.minimum(a, b).sum(axis=-1, dtype=np.int64) >= percent * (na + nb)


class CountTree:
    """An R-tree over count vectors, packed by size and then by the fullest groups."""

    def __init__(self, counts: np.ndarray, n: np.ndarray):
        slab, rough = max(LEAF, int(len(n) ** 0.5) // LEAF * LEAF or LEAF), coarser(counts)
        by_size = np.argsort(n, kind="stable")
        parts = [by_size[i : i + slab] for i in range(0, len(n), slab)]
        self.order = np.concatenate([p[np.lexsort((rough[p, 1], rough[p, 0], rough[p].argmax(axis=1)))] for p in parts])
        self.counts, self.rough, self.n = counts[self.order], rough[self.order], n[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        high, small, large = self.rough, self.n, self.n
        while len(high) > 1:
            cuts = np.arange(0, len(high), LEAF)
            high, small, large = np.maximum.reduceat(high, cuts), np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts)
            self.levels.append((high, small, large))

    def _meet(self, level: int, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        high, small, large = self.levels[level]
        fits = (100 * large[others] >= percent * small[i]) & (100 * large[i] >= percent * small[others])
        return others[fits & _bound(high[i], high[others], small[i], small[others], percent)]

    def pairs(self, classes: np.ndarray, percent: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of different classes (and sides) that the bound leaves, node against node from the top."""
        classes, side = classes[self.order], None if side is None else side[self.order]
        stack = [(len(self.levels) - 1, 0, np.zeros(1, dtype=np.int64))]
        while stack:
            level, i, others = stack.pop()
            mine = np.arange(i * LEAF, min((i + 1) * LEAF, len(self.levels[level - 1][0]) if level else len(self.n)))
            for o in others:
                theirs = np.arange(o * LEAF, min((o + 1) * LEAF, len(self.levels[level - 1][0]) if level else len(self.n)))
                if level:
                    for m in mine:
                        left = self._meet(level - 1, m, theirs[theirs >= m], percent)
                        if len(left):
                            stack.append((level - 1, m, left))
                    continue
                a, b = np.repeat(mine, len(theirs)), np.tile(theirs, len(mine))
                ok = (a < b) & (classes[a] != classes[b])
                if side is not None:
                    ok &= side[a] != side[b]
                a, b = _left(a[ok], b[ok], self.rough, self.counts, self.n, percent)
                if len(a):
                    yield self.order[a], self.order[b]


def _left(a: np.ndarray, b: np.ndarray, rough: np.ndarray, counts: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs that sizes, then coarse, then fine counts leave."""
    ok = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
    a, b = a[ok], b[ok]
    for points in (rough, counts):
        if len(a):
            ok = np.concatenate([_bound(points[x], points[y], n[x], n[y], percent) for x, y in ((a[i : i + 32768], b[i : i + 32768]) for i in range(0, len(a), 32768))])
            a, b = a[ok], b[ok]
    return a, b


def _blocks(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The batches of a sorted partition, cut so that no group is in two."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = b[key].iloc[-1]
        cut_at = int(np.searchsorted(b[key].to_numpy() == last, True)) if b[key].iloc[0] != last else 0
        if cut_at:
            yield pd.concat([*held, b.iloc[:cut_at]], ignore_index=True)
            held = []
        held.append(b.iloc[cut_at:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _search(percent: int):
    """Candidates of different classes within each shard, or between the two blocks of a crowded one."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _blocks(batches, "shard"):
            shard, node = b["shard"].to_numpy(), b["node"].to_numpy()
            cls, n, side = b["cls"].to_numpy(), b["n"].to_numpy(), b["side"].to_numpy()
            counts = unpacked(b["counts"])
            rough = coarser(counts)
            edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
            start, size = edges[:-1], np.diff(edges)
            varied = np.minimum.reduceat(cls, start) != np.maximum.reduceat(cls, start)

            def pairs(i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
                return pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "need": shared_at_least(np.minimum(n[i], n[j]))})

            # Shards of one leaf, those of one size together.
            for k in range(2, LEAF + 1):
                some = start[varied & (size == k) & (side[start] < 0)]
                for at in range(0, len(some), 4096):
                    i, j = ((some[at : at + 4096, None] + x[None, :]).ravel() for x in np.triu_indices(k, 1))
                    ok = cls[i] != cls[j]
                    yield pairs(*_left(i[ok], j[ok], rough, counts, n, percent))
            large = varied & ((size > LEAF) | (side[start] >= 0))
            for s, e in zip(start[large], start[large] + size[large]):
                for i, j in CountTree(counts[s:e], n[s:e]).pairs(cls[s:e], percent, None if side[s] < 0 else side[s:e]):
                    yield pairs(s + i, s + j)

    return work


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (token, node, ...) with ``shard`` and ``side``: a token's rows are a shard (side -1); those of a crowded one meet in pairs of blocks, each pair of rows in one of them."""
    crowded = rows.groupBy("token").count().filter(F.col("count") > BLOCK).select("token", F.ceil(F.col("count") / (BLOCK // 2)).cast("int").alias("parts"))
    rows = rows.join(crowded, "token", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    one = F.array(F.struct(F.xxhash64("token").alias("shard"), F.lit(-1).alias("side")))
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    block = lambda o: F.struct(F.xxhash64("token", F.least(o, "part"), F.greatest(o, "part")).alias("shard"), F.when(o == F.col("part"), -1).otherwise(F.col("part")).alias("side"))
    return rows.withColumn("at", F.explode(F.when(F.col("parts").isNull(), one).otherwise(F.transform(other, block)))).select("*", "at.shard", "at.side").drop("at", "parts", "part")


def _with_sets(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """``pairs`` (a, b) with the sets of both (x, y), worked out for the documents in question alone."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    few = ids.count() <= BROADCAST_IDS

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                some = b.iloc[at : at + 1000]
                yield pd.DataFrame({"node": some["doc_id"], "v": [shingle_set(t, width).tobytes() for t in some["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.join(F.broadcast(ids) if few else ids, "doc_id")
    held = keep(chosen.mapInPandas(releasing(sets), f"node {kind}, v binary").dropDuplicates(["node"]))
    return pairs.join(held.select(F.col("node").alias("a"), F.col("v").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("v").alias("y")), "b").select("a", "b", "x", "y")


def _bounded(points: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bound on their points leaves."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ok = _bound(unpacked(b["x"]), unpacked(b["y"]), b["nx"].to_numpy(), b["ny"].to_numpy(), percent)
                yield b.loc[ok, ["a", "b"]]

    kind = points.schema["node"].dataType.simpleString()
    x = points.select(F.col("node").alias("a"), F.col("n").alias("nx"), F.col("counts").alias("x"))
    y = points.select(F.col("node").alias("b"), F.col("n").alias("ny"), F.col("counts").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "nx", "ny", "x", "y").mapInPandas(releasing(work), f"a {kind}, b {kind}")


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["x"], b["y"]):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.loc[ok, ["a", "b"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(_with_sets(docs, keep(pairs), width).mapInPandas(releasing(check), f"a {kind}, b {kind}"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each document; component_id is the least id reachable by links."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = keep(_summaries(docs, _frequent(docs, width), width, percent))
    nodes = known.filter("n > 0").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("node"))
    nodes = cut(nodes)
    whole = known.join(nodes.select("node"), known["doc_id"] == nodes["node"], "left_semi").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "node")

    # Shards: prefix shingles that more sets have, and there only sets with a neighbour of like size.
    near = Window.partitionBy("token").orderBy("n", "node")
    rows = whole.select("node", "n", "common", F.explode("prefix").alias("token"))
    rows = rows.withColumns({"n_before": F.lag("n").over(near), "n_after": F.lead("n").over(near)})
    alike = (100 * F.col("n_before") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("n_after"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int") if percent < 100 else F.col("n")
    rows = keep(rows.filter(F.coalesce(alike, F.lit(False))).select("token", "node", "n", band.alias("band"), "common"))
    points = keep(whole.join(rows.select("node").distinct(), "node", "left_semi").select("node", "n", "counts"))

    # Leaders: of the sets of like size in a shard, the one with most frequent shingles, which is the least changed of a group of copies.
    # Each set is compared with the leader that it meets most often, so a group mostly falls together by one pair a set.
    leaders = keep(rows.groupBy("token", "band").agg(F.max_by("node", F.struct("common", "node")).alias("leader"), F.count("*").alias("size")).filter("size > 1").select("token", "band", "leader"))
    met = rows.join(leaders, ["token", "band"]).filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("k"))
    met = met.groupBy("node").agg(F.max_by("leader", F.struct("k", "leader")).alias("leader"))
    first = _verified(docs, _bounded(points, met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), percent), width, percent)

    # The rest: pairs of classes that are still different, in as many shards as their sizes demand.
    placed = points.join(components(first), "node", "left").select("node", "counts", F.coalesce("component", "node").alias("cls"))
    shards = _dealt(rows.select("token", "node", "n")).join(placed, "node").repartition("shard").sortWithinPartitions("shard", "n", "node")
    found = shards.select("shard", "side", "node", "n", "cls", "counts").mapInPandas(releasing(_search(percent)), f"a {kind}, b {kind}, need long")
    rest = found.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("need").alias("need")).filter("k >= need").select("a", "b")
    links = first.union(_verified(docs, rest, width, percent))

    out = known.select("doc_id", "n", "sig1", "sig2").join(nodes, ["sig1", "sig2"], "left").join(components(links), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is their class's; repeated rows of it count once. Rows with a null id stay."""
    first = classes(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, **options).filter("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    rest = docs.filter(F.col(id_col).isNull())
    return docs.join(first, docs[id_col] == first["_first"]).select(*[docs[c] for c in docs.columns]).dropDuplicates([id_col]).union(rest)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.common import table

    return classes(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY ALL"""
