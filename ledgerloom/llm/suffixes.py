"""Removal of long repeats by a sparse suffix array, sorted deep-shallow.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere
else too. Every such string has an anchor, the place in it whose KMER bytes hash
lowest, which equal strings have at the same offset. So only the suffixes (and
reversed prefixes) at anchors are sorted, a shard per anchor content. Multikey
quicksort steps order them eight bytes at a time to a shallow depth; groups
that are still equal there are ordered by blind tries. Runs of the sorted
orders with common prefixes long enough on both sides are the repeats.

Anchors whose content stands once in the corpus are dropped by a count. Equal
surroundings are one row each before anything is sorted, however many copies
there are; surroundings of one anchor content that are too many for a task are
matched by the hashes of their strings in a grouping instead.

A null text counts as empty. Ids tell rows apart; rows with one id must be
copies of one another (null ids are told apart by their texts). Texts shorter
than LENGTH lose nothing. Empty input gives empty output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, keep
from ledgerloom.llm.jaccard import _blocks
from ledgerloom.llm.shingles import _pow, mix

LENGTH, KMER = 200, 64
REACH = LENGTH - KMER
#: Bytes that the word-wise steps look at; groups equal so far go to tries.
SHALLOW = 32
#: Windows handled at once; a longer text is several stretches that overlap.
STRETCH = 1 << 22
#: Distinct surroundings of one anchor that a task sorts; beyond, strings are grouped by hash.
MOST = 16_384


def _range_hash(total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((total[stop] - total[start]) * _pow(len(total))[1][start] + (stop - start).astype(np.uint64))


def _totals(b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _pow(len(b) + 1)[0][: len(b)], out=total[1:])
    return total


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its place, the bytes before it and from it on that its windows cover, content hash, surroundings hash."""
    found: list[tuple] = []
    for begin in range(0, max(0, len(data) - LENGTH + 1), STRETCH):
        b = np.frombuffer(data[begin : begin + STRETCH + LENGTH - 1], dtype=np.uint8)
        total, at = _totals(b), np.arange(len(b) - KMER + 1)
        h = _range_hash(total, at, at + KMER)
        low = (h >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
        width, size = 1, REACH + 1
        while 2 * width <= size:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = size - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((new[1:], [len(place)])) - 1
        a = place[new]
        before, after = a - new, last + LENGTH - a
        around = _range_hash(total, new, last + LENGTH) + before.astype(np.uint64)
        found.append((a + begin, before, after, h[a], mix(around)))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


class BlindTrie:
    """Orders byte strings of one length. An inner node knows where its strings first differ and the byte each child has there.

    An insertion goes down by those bytes alone to some leaf, compares once,
    and then goes down again to the depth where the strings part.
    """

    def __init__(self, first: bytes, name: int):
        self.root: list = [first, [name]]

    def insert(self, s: bytes, name: int) -> None:
        node = self.root
        while isinstance(node[1], dict):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if s == other:
            node[1].append(name)
            return
        n = len(s)
        depth = n - ((int.from_bytes(s, "big") ^ int.from_bytes(other, "big")).bit_length() + 7) // 8
        node, parent, edge = self.root, None, 0
        while isinstance(node[1], dict) and node[0] < depth:
            parent, edge = node, s[node[0]]
            node = node[1][edge]
        if isinstance(node[1], dict) and node[0] == depth:
            node[1][s[depth]] = [s, [name]]
            return
        new = [depth, {other[depth]: node, s[depth]: [s, [name]]}]
        if parent is None:
            self.root = new
        else:
            parent[1][edge] = new

    def names(self) -> list[int]:
        """All names in the order of their strings."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node[1], dict):
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
            else:
                out += node[1]
        return out


def deep_shallow(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows within their groups, and each row's common prefix with the one before it (-1 at a group's first)."""
    m, n = rows.shape
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -n % 8)))).view(">u8").astype(np.uint64)
    order, cls = np.argsort(group, kind="stable"), None
    cls = np.cumsum(np.concatenate(([0], (group[order][1:] != group[order][:-1]).astype(np.int64)))) if m else order
    for d in range(min(SHALLOW // 8, words.shape[1])):
        # One step for every class at once: the word at this depth orders the rows that are equal so far.
        w = words[order, d]
        step = np.lexsort((w, cls))
        order, w, cls = order[step], w[step], cls[step]
        cls = np.cumsum(np.concatenate(([0], ((cls[1:] != cls[:-1]) | (w[1:] != w[:-1])).astype(np.int64)))) if m else cls
    cuts = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1], [True]))) if m else np.zeros(1, dtype=np.int64)
    long = np.flatnonzero(np.diff(cuts) > 1)
    for s, e in zip(cuts[long].tolist(), cuts[long + 1].tolist()):
        names = order[s:e].tolist()
        trie = BlindTrie(rows[names[0]].tobytes(), names[0])
        for name in names[1:]:
            trie.insert(rows[name].tobytes(), name)
        order[s:e] = trie.names()
    common = np.full(m, -1, dtype=np.int64)
    for at in range(1, m, 1 << 16):
        x, y = order[at - 1 : at - 1 + (1 << 16)][: m - at], order[at : at + (1 << 16)]
        differ = rows[x] != rows[y]
        length = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
        common[at : at + (1 << 16)] = np.where(group[x] == group[y], length, -1)
    return order, common


def repeats(group: np.ndarray, before: np.ndarray, after: np.ndarray, around: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each surroundings, how many bytes before and from the anchor on lie in strings that another of its group has too; (0, 0) if none."""
    m = len(group)
    left, right = np.zeros((m, REACH), dtype=np.uint8), np.zeros((m, REACH), dtype=np.uint8)
    for i, s in enumerate(around):
        x = np.frombuffer(s, dtype=np.uint8)
        left[i, : before[i]] = x[: before[i]][::-1]
        tail = x[before[i] + KMER :]
        right[i, : len(tail)] = tail
    (lo, lc), (ro, rc) = deep_shallow(left, group), deep_shallow(right, group)
    most, least = np.full(m, -1), np.full(m, REACH + 1)
    for n in range(REACH + 1):
        here = np.flatnonzero((before >= n) & (after >= LENGTH - n))
        if len(here) < 2:
            continue
        lcls, rcls = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
        lcls[lo], rcls[ro] = np.cumsum(lc < n), np.cumsum(rc < REACH - n)
        key = lcls[here] * (m + 1) + rcls[here]
        step = np.argsort(key, kind="stable")
        same = key[step][1:] == key[step][:-1]
        hit = here[step[np.concatenate(([False], same)) | np.concatenate((same, [False]))]]
        most[hit] = n
        least[hit] = np.minimum(least[hit], n)
    found = most >= 0
    return np.where(found, most, 0), np.where(found, LENGTH - least, 0)


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _blocks(batches, "key"):
        key = b["key"].to_numpy()
        low, high = repeats(np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))), b["before"].to_numpy().astype(np.int64), b["after"].to_numpy().astype(np.int64), b["bytes"].tolist())
        yield pd.DataFrame({"key": key, "ctx": b["ctx"], "low": low, "high": high}).loc[high > 0]


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each string of LENGTH bytes of each surroundings, by two hashes."""
    for b in batches:
        for key, ctx, before, after, s in zip(b["key"], b["ctx"], b["before"], b["after"], b["bytes"]):
            total = _totals(np.frombuffer(s, dtype=np.uint8))
            start = np.arange(0, len(s) - LENGTH + 1)
            one, half = _range_hash(total, start, start + LENGTH), _range_hash(total, start, start + LENGTH // 2)
            yield pd.DataFrame({"key": key, "ctx": ctx, "n": before - start, "one": one.astype(np.int64), "two": half.astype(np.int64)})


def _anchor_rows(rows: DataFrame) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                some = b.iloc[at : at + 500]
                made = [anchors((t or "").encode("utf-8", "surrogatepass")) for t in some["text"]]
                place, before, after, key, ctx = (np.concatenate(x) for x in zip(*made))
                yield pd.DataFrame({"rid": np.repeat(some["rid"].to_numpy(), [len(x[0]) for x in made]), "pos": place << 16 | before << 8 | (after - KMER), "key": key.astype(np.int64), "ctx": ctx.astype(np.int64)})

    return rows.select("rid", "text").mapInPandas(work, "rid long, pos long, key long, ctx long")


def removed_spans(rows: DataFrame) -> DataFrame:
    """(rid, spans): of each row (rid, text) with repeats, the stretches that repeats cover, as encoded place, bytes before and bytes from it on."""
    spots = _anchor_rows(rows)
    keys = spots.groupBy("key").agg(F.count("*").alias("n"), F.min("ctx").alias("a"), F.max("ctx").alias("b")).filter("n > 1").select("key", (F.col("a") != F.col("b")).alias("mixed"))
    known = keep(spots.join(keys, "key"))
    whole = known.filter("not mixed").select("rid", (F.shiftright("pos", 16)).alias("at"), F.shiftright("pos", 8).bitwiseAND(255).alias("low"), (F.col("pos").bitwiseAND(255) + KMER).alias("high"))
    mixed = known.filter("mixed").groupBy("key", "ctx").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "pos")).alias("one"))
    mixed = mixed.select("key", "ctx", "copies", "one.rid", "one.pos")
    wanted = mixed.groupBy("rid").agg(F.collect_list(F.struct("key", "ctx", "copies", "pos")).alias("spots"))

    def surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, spots in zip(b["text"], b["spots"]):
                data, out = text.encode("utf-8", "surrogatepass"), []
                for s in spots:
                    at, before, after = s["pos"] >> 16, s["pos"] >> 8 & 255, (s["pos"] & 255) + KMER
                    out.append((s["key"], s["ctx"], s["copies"], before, after, data[at - before : at + after]))
                yield pd.DataFrame(out, columns=["key", "ctx", "copies", "before", "after", "bytes"])

    held = keep(rows.select("rid", "text").join(wanted, "rid").dropDuplicates(["rid"]).mapInPandas(surroundings, "key long, ctx long, copies long, before int, after int, bytes binary"))
    crowded = cut(held.groupBy("key").count().filter(F.col("count") > MOST).select("key"))
    solved = held.join(crowded, "key", "left_anti").repartition("key").sortWithinPartitions("key", "ctx").select("key", "ctx", "before", "after", "bytes").mapInPandas(_solve, "key long, ctx long, low long, high long")
    strings = held.join(crowded, "key", "left_semi").select("key", "ctx", "before", "after", "bytes").mapInPandas(_hashed, "key long, ctx long, n int, one long, two long")
    twice = strings.groupBy("key", "n", "one", "two").agg(F.count("*").alias("k")).filter("k > 1").drop("k")
    grouped = strings.join(twice, ["key", "n", "one", "two"]).groupBy("key", "ctx").agg(F.max("n").cast("long").alias("low"), (LENGTH - F.min("n")).cast("long").alias("high"))
    # Surroundings that stand twice are repeats as a whole.
    copied = held.filter("copies > 1").select("key", "ctx", F.col("before").cast("long").alias("low"), F.col("after").cast("long").alias("high"))
    extents = solved.union(grouped).union(copied).groupBy("key", "ctx").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    part = known.filter("mixed").join(extents, ["key", "ctx"]).select("rid", (F.shiftright("pos", 16)).alias("at"), "low", "high")
    return whole.union(part).groupBy("rid").agg(F.collect_list(F.struct((F.col("at") - F.col("low")).alias("start"), (F.col("at") + F.col("high")).alias("stop"))).alias("spans"))


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching stretches made one, in order."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, stops)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 for each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    rows = rows.withColumn("rid", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")) if whole else F.xxhash64("doc_id", "text"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, spans in zip(b["text"], b["spans"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                gone = merged([s["start"] for s in spans], [s["stop"] for s in spans]) if spans is not None else []
                at, kept = 0, []
                for s, e in gone:
                    kept.append(data[at:s])
                    at = e
                left = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(left), len(gone), left, hashlib.sha256(left).hexdigest()))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]).assign(doc_id=b["doc_id"].to_numpy())

    spans = removed_spans(rows)
    return rows.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInPandas(work, f"n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, doc_id {kind}")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.common import table

    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
