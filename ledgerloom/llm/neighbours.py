"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries search it greedily.

The graph holds, for each distinct vector, the K others with the largest
products known so far. It starts from a few trees of random planes: the top of
each is fitted on a bounded sample (``SAMPLE`` rows) and gives a code by which
all rows are range-partitioned (once more at random, so that no part stays
alone); a task splits its rows further and compares those of one leaf. Then
rounds of NN-descent follow: the neighbours of a node, in both directions, are
candidates for each other. A round joins each block of nodes with the vectors
of all their neighbours, multiplies those that share a node and sends each
vector its best new ones; the rounds end when few entries change.

A query opens the nodes of its beam, the best so far, that it hasn't opened
yet: a round joins them with the graph and scores what they list; when nothing
in the beam is left to open, the best of it are the result. A query whose
vector stands in the graph starts there, any other at the nearest nodes of the
sample. All rows are in the graph; products for the graph are of 16-bit
entries, products of the search are of the original ones, in doubles.

A node is listed by any number of others; NN-descent samples: of those that
list it, R take part by hash, and a node with more than 8 R of them is a
candidate in as many lists only. So no node gathers more than a few hundred
lists. Equal vectors are one node and come back as all their rows. A block
holds some thousand nodes by hash; its neighbours' vectors are a few MB.

Vectors that are null, empty, zero or hold null or non-finite entries, and rows
without an id, take no part. Of several vectors under one id the smallest
counts; repeated rows are one. Vectors of another length than the commonest
take no part. Ties go to the smaller id. Other columns of the input are
ignored. Without rows there are no results; with k or fewer candidates all come
back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, keep, releasing, table
from ledgerloom.llm.whitening import usable

SAMPLE, PART, LEAF, BLOCK_CELLS, QUERIES, AT_ONCE = 4_096, 8_192, 256, 262_144, 1_024, 64
#: The nodes of a block, in order, and their lists one after the other.
STATE = "block long, node array<long>, code binary, scale array<double>, size array<long>, ids array<long>, sims array<float>, fresh array<boolean>"
#: What a block knows of its nodes in a round: lists in both directions (what is fresh first), the least product that is news, the share of lists to take part in.
HELD = "part long, block long, node array<long>, code binary, scale array<double>, least array<float>, share array<float>, size array<long>, others array<long>, fresh array<boolean>"


@dataclass(frozen=True)
class Settings:
    """K neighbours a node, R of those that list it, trees at the start, rounds at most, the share of changes at which they end, beam of a search."""

    k: int = 40
    reverse: int = 40
    trees: int = 3
    rounds: int = 8
    settled: float = 0.05
    beam: int = 128
    search_rounds: int = 24


@dataclass(frozen=True)
class Index:
    """Written tables: blocks_of (block, node, v, size, ids), its nodes with their vectors and lists; vectors (node, v); graph (node, ids); rows (id, node). ``entries`` are (nodes, vectors) of the sample."""

    blocks_of: DataFrame
    graph: DataFrame
    vectors: DataFrame
    rows: DataFrame
    entries: tuple[np.ndarray, np.ndarray]
    blocks: int
    settings: Settings


# Lists in Arrow columns, and the best of each.


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, values) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False)


def as_lists(row: np.ndarray, count: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of ``count`` rows from values that are sorted by row."""
    offsets = np.searchsorted(row, np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def ranks(values: np.ndarray) -> np.ndarray:
    """The number of distinct smaller values."""
    order, out = np.argsort(values), np.zeros(len(values), dtype=np.int64)
    run = values[order]
    out[order[1:]] = np.cumsum(run[1:] != run[:-1])
    return out


def ordered(*keys: np.ndarray) -> np.ndarray:
    """Positions sorted by keys (whole, not negative; the first counts most), ties by position: as one number each where its bits suffice, which sorts many times faster."""
    n = len(keys[0])
    bits = [int(x.max(initial=0)).bit_length() for x in keys]
    place = n.bit_length()
    if sum(bits) + place > 63:
        return np.lexsort(keys[::-1])
    key = np.zeros(n, dtype=np.int64)
    for x, b in zip(keys, bits):
        key = (key << b) | x
    key = (key << place) | np.arange(n)
    key.sort()
    return key & ((1 << place) - 1)


def starting(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    first = np.zeros(len(sorted_keys[0]), dtype=bool)
    first[:1] = True
    for x in sorted_keys:
        first[1:] |= x[1:] != x[:-1]
    return first


def within(run: np.ndarray) -> np.ndarray:
    """The place of each entry in its run of equal ones, from 0."""
    first = starting(run)
    return np.arange(len(run)) - np.flatnonzero(first)[np.cumsum(first) - 1]


def leading(row: np.ndarray, id: np.ndarray, value: np.ndarray, k: int, prefer: np.ndarray | None = None) -> np.ndarray:
    """Positions of each row's k largest values (ties: smaller id), each id once (of equals, one that is preferred), sorted by row and rank."""
    falling = np.argsort(-value)
    # Small ids do as they are.
    id = id if len(id) and id.min() >= 0 and int(id.max()) < 1 << 24 else ranks(id)
    row, id, value = row[falling], id[falling], value[falling]
    worse = np.cumsum(starting(value)) if len(value) else np.zeros(0, dtype=np.int64)
    order = ordered(row, id) if prefer is None else ordered(row, id, ~prefer[falling])
    order = order[starting(row[order], id[order])]
    order = order[ordered(row[order], worse[order])]
    return falling[order[within(row[order]) < k]]


def dealt(part: np.ndarray) -> tuple[list, list[np.ndarray]]:
    """The parts that there are, and the positions of each."""
    order = ordered(part)
    start = np.flatnonzero(starting(part[order]))
    return part[order][start].tolist(), np.split(order, start[1:]) if len(order) else []


def decoded(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int16).reshape(-1, d)


def products(code: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Products of all pairs of rows, to float32's precision."""
    x = code.astype(np.float32) * scale.astype(np.float32)[..., None]
    return np.matmul(x, np.swapaxes(x, -1, -2))


# Nodes.


def distinct(df: DataFrame, id: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, a row an id, and the length of their vectors."""
    rows, d = usable(df, id, vector)
    rows = rows.filter(F.col("id").isNotNull() & F.exists("v", lambda c: c != 0)).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v")), d


def noded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, v) of the distinct vectors, named by their least id, and (id, node) of all rows."""
    classes = keep(rows.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("n")))
    repeated = classes.filter("n > 1").select("v", "node")
    return classes.select("node", "v"), keep(rows.join(repeated, "v", "left").select("id", F.coalesce("node", "id").alias("node")))


def coded(vectors: DataFrame, d: int) -> DataFrame:
    """(node, code, scale): entries in 16 bits, the largest of a vector at 32,767."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, d)
            scale = np.abs(x).max(axis=1) / 32_767
            codes = np.round(x / scale[:, None]).astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale)], names=["node", "code", "scale"])

    return vectors.mapInArrow(releasing(work), "node long, code binary, scale double")


# Trees of random planes.


@dataclass(frozen=True)
class Planes:
    """A complete tree of planes, a level after the other; ``route`` gives the number of the leaf."""

    normals: np.ndarray
    cuts: np.ndarray
    depth: int

    @classmethod
    def plant(cls, x: np.ndarray, depth: int, seed: int) -> Planes:
        random = np.random.default_rng(seed)
        normals, cuts = random.standard_normal((2**depth - 1, x.shape[1])), np.zeros(2**depth - 1)
        groups = {0: np.arange(len(x))}
        for place in range(len(cuts)):
            at = groups.pop(place)
            p = x[at] @ normals[place]
            cuts[place] = np.median(p) if len(p) else 0.0
            groups[2 * place + 1], groups[2 * place + 2] = at[p < cuts[place]], at[p >= cuts[place]]
        return cls(normals, cuts, depth)

    def route(self, x: np.ndarray) -> np.ndarray:
        place = np.zeros(len(x), dtype=int)
        for _ in range(self.depth):
            place = 2 * place + 1 + (np.einsum("ij,ij->i", x, self.normals[place]) >= self.cuts[place])
        return place - len(self.cuts)


def leaves(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """The rows in groups of at most LEAF, halved by random planes."""
    random, todo, out = np.random.default_rng(seed), [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        order = np.argsort(x[at] @ random.standard_normal(x.shape[1]), kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def planted(codes: DataFrame, planes: Planes | None, seed: int, parts: int, d: int, k: int) -> DataFrame:
    """(node, ids, sims): the best of each node's leaf in one tree; without planes its top deals rows at random."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = decoded(batch.column("code"), d) * np.asarray(batch.column("scale"))[:, None]
            yield batch.append_column("leaf", pa.array(planes.route(x)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("node")
        node, code, scale = t["node"].to_numpy(), decoded(t["code"], d), t["scale"].to_numpy()
        for at in leaves(code.astype(np.float32), seed):
            s = products(code[at], scale[at])
            np.fill_diagonal(s, -np.inf)
            most = min(k, len(at) - 1)
            best = np.argpartition(-s, most - 1, axis=1)[:, :most] if most else np.zeros((len(at), 0), dtype=int)
            row = np.repeat(np.arange(len(at)), most)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), as_lists(row, len(at), node[at][best].ravel(), pa.int64()), as_lists(row, len(at), np.take_along_axis(s, best, 1).ravel(), pa.float32())], names=["node", "ids", "sims"])

    routed = codes.mapInArrow(route, "node long, code binary, scale double, leaf long") if planes else codes.withColumn("leaf", F.lit(0))
    spread = routed.repartitionByRange(parts, "leaf", F.xxhash64("node"))
    return spread.mapInArrow(releasing(compare), "node long, ids array<long>, sims array<float>")


# NN-descent. The graph is kept a row a block, and so are the messages between blocks, so that a round moves few rows.


def part_of(id: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a node, by a hash of its id."""
    return ((id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def drawn(one: np.ndarray, other: np.ndarray, turn: int) -> np.ndarray:
    """A number below 2**24 for each pair, by a hash."""
    x = one.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + other.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(turn + 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
    return (x >> np.uint64(40)).astype(np.int64)


def flat(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def table_of(schema: str, **columns: list) -> pa.Table:
    """A table of ``schema``, a plain list of rows for each column; numpy arrays are lists."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.table({name: pa.array(columns.get(name, []), kinds[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))})


def paired(left: DataFrame, right: DataFrame, work, schema: str) -> DataFrame:
    """``work`` of both sides' rows with one ``to``, as a cogroup gives them; both go through one shuffle, so that the driver plans and starts half the stages."""
    names = [c for c in left.columns if c != "to"], [c for c in right.columns if c != "to"]
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)), allowMissingColumns=True)

    def run(t: pa.Table) -> pa.Table:
        return work(*(t.filter(pa.compute.equal(t["side"], i)).select(c) for i, c in enumerate(names)))

    return both.groupBy("to").applyInArrow(run, schema)


def to(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("to", F.col(column))


def tallied(df: DataFrame, measure: Column) -> tuple[DataFrame, int]:
    """The rows with no lineage behind them, and a sum or count that is observed as they are written."""
    seen = Observation()
    out = cut(df.observe(seen, measure.alias("n")))
    return out, seen.get["n"] or 0


def state_of(block: int, node: np.ndarray, code: bytes, scale: np.ndarray, row: np.ndarray, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray) -> pa.Table:
    return table_of(STATE, block=[block], node=[node], code=[code], scale=[scale], size=[np.bincount(row, minlength=len(node))], ids=[ids], sims=[sims], fresh=[fresh])


def packed(rows: DataFrame, d: int, blocks: int, k: int) -> DataFrame:
    """STATE from rows of (node, code, scale, ids, sims): each node's k best of all its rows; all are fresh."""
    def pack(t: pa.Table) -> pa.Table:
        coded_rows = t.filter(pa.compute.is_valid(t["code"])).sort_by("node")
        node = coded_rows["node"].to_numpy()
        row, ids = lists(t["ids"])
        sims, place = lists(t["sims"])[1], np.searchsorted(node, t["node"].to_numpy())[row]
        at = leading(place, ids, sims, k)
        return state_of(t["block"][0].as_py(), node, b"".join(coded_rows["code"].to_pylist()), coded_rows["scale"].to_numpy(), place[at], ids[at], sims[at], np.ones(len(at), dtype=bool))

    schema = "node long, code binary, scale double, ids array<long>, sims array<float>"
    return rows.mapInArrow(numbered(blocks), f"{schema}, block long").groupBy("block").applyInArrow(pack, STATE)


def links(blocks: int):
    """Each link of a state to the block of the node that it lists."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = pa.Table.from_batches([b.slice(i, 1)])
                node, ids, fresh = flat(t, "node"), flat(t, "ids"), flat(t, "fresh")
                source = np.repeat(node, flat(t, "size"))
                parts, cuts = dealt(part_of(ids, blocks))
                out = table_of("part long, target array<long>, source array<long>, new array<boolean>", part=parts, target=[ids[c] for c in cuts], source=[source[c] for c in cuts], new=[fresh[c] for c in cuts])
                yield from out.to_batches()

    return releasing(work)


def listed(state: pa.Table, back: pa.Table, blocks: int, turn: int, s: Settings) -> pa.Table:
    """HELD: the block's own row (part null), and a row for each block of what it needs of that block."""
    if not state.num_rows:
        return table_of(HELD)
    node, size, ids, sims, fresh = (flat(state, c) for c in ("node", "size", "ids", "sims", "fresh"))
    n, row = len(node), np.repeat(np.arange(len(node)), size)
    target, source, new = (flat(back, c) if back.num_rows else np.zeros(0, dtype=int) for c in ("target", "source", "new"))
    order = np.argsort(source, kind="stable")
    target, source, new = target[order], source[order], new[order].astype(bool)
    place = np.searchsorted(node, target)
    order = ordered(place, drawn(source, target, turn))
    place, source, new = place[order], source[order], new[order]
    taken = within(place) < s.reverse
    share = np.minimum(1.0, 8.0 * s.reverse / np.maximum(np.bincount(place, minlength=n), 1)).astype(np.float32)
    # A list stands in the order of its products.
    least = np.full(n, -np.inf, dtype=np.float32)
    least[size == s.k] = sims[(np.cumsum(size) - 1)[size == s.k]]
    row, others, fresh = np.concatenate([row, place[taken]]), np.concatenate([ids, source[taken]]), np.concatenate([fresh.astype(bool), new[taken]])
    # Who lists a node and is listed by it is one of its list.
    which = ranks(others)
    order = ordered(row, which, ~fresh)
    order = order[starting(row[order], which[order])]
    # A list without anything new has nothing to tell.
    alive = np.zeros(n, dtype=bool)
    alive[row[fresh]] = True
    order = order[alive[row[order]]]
    order = order[ordered(row[order], ~fresh[order])]
    row, others, fresh = row[order], others[order], fresh[order]
    wanted = np.sort(others)
    wanted = wanted[starting(wanted)]
    parts, cuts = dealt(part_of(wanted, blocks))
    cuts = [wanted[c] for c in cuts]
    block_, m, none = state["block"][0].as_py(), len(parts), [None] * len(parts)
    return table_of(
        HELD, part=[None, *parts], block=[block_] * (m + 1), node=[node, *none], code=[state["code"][0].as_py(), *none], scale=[flat(state, "scale"), *none], least=[least, *none], share=[share, *none],
        size=[np.bincount(row, minlength=n), *none], others=[others, *cuts], fresh=[fresh, *none])


GIVEN = "block long, other array<long>, code binary, scale array<double>, least array<float>, share array<float>"


def given(wanted: pa.Table, held: pa.Table, d: int) -> pa.Table:
    """What each block needs of this one: codes and what is news to them."""
    if not wanted.num_rows or not held.num_rows:
        return table_of(GIVEN)
    node, code = flat(held, "node"), decoded(held["code"], d)
    scale, least, share = (flat(held, c) for c in ("scale", "least", "share"))
    asked = [x.values.to_numpy() for x in wanted["others"]]
    at = [np.searchsorted(node, x) for x in asked]
    return table_of(GIVEN, block=wanted["block"].to_pylist(), other=asked, code=[code[a].tobytes() for a in at], scale=[scale[a] for a in at], least=[least[a] for a in at], share=[share[a] for a in at])


NEWS = "part long, node array<long>, found array<long>, value array<float>"


def met(held: pa.Table, known: pa.Table, d: int, blocks: int, k: int) -> pa.Table:
    """NEWS by block: for all that stand in one of the lists, the best that it meets there and doesn't know."""
    if not held.num_rows or not known.num_rows:
        return table_of(NEWS)
    id = flat(known, "other")
    order = np.argsort(id)
    id, m = id[order], len(id)
    least, share = (flat(known, c)[order] for c in ("least", "share"))
    # Two more entries: a product with the row after the last, which fills lists up, is below all.
    x = np.zeros((m + 1, d + 2), dtype=np.float32)
    x[:m, :d] = decoded(known["code"], d)[order] * flat(known, "scale").astype(np.float32)[order, None]
    x[:m, d], x[m, d + 1] = 1, np.finfo(np.float32).min
    least = np.append(least, np.float32(np.inf))
    node, size, others, fresh = flat(held, "node"), flat(held, "size"), flat(held, "others"), flat(held, "fresh").astype(bool)
    row = np.repeat(np.arange(len(node)), size)
    place = np.searchsorted(id, others)
    # Of very many lists a node takes part in its share.
    kept = drawn(others, node[row], 0) <= share[place] * (1 << 24)
    row, place, fresh = row[kept], place[kept], fresh[kept]
    width, many = np.bincount(row, minlength=len(node)), np.bincount(row[fresh], minlength=len(node))
    begin = np.cumsum(width) - width
    some = np.flatnonzero(many)
    some = some[ordered(many[some], width[some])]
    found: list[tuple[np.ndarray, ...]] = []
    for i in range(0, len(some), AT_ONCE):
        of = some[i : i + AT_ONCE]
        column, n_new = np.arange(width[of].max()), int(many[of].max())
        at = np.where(column < width[of, None], place[np.minimum(begin[of, None] + column, len(place) - 1)], m)
        new = np.where(column[:n_new] < many[of, None], at[:, :n_new], m)
        whole, part = x[at], x[new]
        # Sums of both further entries: what is real has 1 and 0, what fills up 0 and the least number.
        part[:, :, d:] = part[:, :, : d - 1 : -1]
        sims = np.matmul(part, whole.swapaxes(1, 2))
        sims[:, np.arange(n_new), np.arange(n_new)] = -np.inf
        # Those that are new learn of all, the others of those that are new.
        line, a, b = np.nonzero(sims > least[new][:, :, None])
        found.append((new[line, a], at[line, b], sims[line, a, b]))
        bar = np.where(column < many[of, None], np.float32(np.inf), least[at])
        line, a, b = np.nonzero(sims > bar[:, None, :])
        found.append((at[line, b], new[line, a], sims[line, a, b]))
        if len(found) >= 64:
            found = [best_of(found, k)]
    if not found:
        return table_of(NEWS)
    u, w, sims = best_of(found, k)
    real = w < m
    u, w, sims = u[real], w[real], sims[real]
    parts, cuts = dealt(part_of(id[u], blocks))
    return table_of(NEWS, part=parts, node=[id[u[c]] for c in cuts], found=[id[w[c]] for c in cuts], value=[sims[c] for c in cuts])


def best_of(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    u, w, sims = (np.concatenate(x) for x in zip(*found))
    at = leading(u, w, sims, k)
    return u[at], w[at], sims[at]


def renewed(state: pa.Table, news: pa.Table, k: int) -> pa.Table:
    """The state with what was found; ``fresh`` is what it didn't hold before."""
    if not state.num_rows:
        return table_of(STATE)
    node, ids, sims = (flat(state, c) for c in ("node", "ids", "sims"))
    row, old = np.repeat(np.arange(len(node)), flat(state, "size")), np.ones(len(ids), dtype=bool)
    if news.num_rows:
        more = flat(news, "found")
        row, ids, sims = np.concatenate([row, np.searchsorted(node, flat(news, "node"))]), np.concatenate([ids, more]), np.concatenate([sims, flat(news, "value")])
        old = np.concatenate([old, np.zeros(len(more), dtype=bool)])
    at = leading(row, ids, sims, k, old)
    return state_of(state["block"][0].as_py(), node, state["code"][0].as_py(), flat(state, "scale"), row[at], ids[at], sims[at], ~old[at])


#: GIVEN, and of the block's own row what it needs to compare.
KNOWN = f"{GIVEN}, node array<long>, size array<long>, others array<long>, fresh array<boolean>"


def answered(t: pa.Table, d: int) -> pa.Table:
    """KNOWN: what each block needs of this one, and its own row (``other`` null) for the next step."""
    alone = pa.compute.is_null(t["part"])
    own = t.filter(alone)
    known = given(t.filter(pa.compute.invert(alone)).select(["part", "block", "others"]), own, d)
    kinds = table_of(KNOWN).schema
    mine = pa.schema([kinds.field(c) for c in ("block", "node", "size", "others", "fresh")])
    return pa.concat_tables([known, own.select(mine.names).cast(mine)], promote_options="default")


def descended(state: DataFrame, d: int, blocks: int, turn: int, s: Settings) -> DataFrame:
    """The graph after one round: four steps, a shuffle each, the last with the graph as it was."""
    back = state.mapInArrow(links(blocks), "part long, target array<long>, source array<long>, new array<boolean>")
    held = paired(to(state, "block"), to(back, "part"), lambda a, b: listed(a, b, blocks, turn, s), HELD)
    known = held.groupBy(F.coalesce("part", "block")).applyInArrow(lambda t: answered(t, d), KNOWN)
    news = known.groupBy("block").applyInArrow(lambda t: met(t.filter(pa.compute.is_valid(t["node"])), t.filter(pa.compute.is_valid(t["other"])), d, blocks, s.k), NEWS)
    return paired(to(state, "block"), to(news, "part"), lambda a, b: renewed(a, b, s.k), STATE)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ids) of a state."""
    for b in batches:
        for i in range(b.num_rows):
            t = pa.Table.from_batches([b.slice(i, 1)])
            node, size = flat(t, "node"), flat(t, "size")
            yield pa.RecordBatch.from_arrays([pa.array(node), as_lists(np.repeat(np.arange(len(node)), size), len(node), flat(t, "ids"), pa.int64())], names=["node", "ids"])


def numbered(blocks: int):
    """Rows of nodes with the block of each."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("block", pa.array(part_of(b.column("node").to_numpy(), blocks)))

    return work


def completed(rows: pa.Table, state: pa.Table) -> pa.Table:
    """A block's nodes with their original vectors and their lists."""
    rows = rows.sort_by("node")
    return pa.table({"block": pa.array([state["part"][0].as_py()]), **{c: pa.array([flat(t, c) if c != "node" else flat(state, c)], pa.list_(kind)) for c, t, kind in (("node", state, pa.int64()), ("v", rows, pa.float64()), ("size", state, pa.int64()), ("ids", state, pa.int64()))}})


def build(df: DataFrame, id: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> Index | None:
    """The index of all usable rows; None without any."""
    rows, d = distinct(df, id, vector)
    if not d:
        return None
    vectors, members = noded(rows)
    n = vectors.count()
    if not n:
        return None
    s, blocks = settings, -(-n * d // BLOCK_CELLS)
    codes = keep(coded(vectors, d))
    sample = vectors.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    entries = np.array([r.node for r in sample]), np.array([r.v for r in sample])
    depth = min(6, max(0, (len(sample) // 64).bit_length() - 1))
    first = codes.select("node", "code", "scale", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("sims"))
    # The last deals at random, so that what the planes part is linked from the start.
    for seed in range(s.trees + 1):
        grown = planted(codes, Planes.plant(entries[1], depth, seed) if seed < s.trees else None, seed, -(-n // PART), d, s.k)
        first = first.union(grown.select("node", F.lit(None).cast("binary"), F.lit(None).cast("double"), "ids", "sims"))
    state = cut(packed(first, d, blocks, s.k))
    for turn in range(s.rounds):
        state, fresh = tallied(descended(state, d, blocks, turn, s), F.sum(F.size(F.filter("fresh", lambda f: f))))
        if fresh <= s.settled * n * s.k:
            break
    graph = keep(state.mapInArrow(unpacked, "node long, ids array<long>"))
    whole = vectors.mapInArrow(numbered(blocks), "node long, v array<double>, block long").groupBy("block").cogroup(state.withColumnRenamed("block", "part").groupBy("part"))
    blocks_of = keep(whole.applyInArrow(completed, "block long, node array<long>, v array<double>, size array<long>, ids array<long>"))
    return Index(blocks_of, graph, vectors, members, entries, blocks, s)


# Search. Queries are kept in blocks like nodes, with their beams; what goes between the two are lists of ids and products.

BEAMS = "block long, query array<long>, v array<double>, size array<long>, ids array<long>, sims array<double>, opened array<boolean>, asks array<long>, todo array<long>"
ASKED = "part long, block long, query array<long>, node array<long>"
HEARD = "block long, query array<long>, node array<long>"
POSED = "part long, block long, query array<long>, v array<double>, least array<double>, size array<long>, node array<long>"
SCORED = "block long, query array<long>, node array<long>, value array<double>"


def beams_of(block: int, query: np.ndarray, v: np.ndarray, row: np.ndarray, ids: np.ndarray, sims: np.ndarray, opened: np.ndarray, asking: np.ndarray, todo: np.ndarray) -> pa.Table:
    n = len(query)
    return table_of(BEAMS, block=[block], query=[query], v=[v.ravel()], size=[np.bincount(row, minlength=n)], ids=[ids], sims=[sims], opened=[opened], asks=[np.bincount(asking, minlength=n)], todo=[todo])


def gathered(rows: pa.Table) -> pa.Table:
    """BEAMS of the queries of one block: nothing found, the starts to do."""
    rows = rows.sort_by("query")
    asking, todo = lists(rows["starts"])
    none = np.zeros(0, dtype=int)
    return beams_of(rows["block"][0].as_py(), rows["query"].to_numpy(), flat(rows, "v"), none, none, none.astype(float), none.astype(bool), asking, todo)


def asking(blocks: int):
    """What is to open, to the blocks that list it."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = pa.Table.from_batches([b.slice(i, 1)])
                todo = flat(t, "todo")
                if len(todo):
                    query = np.repeat(flat(t, "query"), flat(t, "asks"))
                    parts, cuts = dealt(part_of(todo, blocks))
                    yield from table_of(ASKED, part=parts, block=[t["block"][0].as_py()] * len(parts), query=[query[c] for c in cuts], node=[todo[c] for c in cuts]).to_batches()

    return releasing(work)


def heard(asked: pa.Table, held: pa.Table) -> pa.Table:
    """What the nodes that each block of queries asks for list."""
    if not asked.num_rows or not held.num_rows:
        return table_of(HEARD)
    node, size, ids = flat(held, "node"), flat(held, "size"), flat(held, "ids")
    begin, which = np.concatenate([[0], np.cumsum(size)]), ranks(ids)
    out_query, out_node = [], []
    for i in range(asked.num_rows):
        query, at = asked["query"][i].values.to_numpy(), np.searchsorted(node, asked["node"][i].values.to_numpy())
        many = size[at]
        place = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        # What a block asks stands by query.
        line = np.repeat(np.cumsum(starting(query)) - 1, many)
        order = ordered(line, which[place])
        order = order[starting(line[order], which[place[order]])]
        out_query.append(np.repeat(query, many)[order])
        out_node.append(ids[place[order]])
    return table_of(HEARD, block=asked["block"].to_pylist(), query=out_query, node=out_node)


def posed(beams: pa.Table, told: pa.Table, blocks: int, width: int) -> pa.Table:
    """POSED: the nodes that a query hasn't scored in its beam, to the blocks that hold their vectors, with the queries' vectors."""
    if not beams.num_rows or not len(todo := flat(beams, "todo")):
        return table_of(POSED)
    query, v, size, ids, sims = (flat(beams, c) for c in ("query", "v", "size", "ids", "sims"))
    n, row = len(query), np.repeat(np.arange(len(query)), size)
    v = v.reshape(n, -1)
    low = np.full(n, np.inf)
    np.minimum.at(low, row, sims)
    least = np.where(size >= width, low, -np.inf)
    listed_row = np.searchsorted(query, flat(told, "query")) if told.num_rows else np.zeros(0, dtype=int)
    r = np.concatenate([row, listed_row, np.repeat(np.arange(n), flat(beams, "asks"))])
    x = np.concatenate([ids, flat(told, "node") if told.num_rows else ids[:0], todo])
    known = np.arange(len(r)) < len(row)
    which = ranks(x)
    order = ordered(r, which, ~known)
    order = order[starting(r[order], which[order])]
    order = order[~known[order]]
    r, x = r[order], x[order]
    parts, cuts = dealt(part_of(x, blocks))
    some = [(r[c][begin], np.diff(begin, append=len(c))) for c in cuts for begin in [np.flatnonzero(starting(r[c]))]]
    return table_of(POSED, part=parts, block=[beams["block"][0].as_py()] * len(parts), query=[query[q] for q, _ in some], v=[v[q].ravel() for q, _ in some], least=[least[q] for q, _ in some], size=[m for _, m in some], node=[x[c] for c in cuts])


def scored(asked: pa.Table, held: pa.Table, beam: int) -> pa.Table:
    """Of the nodes that each query asks of one block, those that are better than its beam's last."""
    if not asked.num_rows or not held.num_rows:
        return table_of(SCORED)
    node, out = flat(held, "node"), []
    x = flat(held, "v").reshape(len(node), -1)
    for i in range(asked.num_rows):
        query, size, ids = (asked[c][i].values.to_numpy() for c in ("query", "size", "node"))
        v, row = asked["v"][i].values.to_numpy().reshape(len(query), -1), np.repeat(np.arange(len(query)), size)
        place, sims = np.searchsorted(node, ids), np.empty(len(ids))
        for j in range(0, len(ids), 65_536):
            s = slice(j, j + 65_536)
            sims[s] = np.einsum("ij,ij->i", x[place[s]], v[row[s]])
        good = np.flatnonzero(sims > asked["least"][i].values.to_numpy()[row])
        at = good[leading(row[good], ids[good], sims[good], beam)]
        out.append((query[row[at]], ids[at], sims[at]))
    return table_of(SCORED, block=asked["block"].to_pylist(), query=[o[0] for o in out], node=[o[1] for o in out], value=[o[2] for o in out])


def advanced(beams: pa.Table, found: pa.Table, width: int) -> pa.Table:
    """The beams with what was found; what they held before counts as opened, the rest is to do."""
    if not beams.num_rows:
        return table_of(BEAMS)
    query, ids, sims = (flat(beams, c) for c in ("query", "ids", "sims"))
    row, opened = np.repeat(np.arange(len(query)), flat(beams, "size")), np.ones(len(ids), dtype=bool)
    if found.num_rows:
        more = flat(found, "node")
        row, ids, sims = np.concatenate([row, np.searchsorted(query, flat(found, "query"))]), np.concatenate([ids, more]), np.concatenate([sims, flat(found, "value")])
        opened = np.concatenate([opened, np.zeros(len(more), dtype=bool)])
    at = leading(row, ids, sims, width, opened)
    row, ids, sims, opened = row[at], ids[at], sims[at], opened[at]
    return beams_of(beams["block"][0].as_py(), query, flat(beams, "v"), row, ids, sims, opened, row[~opened], ids[~opened])


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, ids, sims) of the beams."""
    for b in batches:
        for i in range(b.num_rows):
            t = pa.Table.from_batches([b.slice(i, 1)])
            query, size = flat(t, "query"), flat(t, "size")
            row, n = np.repeat(np.arange(len(query)), size), len(query)
            yield pa.RecordBatch.from_arrays([pa.array(query), as_lists(row, n, flat(t, "ids"), pa.int64()), as_lists(row, n, flat(t, "sims"), pa.float64())], names=["query", "ids", "sims"])


def greedy(index: Index, starts: DataFrame, count: int) -> DataFrame:
    """(query, ids, sims): the beam of each row of (query, v, starts), ``count`` in all, when nothing in it is left to open."""
    width, blocks, held = index.settings.beam, index.blocks, index.blocks_of
    state = starts.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(1, -(-count // QUERIES))))).groupBy("block").applyInArrow(gathered, BEAMS)
    state = cut(state)
    listing, vectors = (to(held.select("block", "node", *c), "block") for c in (("size", "ids"), ("v",)))
    for _ in range(index.settings.search_rounds if count else 0):
        told = paired(to(state.mapInArrow(asking(blocks), ASKED), "part"), listing, heard, HEARD)
        new = paired(to(state, "block"), to(told, "block"), lambda a, b: posed(a, b, blocks, width), POSED)
        found = paired(to(new, "part"), vectors, lambda a, b: scored(a, b, width), SCORED)
        state, todo = tallied(paired(to(state, "block"), to(found, "block"), lambda a, b: advanced(a, b, width), BEAMS), F.sum(F.size("todo")))
        if not todo:
            break
    return state.mapInArrow(finished, "query long, ids array<long>, sims array<double>")


def nearest(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (query_id), ids of indexed rows: the k nearest other rows found."""
    asked = keep(queries.select("query_id").distinct().join(index.rows.select(F.col("id").alias("query_id"), "node"), "query_id"))
    own, count = tallied(asked.select(F.col("node").alias("query")).distinct(), F.count("*"))
    starts = own.join(index.vectors.withColumnRenamed("node", "query"), "query").join(index.graph.withColumnRenamed("node", "query"), "query").select("query", "v", F.concat(F.array("query"), "ids").alias("starts"))
    found = greedy(index, starts, count).select("query", F.explode(F.arrays_zip("ids", "sims")).alias("x")).select("query", F.col("x.ids").alias("node"), F.col("x.sims").alias("score"))
    return expanded(index, asked, found, k)


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors of any origin (query_id, v), ids unique and vectors of the index's length: the k nearest rows found."""
    nodes, x = index.entries
    most = min(8, len(nodes))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(-1, x.shape[1])
            best = np.argpartition(-(v @ x.T), most - 1, axis=1)[:, :most]
            yield batch.append_column("starts", as_lists(np.repeat(np.arange(len(v)), most), len(v), nodes[best].ravel(), pa.int64()))

    rows = queries.select(F.col("query_id").cast("long").alias("query"), F.col("v").cast("array<double>").alias("v")).filter(F.size("v") == x.shape[1])
    found = greedy(index, rows.mapInArrow(start, "query long, v array<double>, starts array<long>"), rows.count())
    found = found.select("query", F.explode(F.arrays_zip("ids", "sims")).alias("x")).select("query", F.col("x.ids").alias("node"), F.col("x.sims").alias("score"))
    return expanded(index, rows.select(F.col("query").alias("query_id"), F.col("query").alias("node")), found, k, False)


def expanded(index: Index, asked: DataFrame, found: DataFrame, k: int, but_itself: bool = True) -> DataFrame:
    """Found nodes as rows, for each query but itself; equal vectors were searched for once."""
    place = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    copies = index.rows.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("node").agg(F.collect_list("id").alias("copies"))
    rows = found.join(copies.filter(F.size("copies") > 1), "node", "left").select("query", "score", F.explode(F.coalesce("copies", F.array("node"))).alias("vec_id"))
    order = [F.desc("score"), F.col("vec_id")]
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("place") <= k + 1)
    each = asked.join(best.groupBy("query").agg(F.collect_list(F.struct("score", "vec_id")).alias("best")).withColumnRenamed("query", "node"), "node")
    each = each.select("query_id", F.explode("best").alias("x")).select("query_id", "x.score", "x.vec_id")
    each = each.filter("vec_id <> query_id") if but_itself else each
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    index = build(df)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return nearest(index, df.select(F.col("vec_id").alias("query_id")).filter("query_id % 20 = 0"))
