"""Chroma fingerprints of audio columns, and the recordings they align.

Sound becomes pitch-class frames; on the integral image of a recording's
frames, box filters compare neighbouring stretches of time and pitch, and
sixteen of them, two bits each, are one packed integer a frame. Two recordings
are aligned by the histogram of offsets at which their integers agree, and
linked if at the best offset the share of differing bits stays small.

Equal fingerprints are one node. A link needs LEAST_VOTES places that agree at
one offset. Two such places next to each other are then at most a seventh of
the shorter recording apart, so linked recordings share a key: two non-zero
integers and the step between them. Integers that no other recording has are
left out before keys are made. Between two recordings of over LONG frames steps
may be longer than keys are made for; those share as many occurrences of single
integers, of which each leaves out the few that stand in most recordings, as
long as LEAST_SHARED must be shared of the rest. Neighbours among the recordings
with one key are aligned first and become classes, then all candidates of
different classes, so no link between classes is lost. A key of very many
recordings is dealt out in pairs of blocks; all its pairs of different classes
are still counted.

Audio is 16-bit mono PCM. Null and empty audio, and audio shorter than a frame,
has no fingerprint and is a class of its own. Ids must be unique but for
repeated rows. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, cut, keep
from ledgerloom.llm.shingles import mix

RATE, FRAME, HOP = 4000, 512, 256
#: The least agreeing frames and most differing bits of a link.
LEAST_VOTES, MOST_ERROR = 8, 0.2
#: Frames up to which steps cover every link; beyond, single integers help.
LONG = 256
#: Occurrences of single integers that a candidate shares at least, once each recording's LEAST_VOTES - LEAST_SHARED commonest are left out; recordings in a block of one key.
LEAST_SHARED, BLOCK = 2, 1024
#: Box filters as (kind, first pitch class, pitch classes, frames), made by rule: three kinds over stretches of the octave.
FILTERS = tuple((i % 3, (5 * i) % 9, 3 + i % 2, 2 + 2 * (i % 4)) for i in range(16))
#: Borders between the two-bit levels of a filter's value, and the Gray code of the levels.
LEVELS, GRAY = (-0.15, 0.0, 0.15), np.array([0, 1, 3, 2], dtype=np.uint32)


def chroma(pcm: bytes | None, rate: int = RATE) -> np.ndarray:
    """A row of twelve pitch-class shares for each frame; zeros where it is silent."""
    x = np.frombuffer((pcm or b"")[: len(pcm or b"") // 2 * 2], dtype="<i2").astype(np.float32)
    if len(x) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins = np.fft.rfftfreq(FRAME, 1 / rate)
    used = (bins >= 110) & (bins <= 1760)
    pitch = np.round(12 * np.log2(bins[used] / 440.0)).astype(int) % 12
    fold = (pitch[:, None] == np.arange(12)[None, :]).astype(np.float64)
    out = np.zeros((len(frames), 12))
    window = np.hanning(FRAME).astype(np.float32)
    for at in range(0, len(frames), 4096):
        power = np.abs(np.fft.rfft(frames[at : at + 4096] * window, axis=1)[:, used]) ** 2
        out[at : at + 4096] = power @ fold
    total = out.sum(axis=1, keepdims=True)
    return np.where(total > 1.0, out / np.maximum(total, 1e-9), 0.0)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """A packed integer for each frame at which all filters fit; 0 for a silent one."""
    width = max(f[3] for f in FILTERS)
    n = len(frames) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint32)
    total = np.zeros((len(frames) + 1, 13))
    total[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def box(t0, t1, p0, p1):
        return total[t1, p1] - total[t0, p1] - total[t1, p0] + total[t0, p0]

    out = np.zeros(n, dtype=np.uint32)
    for i, (kind, p, high, wide) in enumerate(FILTERS):
        whole = box(t, t + wide, p, p + high)
        if kind == 0:  # first half of the time against the second
            part = box(t, t + wide // 2, p, p + high)
        elif kind == 1:  # lower half of the pitches against the upper
            part = box(t, t + wide, p, p + high // 2)
        else:  # both ways, as a chequer
            part = box(t, t + wide // 2, p, p + high // 2) + box(t + wide // 2, t + wide, p + high // 2, p + high)
        out |= GRAY[np.searchsorted(LEVELS, np.log1p(4 * part) - np.log1p(4 * (whole - part)))] << np.uint32(2 * i)
    silent = box(t, t + width, 0, 12) < 0.5
    return np.where(silent, 0, out).astype(np.uint32)


def align(x: np.ndarray, y: np.ndarray) -> tuple[int, int, float]:
    """Offset of y against x by the most agreeing integers (the least offset on ties), how many agree, share of differing bits."""
    if not len(x) or not len(y):
        return 0, 0, 1.0
    order = np.argsort(x, kind="stable")
    lo, hi = np.searchsorted(x[order], y, "left"), np.searchsorted(x[order], y, "right")
    hi = np.where(y == 0, lo, hi)
    votes = np.zeros(len(x) + len(y), dtype=np.int64)
    for k in range(int((hi - lo).max(initial=0))):
        j = np.flatnonzero(lo + k < hi)
        np.add.at(votes, order[lo[j] + k] - j + len(y), 1)
    best = int(votes.argmax()) - len(y)
    if not votes.max():
        return 0, 0, 1.0
    a, b = x[max(best, 0) :], y[max(-best, 0) :]
    n = min(len(a), len(b))
    return best, int(votes.max()), float(np.bitwise_count(a[:n] ^ b[:n]).sum()) / (32 * n)


def fingerprints(recordings: DataFrame, id_col: str, audio_col: str, rate: int = RATE, decode: Callable[[object], bytes | None] | None = None) -> DataFrame:
    """id, n_frames, print (the integers as bytes) of each recording. ``decode`` makes a cell PCM, one at a time, so that no batch of PCM is ever held."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [fingerprint(chroma(a if decode is None else decode(a), rate)) for a in b["audio"]]
            yield pd.DataFrame({"id": b["id"].to_numpy(), "n_frames": [len(m) for m in made], "print": [m.tobytes() for m in made]})

    kind = recordings.schema[id_col].dataType.simpleString()
    return recordings.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio")).mapInPandas(work, f"id {kind}, n_frames long, print binary")


def _places(kind: str):
    """The places of each recording's non-zero integers; too few for a link are none."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [pd.DataFrame({"node": [], "frames": [], "at": [], "value": []})]
            for node, data in zip(b["node"], b["print"]):
                x = np.frombuffer(data, dtype=np.int32)
                at = np.flatnonzero(x)
                if len(at) >= LEAST_VOTES:
                    out.append(pd.DataFrame({"node": node, "frames": len(x), "at": at, "value": x[at]}))
            yield pd.concat(out[1:] or out)

    return work, f"node {kind}, frames int, at int, value int"


def steps(node: np.ndarray, frames: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Recordings (by number) and keys of two integers and the step between their places, each pair once.

    Places stand recording by recording, ascending; steps are as long as a link of so many frames can demand.
    """
    most = (np.minimum(frames, LONG) - 1) // (LEAST_VOTES - 1)
    v, i = mix(value.astype(np.int64).astype(np.uint64)), np.arange(len(at))
    found_nodes, found_keys, k = [], [], 0
    while len(i):
        k += 1
        i = i[i + k < len(at)]
        i = i[(node[i + k] == node[i]) & (at[i + k] - at[i] <= most[i])]
        found_nodes.append(node[i])
        found_keys.append(mix(mix(v[i] + (at[i + k] - at[i]).astype(np.uint64)) ^ v[i + k]).astype(np.int64))
    nodes, keys = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (found_nodes, found_keys))
    order = np.lexsort((keys, nodes))
    nodes, keys = nodes[order], keys[order]
    new = np.concatenate(([True], (nodes[1:] != nodes[:-1]) | (keys[1:] != keys[:-1])))[: len(nodes)]
    return nodes[new], keys[new]


def _steps(kind: str):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["places"].map(len).to_numpy(dtype=np.int64)
            # Some recordings at once, but about a million places at most.
            for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(np.cumsum(size) >> 20)) + 1):
                if len(part):
                    x = np.concatenate(b["places"].iloc[part].to_list()).astype(np.int64)
                    number = np.repeat(part, size[part])
                    nodes, keys = steps(number, b["frames"].to_numpy()[number], x >> 32, (x & 0xFFFFFFFF).astype(np.uint32))
                    yield pd.DataFrame({"node": b["node"].to_numpy()[nodes], "value": keys})

    return work, f"node {kind}, value long"


def _rare(prints: DataFrame, kind: str) -> DataFrame:
    """node, value, n, part, parts: the keys and occurrences that candidates are found by, each value's recordings dealt into ``parts`` blocks."""
    work, schema = _places(kind)
    each = keep(prints.mapInPandas(work, schema))
    spread = each.groupBy("value").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("value")
    place = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    shared = each.join(spread, "value").groupBy("node", "frames").agg(F.sort_array(F.collect_list(place)).alias("places"))
    work, schema = _steps(kind)
    keys = keep(shared.filter(F.size("places") >= LEAST_VOTES).mapInPandas(work, schema))
    spread = keys.groupBy("value").agg(F.count("*").alias("spread")).filter("spread > 1")
    keys = keys.join(spread, "value").select("node", "value", F.lit(LEAST_SHARED).alias("n"), "spread")

    # Single integers of long recordings; should one equal a key, that makes a candidate more and loses none.
    single = each.filter(F.col("frames") > LONG).groupBy("node", "value").agg(F.count("*").alias("n"))
    spread = single.groupBy("value").agg(F.count("*").alias("spread")).filter("spread > 1")
    own = Window.partitionBy("node")
    before = own.orderBy(F.desc("spread"), F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    rows = single.join(spread, "value").withColumns({"all": F.sum("n").over(own), "before": F.coalesce(F.sum("n").over(before), F.lit(0))})
    left = F.col("n") - F.least(F.greatest(LEAST_VOTES - LEAST_SHARED - F.col("before"), F.lit(0)), F.col("n"))
    single = rows.filter(F.col("all") >= LEAST_VOTES).select("node", F.col("value").cast("long").alias("value"), left.cast("int").alias("n"), "spread").filter("n > 0")

    rows = keys.union(single).select("node", "value", "n", F.ceil(F.col("spread") / BLOCK).cast("int").alias("parts"))
    return keep(rows.withColumn("part", F.pmod(F.xxhash64("value", "node"), "parts").cast("int")))


def _candidates(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b, n) that share enough."""
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_SHARED).select("a", "b")


def _linked(pairs: DataFrame, prints: DataFrame, kind: str) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [align(np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)) for x, y in zip(b["x"], b["y"])]
            b = b[["a", "b"]].assign(offset=[f[0] for f in found], votes=[f[1] for f in found], error=[f[2] for f in found])
            yield b[(b["votes"] >= LEAST_VOTES) & (b["error"] <= MOST_ERROR)]

    sided = pairs.join(prints.select(F.col("node").alias("a"), F.col("print").alias("x")), "a").join(prints.select(F.col("node").alias("b"), F.col("print").alias("y")), "b")
    return cut(sided.select("a", "b", "x", "y").mapInPandas(work, f"a {kind}, b {kind}, offset long, votes long, error double"))


def classes(recordings: DataFrame, id_col: str, audio_col: str, rate: int = RATE, decode: Callable[[object], bytes | None] | None = None) -> DataFrame:
    """id, n_frames, print_hash, component_id of each recording; component_id is the least id reachable by links."""
    kind = recordings.schema[id_col].dataType.simpleString()
    known = keep(fingerprints(recordings, id_col, audio_col, rate, decode).withColumn("print_hash", F.sha2("print", 256)))
    nodes = cut(known.filter("n_frames > 0").groupBy("print_hash").agg(F.min("id").alias("node")))
    prints = keep(known.join(nodes.withColumnRenamed("print_hash", "h"), F.col("id") == F.col("node"), "left_semi").dropDuplicates(["id"]).select(F.col("id").alias("node"), "print"))
    rows = _rare(prints, kind)
    near = Window.partitionBy("value", "part").orderBy("node")
    beside = rows.select(F.lag("node").over(near).alias("a"), F.col("node").alias("b"), F.least("n", F.lag("n").over(near)).alias("n")).filter("a is not null")
    first = _linked(_candidates(beside), prints, kind).select("a", "b")
    early = components(first)
    placed = keep(rows.join(early, "node", "left").withColumn("cls", F.coalesce("component", "node")).drop("component"))
    mixed = placed.groupBy("value").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("value")
    some = keep(placed.join(mixed, "value", "left_semi"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x = some.select("value", F.col("part").alias("i"), others.alias("j"), F.col("node").alias("a"), "cls", "n")
    y = some.select("value", others.alias("i"), F.col("part").alias("j"), F.col("node").alias("b"), F.col("cls").alias("other"), F.col("n").alias("m"))
    later = x.join(y, ["value", "i", "j"]).filter("a < b and cls <> other").select("a", "b", F.least("n", "m").alias("n"))
    links = first.union(_linked(_candidates(later), prints, kind).select("a", "b"))
    out = known.select("id", "n_frames", "print_hash").join(nodes, "print_hash", "left").join(components(links), "node", "left")
    return out.select("id", "n_frames", "print_hash", F.when(F.col("n_frames") > 0, F.coalesce("component", "node")).otherwise(F.col("id")).alias("component_id"))


_notes: list[np.ndarray] = []


def tune(vector) -> bytes:
    """A vector as PCM: a note of HOP samples a component, its pitch by the component's value. Null and non-finite components are rests."""
    if not _notes:
        t = np.arange(HOP) / RATE
        _notes.append(np.stack([8000 * np.sin(2 * np.pi * 220 * 2 ** (p / 12) * t) * np.hanning(HOP) ** 0.25 for p in range(25)] + [np.zeros(HOP)]).astype("<i2"))
    x = np.array([np.nan if c is None else c for c in vector] if vector is not None else [], dtype=float)
    p = np.where(np.isfinite(x), np.clip(np.round(np.nan_to_num(x, posinf=0, neginf=0) * 40) + 12, 0, 24), 25).astype(int)
    return _notes[0][p].tobytes()


def op5_audio_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The tables hold no sound, so each vector is played."""
    from ledgerloom.llm.common import table

    return classes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", decode=tune).withColumnRenamed("id", "vec_id")
