"""Toxicity by a gap-tolerant string kernel, Nyström landmarks and a linear machine.

The kernel of two strings counts the subsequences of three letters that they
share, each weighted by the decay of its gaps in both, so letters put in
between or left out change it little. Landmarks are strings that labelled
training texts tell apart best, and some common ones. The Nyström features of
a string are its kernels with the landmarks times the inverse root of the
landmarks' own kernel matrix; a linear support vector machine in them is,
multiplied out, one weight for each letter triple. A text is scored by its
worst string: a word, a stretch of a long word, or single letters that stand
in a row. A logistic curve turns that margin into a score.

Fitting takes at most ``sample`` labelled rows (a documented bound), half of
them toxic where there are as many; choice and order depend on ids alone, so
reruns agree. Their strings are learned from in one task. Scoring reads every whole text, in tasks that need nothing but
the weights.

A null or empty text is scored as one without strings; repeated rows are scored
alike; an empty table gives no rows. Null labels are left out; with one class
only, or none, every score is that class's share (0). Other columns stay as
they are, whatever they are called.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free, releasing

DECAY, SPAN, WINDOW, LETTERS = 0.6, 9, 24, 64
#: Labelled rows that a fit takes at most.
SAMPLE = 4000
#: Strings whose margin a worker remembers before it starts afresh.
REMEMBERED = 1 << 17
#: Signs often put for letters count as those, where a string has letters.
_LIKE = str.maketrans("013457@$!", "oieastasi")
_EDGE = ".,;:?!\"'()[]|"


def _table() -> np.ndarray:
    """A code for every code point: letters 1-26, digits 27-36, other letters 37-63, what is no letter 0; all beyond the basic plane count as other letters."""
    out = 37 + np.arange(0x110000) % 27
    out[:0x10000] = np.where([chr(c).isalpha() for c in range(0x10000)], out[:0x10000], 0)
    out[ord("a") : ord("z") + 1], out[ord("0") : ord("9") + 1] = np.arange(1, 27), np.arange(27, 37)
    return out.astype(np.int32)


_CODES = _table()


def strings(text: str | None) -> set[str]:
    """A text's distinct strings in lower case: words, overlapping stretches of long ones, joined runs of single letters."""
    words = (text or "").lower().split()
    out = {w.strip(_EDGE) for w in set(words)}
    if sum(1 for w in words if len(w) == 1) >= 3:
        run = ""
        for w in [*words, "--"]:
            if len(w) == 1:
                run += w
                continue
            if len(run) >= 3:
                out.add(run)
            run = ""
    for w in [w for w in out if len(w) > WINDOW]:
        out.remove(w)
        out.update(w[i : i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2))
    return out


def codes(words: list[str]) -> np.ndarray:
    """A row of letter codes for each string."""
    flat = [w if w.isalpha() or not any(map(str.isalpha, w)) else w.translate(_LIKE) for w in words]
    points = np.frombuffer("".join([w.ljust(WINDOW) for w in flat]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _CODES[points].reshape(len(words), WINDOW)


def triples(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each string's letter triples (LETTERS**3 where there is none), and the decay at each place."""
    used = np.flatnonzero((x > 0).any(axis=0))
    width = int(used[-1]) + 1 if len(used) else 0
    places = [(i, j, k) for i in range(width - 2) for j in range(i + 1, width - 1) for k in range(j + 1, min(width, i + SPAN))]
    if not places:
        return np.full((len(x), 1), LETTERS**3, dtype=np.int32), np.ones(1)
    i, j, k = np.array(places).T
    t = (x[:, i] * LETTERS + x[:, j]) * LETTERS + x[:, k]
    t[(x[:, i] == 0) | (x[:, j] == 0) | (x[:, k] == 0)] = LETTERS**3
    return t, DECAY ** (k - i - 2.0)


def lengths(t: np.ndarray, decay: np.ndarray) -> np.ndarray:
    """The root of each string's kernel with itself, plus a little so that very short strings don't count as much as long ones."""
    order = np.argsort(t, axis=1)
    sorted_t, d = np.take_along_axis(t, order, axis=1), decay[order]
    d[sorted_t == LETTERS**3] = 0.0
    new = np.ones_like(sorted_t, dtype=bool)
    new[:, 1:] = sorted_t[:, 1:] != sorted_t[:, :-1]
    sums = np.add.reduceat(d.ravel(), np.flatnonzero(new.ravel()))
    rows = np.flatnonzero(new.ravel()) // t.shape[1]
    return np.sqrt(np.bincount(rows, weights=sums * sums, minlength=len(t))) + 0.3


def dense(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The weighted sum of the strings' normalised feature vectors: one number a triple."""
    t, decay = triples(codes(words))
    values = (weights / lengths(t, decay))[:, None] * decay[None, :]
    out = np.bincount(t.ravel(), weights=values.ravel(), minlength=LETTERS**3 + 1)
    out[LETTERS**3] = 0.0
    return out


def compact(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings' normalised feature vectors as columns over the triples that any has, those triples, and each triple's row (the last, of zeros, for all others)."""
    vectors = []
    for w in words:
        v = dense([w], np.ones(1)).astype(np.float32)
        at = np.flatnonzero(v)
        vectors.append((at, v[at]))
    used = np.unique(np.concatenate([at for at, _ in vectors]))
    table, row = np.zeros((len(used) + 1, len(words)), dtype=np.float32), np.full(LETTERS**3 + 1, len(used), dtype=np.int32)
    row[used] = np.arange(len(used), dtype=np.int32)
    for c, (at, v) in enumerate(vectors):
        table[row[at], c] = v
    return table, used, row


def products(table: np.ndarray, words: list[str], row: np.ndarray | None = None) -> np.ndarray:
    """Each string's normalised product with each column of ``table``, strings of like length together; ``row`` is each triple's row where it isn't the triple."""
    out = np.zeros((len(words), *table.shape[1:]))
    order = np.array(sorted(range(len(words)), key=lambda i: len(words[i])), dtype=np.int64)
    sizes = np.array([len(words[i]) for i in order], dtype=np.int64)
    cuts = [0, *np.searchsorted(sizes, (4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 19), side="right").tolist(), len(words)]
    for at, stop in ((i, min(i + 2048, hi)) for lo, hi in zip(cuts, cuts[1:]) for i in range(lo, hi, 2048)):
        some = order[at:stop]
        t, decay = triples(codes([words[i] for i in some]))
        scale = lengths(t, decay)
        t = t if row is None else row[t]
        if table.ndim == 1:
            out[some] = (table[t] @ decay) / scale
        else:
            for c in range(table.shape[1]):
                out[some, c] = (table[:, c][t] @ decay) / scale
    return out


@dataclass(frozen=True)
class Model:
    """Weights over triples, and the logistic curve of the margin."""

    weights: np.ndarray
    slope: float
    shift: float
    landmarks: tuple[str, ...] = ()

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _parts(words: Iterable[str], n: int) -> set[str]:
    return {w[a : a + n] for w in words for a in range(len(w) - n + 1)}


def _originals(texts: list[list[str]], orders: int = 6) -> list[list[str]]:
    """One of each group of copies: those share most words, so in most random orders of all words also the first; two such orders tell."""
    known: dict[tuple[int, int], int] = {}
    out = []
    for t, words in enumerate(texts):
        h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
        firsts = [(i, int((h * np.uint64(2654435761 + 2 * i) % np.uint64(4294967291 - i)).min())) for i in range(orders)] if len(h) else []
        same = Counter(known[k] for k in firsts if k in known)
        if not same or max(same.values()) < 2:
            out.append(words)
        for k in firsts:
            known.setdefault(k, t)
    return out


def _telling(pos: list[list[str]], neg: list[list[str]], most: int) -> list[str]:
    """Strings of 4 to 8 letters that stand in toxic texts and hardly any other, by greedy cover: each the one of most toxic texts still missed. Copies of a text count once.

    A part must stand in so many toxic texts that among all parts less than one is expected to do so, and nowhere else, by chance.
    """
    common = Counter(w for s in neg for w in s)
    rare = _originals([[w for w in s if common[w] <= 0.002 * len(neg)] for s in pos])
    del common
    docs_of: dict[str, list[int]] = {}
    tried = 0
    for n in range(4, 9):  # a length at a time, as all parts at once would fill the memory
        often = {p: k for p, k in Counter(p for s in rare for p in _parts(s, n)).items() if k >= 3}
        tried += len(often)
        spare = {p: 0.01 * len(neg) * k / len(pos) for p, k in often.items()}
        for s in neg:
            for p in _parts(s, n).intersection(spare):
                spare[p] -= 1
                if spare[p] < 0:
                    del spare[p]
        for i, s in enumerate(rare):
            for p in _parts(s, n).intersection(spare):
                docs_of.setdefault(p, []).append(i)
    least = max(3, int(np.ceil(np.log(max(1, tried)) / np.log((len(pos) + len(neg)) / len(pos)))))
    missed = set(range(len(rare)))
    heap = [(-len(d), -len(d), -len(p), p) for p, d in docs_of.items() if len(d) >= least]
    heapq.heapify(heap)
    chosen: list[str] = []
    while heap and len(chosen) < most:
        gain, size, length, part = heapq.heappop(heap)
        now = sum(i in missed for i in docs_of[part])
        # What stands in very many texts is a landmark even where those have others.
        if max(now, size // -4) < least or any(part[i : i + 4] in c for c in chosen for i in range(len(part) - 3)):
            continue
        if now < -gain and size // -4 < least:
            heapq.heappush(heap, (-now, size, length, part))
            continue
        chosen.append(part)
        missed.difference_update(docs_of[part])
    return chosen


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent (Hsieh et al. 2008); the last feature is the constant."""
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1) + 1e-12
    order = np.random.default_rng(7)
    bound = np.where(y > 0, cost * max(1.0, (y < 0).sum() / max(1, (y > 0).sum())), cost)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1.0) / square[i], 0.0), bound[i])
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w


def _curve(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton's steps, with a small pull to 0."""
    a = np.zeros(2)
    x = np.column_stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ a, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-3 * np.array([a[0], 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        a -= np.clip(np.linalg.solve(hess, grad), -5, 5)
    return float(a[0]), float(a[1])


def train(texts: Iterable[Iterable[str]], labels: list[int], shares: tuple[float, float], landmarks: int = 48, common: int = 24) -> Model:
    """Fit on the strings of labelled texts, each text's distinct; ``shares`` are the classes' shares among all labelled rows (0, then 1)."""
    index: dict[str, int] = {}
    rows = [np.array([index.setdefault(w, len(index)) for w in s], dtype=np.int64) for s in texts]
    vocabulary = sorted(index)
    place = np.empty(len(index), dtype=np.int64)
    for i, w in enumerate(vocabulary):
        place[index[w]] = i
    del index
    rows = [np.sort(place[r]) for r in rows]  # strings by their place in the sorted vocabulary from here on
    p_rows = [r for r, y in zip(rows, labels) if y]
    n_rows = [r for r, y in zip(rows, labels) if not y]
    if not p_rows or not n_rows:
        p = 0.999 if p_rows else 0.001
        return Model(np.zeros(LETTERS**3 + 1), 1.0, float(np.log(p / (1 - p))))
    pos, neg = ([[vocabulary[i] for i in r] for r in some] for some in (p_rows, n_rows))
    telling = _telling(pos, neg, landmarks)
    del pos, neg
    seen = np.bincount(np.concatenate(n_rows), minlength=len(vocabulary))
    order = np.argsort(-seen, kind="stable")
    frequent = [vocabulary[i] for i in order[: 20 * common] if seen[i] and len(vocabulary[i]) > 3][:common]
    points = list(dict.fromkeys(telling + frequent)) or ["aaaa"]
    one, used, row = compact(points)

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(LETTERS**3 + 1)
        out[used] = values[:-1]
        return out

    gram = products(one, points, row)
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 1e-6 * np.eye(len(points)))
    root = vector @ np.diag(1.0 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    weights = spread(one[:, : max(1, len(telling))].sum(axis=1))
    spread_out = range(0, len(vocabulary), max(1, len(vocabulary) // 1000))
    for _ in range(2):
        f = products(weights, vocabulary)
        good = sorted({int(r[np.argmax(f[r])]) for r in p_rows if len(r)})
        bad = {int(i) for r in n_rows for i in r[np.lexsort((r, -f[r]))[:5]]}.union(spread_out)
        good = [i for i in good if seen[i] * 20 <= len(n_rows)]
        bad = sorted(bad.difference(good))
        x = np.column_stack([products(one, [vocabulary[i] for i in good + bad], row) @ root, np.ones(len(good) + len(bad))])
        w = _machine(x, np.array([1.0] * len(good) + [-1.0] * len(bad)))
        weights = spread(one @ (root @ w[:-1]).astype(np.float32))
    f = products(weights, vocabulary)
    margins = np.array([f[r].max(initial=0.0) for r in rows])
    y = np.array(labels, dtype=float)
    weight = np.where(y > 0, shares[1] / max(1, y.sum()), shares[0] / max(1, (1 - y).sum())) * len(y)
    slope, shift = _curve(margins, y, weight)
    return Model(weights, slope, shift, tuple(telling))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows whose crc32 of the id leaves a remainder by 5."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = max(1, sum(counts.values()))
    rows = []
    for y in (0, 1):
        n = max(sample // 2, sample - counts.get(1 - y, 0))
        rows += known.filter(F.col("y") == y).select("doc_id", "y").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(n).collect()
    if not rows:
        return train([], [], (1.0, 0.0))
    shares = (counts.get(0, 0) / total, counts.get(1, 0) / total)
    chosen = docs.sparkSession.createDataFrame(rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, y int")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(str), "y": b["y"], "words": ["\n".join(sorted(strings(t))) for t in b["text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((hashlib.md5(i.encode()).hexdigest(), y, words) for b in batches for i, y, words in zip(b["doc_id"], b["y"], b["words"]))
        m = train((words.split("\n") for _, _, words in rows), [y for _, y, _ in rows], shares)
        yield pd.DataFrame({"weights": [m.weights.tobytes()], "slope": [m.slope], "shift": [m.shift], "landmarks": [list(m.landmarks)]})

    # The sample's strings, not its texts, go to the one task that learns; the driver gets the weights.
    found = texts.mapInPandas(releasing(split), "doc_id string, y int, words string").repartition(1).mapInPandas(releasing(learn), "weights binary, slope double, shift double, landmarks array<string>").collect()
    if not found:
        return train([], [], shares)
    return Model(np.frombuffer(found[0].weights), found[0].slope, found[0].shift, tuple(found[0].landmarks))


_margins: dict[bytes, dict[str, float]] = {}


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the score of every whole text in the column ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        key = hashlib.md5(m.weights.tobytes()).digest()
        if key not in _margins:
            _margins.clear()
        known = _margins.setdefault(key, {})
        for batch in batches:
            worst = np.zeros(len(batch))
            for at in range(0, len(batch), 256):
                some = [strings(t) for t in batch[at : at + 256]]
                new = set().union(*some).difference(known)
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = set().union(*some)
                new = list(new)
                known.update(zip(new, products(m.weights, new).tolist()))
                worst[at : at + 256] = [max(map(known.__getitem__, s), default=0.0) for s in some]
            yield pd.Series(m.score(worst))

    def trimmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from releasing(work)(batches)

    udf = F.pandas_udf(trimmed, "double")
    return docs.withColumn(out, udf(F.col(text_col)))


def kept(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``limit``."""
    name = free("toxicity", docs)
    return scored(docs, model, text_col, name).filter(F.col(name) < limit).select(*docs.columns)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")), out="score").drop("text")
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
