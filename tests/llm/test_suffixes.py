"""Repeats against a table of all strings; the order against plain sorting; odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import suffixes as s


def plain(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + s.LENGTH] for d in data for i in range(len(d) - s.LENGTH + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, dtype=bool)
        for i in range(len(d) - s.LENGTH + 1):
            if seen[d[i : i + s.LENGTH]] > 1:
                gone[i + 1 : i + 1 + s.LENGTH] = True
        left = bytes(b for b, g in zip(d, gone[1:-1]) if not g)
        out.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    passage, other = word(260), word(900)
    out = [None, "", "short", "z" * 199, "y" * 200, "q" * 1300, "ab" * 300, "\0" * 250 + "x" + "\0" * 250]
    for _ in range(30):
        kind = r.random()
        a, b = word(r.randint(0, 400)), word(r.randint(0, 400))
        if kind < 0.3:
            out.append(a + passage + b)
        elif kind < 0.6:
            lo = r.randint(0, 500)
            out.append(a + other[lo : lo + r.randint(150, 420)] + b)
        elif kind < 0.7:
            out.append(other)
        elif kind < 0.8:
            out.append(a + passage[:230] + b + passage[20:])
        else:
            out.append(a + b)
    return out


@pytest.mark.parametrize("seed,most", [(1, 16_384), (2, 3)])
def test_same_as_a_table_of_all_strings(spark, seed, most, monkeypatch):
    monkeypatch.setattr(s, "MOST", most)
    made = texts(seed)
    docs = spark.createDataFrame([(t, i, "x") for i, t in enumerate(made)], "text string, doc_id long, spans string").repartition(3)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in s.without_repeats(docs).drop("kept").collect()}
    for i, want in enumerate(plain(made)):
        assert got[i] == want, (i, made[i])


@pytest.mark.parametrize("stretch", [1 << 22, 150])
def test_anchors_cover_each_window_once(stretch, monkeypatch):
    monkeypatch.setattr(s, "STRETCH", stretch)
    data = "".join(random.Random(2).choice("abc") for _ in range(2000)).encode() + b"k" * 500
    place, before, after, key, _ = s.anchors(data)
    windows = sorted(w for a, b, c in zip(place, before, after) for w in range(a - b, a + c - s.LENGTH + 1))
    assert windows == list(range(len(data) - s.LENGTH + 1))
    assert (before <= s.REACH).all() and (after >= s.KMER).all() and len(key) == len(place)


def test_deep_shallow_sorts():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (300, 136)).astype(np.uint8)
    rows[rng.integers(0, 300, 200), :100] = 1
    rows[:40] = rows[40:80]
    group = rng.integers(0, 4, 300)
    order, common = s.deep_shallow(rows, group)
    assert [(group[i], rows[i].tobytes()) for i in order] == sorted((g, r.tobytes()) for g, r in zip(group, rows))
    for p, (i, j) in enumerate(zip(order, order[1:]), 1):
        want = next((k for k in range(136) if rows[i][k] != rows[j][k]), 136) if group[i] == group[j] else -1
        assert common[p] == want


def test_null_ids_repeated_rows_and_empty_table(spark):
    long = "".join(random.Random(3).choice("abcdef ") for _ in range(500))
    docs = spark.createDataFrame([(long, None), ("x" + long, None), (long, 4), (long, 4)], "text string, doc_id long")
    assert sorted(x.n_bytes - x.n_removed for x in s.without_repeats(docs).collect()) == [0, 0, 0, 1]
    assert s.without_repeats(docs.limit(0)).count() == 0
