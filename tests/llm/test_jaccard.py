"""Classes against all pairs; trees against plain bounds; odd input."""

import random

import numpy as np
import pytest

from ledgerloom.llm import jaccard as j
from ledgerloom.llm.shingles import shingle_set, word_hashes


def plain_set(text, width=5):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def plain_classes(rows):
    sets = {i: plain_set(t) for t, i, *_ in rows}
    least = {i: i for i in sets}
    changed = True
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {i: (len(sets[i]), least[i]) for i in sets}


def corpus(seed, families=12, copies=14):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    rows = [None, "", " \n\t", "one two", "One  TWO", "one two three four five", "É a b c d e", "é a b c d e", "long " * 20000, "x" * 200000]
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice([8, 30, 90, 200]))]
        if r.random() < 0.7:
            base = passage + base
        rows.append(" ".join(base))
        for _ in range(r.randint(0, copies)):
            new = list(base)
            for _ in range(r.randint(0, 1 + len(base) // 40)):
                new[r.randrange(len(new))] = r.choice(vocabulary)
            if r.random() < 0.3:
                new += [r.choice(vocabulary) for _ in range(r.randint(1, 6))]
            rows.append((" " if r.random() < 0.5 else "\n").join(new).upper() if r.random() < 0.2 else " ".join(new))
    r.shuffle(rows)
    return [(t, 3 * i + 1, "extra") for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_classes_as_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(j, "FREQUENT", 20)
    monkeypatch.setattr(j, "BROADCAST_IDS", 500_000 if seed == 1 else 0)
    monkeypatch.setattr(j, "BLOCK", 8192 if seed == 1 else 6)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "text string, doc_id long, node string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in j.classes(docs).collect()}
    assert got == plain_classes(rows)


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(0)
    base = rng.poisson(4, (40, j.GROUPS))
    counts = np.concatenate([np.maximum(base[rng.integers(0, 40, 400)] + rng.integers(-1, 2, (400, j.GROUPS)) * (rng.random((400, j.GROUPS)) < 0.15), 0)]).astype(np.int32)
    n, classes = counts.sum(axis=1), rng.integers(0, 60, 400)
    got = {tuple(sorted(p)) for a, b in j.CountTree(counts, n).pairs(classes, 80) for p in zip(a.tolist(), b.tolist())}
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if classes[a] != classes[b] and 180 * np.minimum(counts[a], counts[b]).sum() >= 80 * (n[a] + n[b]) and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b])}
    assert got == want and want


def test_packed_points_never_bound_too_low():
    rng = np.random.default_rng(1)
    for n, m in ((10, 12), (500, 600), (60_000, 50_000), (300_000, 310_000)):
        both = rng.integers(0, 2**64, min(n, m) // 2, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**64, k - len(both), dtype=np.uint64)])) for k in (n, m))
        px, py = j.unpacked([j.packed(x), j.packed(y)])
        assert np.minimum(px, py).sum(dtype=np.int64) >= len(np.intersect1d(x, y)) and px.sum(dtype=np.int64) >= len(x)


def test_sets_equal_the_definition():
    for t in ["a b c d e f", "A B\tc\nd\x0be\x0cf\rg", "a b c d e f g a b c d e f g", "é x y", "\x1c x", "q " * 999]:
        assert len(shingle_set(t)) == len(plain_set(t)) and len(word_hashes(t.encode())) == len(t.encode().split())
    assert shingle_set("A b\n c d e")[0] == shingle_set("a  b c d E")[0]


def test_one_of_each_repeats_nulls_empty(spark):
    text = "a b c d e f g h i j"
    rows = [(text, 5, "x"), (text, 5, "x"), (text, 9, "y"), (None, 7, "z"), ("other words stand in this one", None, "n")]
    docs = spark.createDataFrame(rows, "text string, doc_id long, n string")
    out = j.one_of_each(docs)
    assert out.columns == docs.columns and sorted(map(str, (tuple(x) for x in out.collect()))) == sorted(map(str, [rows[0], rows[3], rows[4]]))
    assert j.classes(docs.limit(0)).count() == 0


def test_words_that_collide_under_any_base(spark):
    """A Thue-Morse word and its complement have one value under every polynomial modulo a power of two."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert word_hashes(one.encode())[0] != word_hashes(other.encode())[0]
    assert sorted(map(tuple, j.classes(docs).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_word_values_depend_on_the_word_alone():
    words = [b"a", b"b", b"ab", b"ba", b"aab", b"aba", b"baa", b"\xc3\xa9", b"x" * 300, b"x" * 301]
    alone = [int(word_hashes(w)[0]) for w in words]
    assert len(set(alone)) == len(words)
    assert [int(h) for h in word_hashes(b" \t" + b"\n ".join(words) + b" ")] == alone
    assert len(word_hashes(b" \n")) == 0 and len(word_hashes(b"")) == 0
