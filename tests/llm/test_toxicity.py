"""Kernel against its definition, tolerance to gaps, held-out accuracy, odd input."""

import itertools
import random

import numpy as np
import pytest

from ledgerloom.llm import toxicity as t


def plain_kernel(a, b):
    total = 0.0
    for x in itertools.combinations(range(len(a)), 3):
        for y in itertools.combinations(range(len(b)), 3):
            if all(a[i] == b[j] for i, j in zip(x, y)) and max(x[2] - x[0], y[2] - y[0]) < t.SPAN:
                total += t.DECAY ** (x[2] - x[0] - 2 + y[2] - y[0] - 2)
    return total


def test_products_equal_the_kernel():
    words = ["idiot", "idioot", "banana", "id", "clown", "trashcan", "aaaa"]
    table = np.column_stack([t.dense([w], np.ones(1)) for w in words])
    got = t.products(table, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            want = plain_kernel(a, b) / (plain_kernel(a, a) ** 0.5 + 0.3) / (plain_kernel(b, b) ** 0.5 + 0.3)
            assert abs(got[i, j] - want) < 1e-9


def test_strings_cover_the_whole_text():
    assert {"i", "idioti"} <= t.strings("i d i o t I") and t.strings(None) == set()
    long = "a" * 3000 + "idiot" + "b" * 3000
    assert any("idiot" in s for s in t.strings(long)) and all(len(s) <= t.WINDOW for s in t.strings(long))


BAD = ["idiot", "clown", "worthless"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    part = ["the", "ing", "er", "tion", "on", "re", "st", "ly", "ou", "ha", "nd", "es"]
    docs, labels = [], []
    for i in range(900):
        words = ["".join(r.choice(part) for _ in range(r.randint(1, 4))) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[r.randint(0, 39)] = r.choice(BAD)
        docs.append((" ".join(words), i, "en"))
        labels.append((toxic * 1, i))
    return spark.createDataFrame(docs, "text string, doc_id long, score string"), spark.createDataFrame(labels, "toxic int, doc_id long")


def test_held_out_accuracy_and_reruns(spark, corpus):
    docs, labels = corpus
    model = t.fit(docs, labels)
    out = t.scored(docs, model).join(labels, "doc_id").filter("crc32(string(doc_id)) % 5 = 0").collect()
    right = sum((x.toxicity >= 0.5) == bool(x.toxic) for x in out)
    assert len(out) > 100 and right >= 0.97 * len(out)
    again = t.fit(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model.weights, again.weights) and model.slope == again.slope


def test_gaps_and_insertions_are_seen(spark, corpus):
    docs, labels = corpus
    model = t.fit(docs, labels)
    tests = ["the on idi-ot ly", "the i d i o t ly", "the cl*own er", "the idioot re", "the worthlesss on", "x" * 4000 + "idiot" + "y" * 4000]
    clean = ["the other station", "", None, "x" * 9000, "a b c d", "\n\t "]
    rows = [(s, i, None) for i, s in enumerate(tests + clean)]
    out = {x.doc_id: x.toxicity for x in t.scored(spark.createDataFrame(rows, "text string, doc_id long, toxicity string"), model).collect()}
    assert min(out[i] for i in range(5)) > max(out[i] for i in range(len(tests), len(rows)))
    assert all(0 <= v <= 1 for v in out.values())
    left = t.kept(spark.createDataFrame(rows, "text string, doc_id long, toxicity string"), model)
    assert left.columns == ["text", "doc_id", "toxicity"] and {x.doc_id for x in left.collect()} >= set(range(len(tests), len(rows)))


def test_one_class_no_labels_null_labels(spark, corpus):
    docs, labels = corpus
    for lab in (labels.filter("toxic = 0"), labels.limit(0), labels.selectExpr("cast(null as int) as toxic", "doc_id")):
        assert {x.toxicity < 0.5 for x in t.scored(docs.limit(5), t.fit(docs, lab)).collect()} == {True}
    assert t.scored(docs.limit(0), t.fit(docs, labels.limit(0))).count() == 0


def test_rare_insults_beyond_the_commonest_get_landmarks():
    r = random.Random(6)
    part = ["the", "ing", "er", "tion", "on", "re", "st", "ly", "ou", "ha", "nd", "es"]
    insults = ["".join(r.choice("bcdfgjkmpqvwxz") for _ in range(7)) for _ in range(45)]
    made = lambda: {"".join(r.choice(part) for _ in range(r.randint(1, 4))) for _ in range(30)}
    pos = [made() | {insults[i % 45]} for i in range(1350)]
    neg = [made() for _ in range(1350)]  # each insult stands in 30 toxic texts, a little over 2%
    pos += [made() for _ in range(650)]  # so now in 1.5%
    model = t.train(pos + neg, [1] * len(pos) + [0] * len(neg), (0.5, 0.5))
    assert sum(any(c in w for c in model.landmarks) for w in insults) >= 44
    f = t.products(model.weights, insults + sorted(neg[0]))
    assert np.mean(f[:45] > f[45:].max()) >= 0.9


def test_compact_products_equal_the_full_ones():
    words = ["idiot", "clown", "worthless", "banana", "id", "x" * 24]
    table, used, row = t.compact(words[:3])
    full = np.column_stack([t.dense([w], np.ones(1)).astype(np.float32) for w in words[:3]])
    assert np.array_equal(t.products(full, words), t.products(table, words, row)) and np.array_equal(full[used], table[:-1])
