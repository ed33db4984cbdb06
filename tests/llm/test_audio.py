"""Fingerprints, alignment against a plain histogram, classes against all pairs, odd input."""

from collections import Counter

import numpy as np

from ledgerloom.llm import audio as a


def tune(seed, notes=60):
    t = np.arange(a.HOP) / a.RATE
    r = np.random.default_rng(seed)
    return np.concatenate([8000 * np.sin(2 * np.pi * 220 * 2 ** (p / 12) * t) for p in r.integers(0, 24, notes)])


def pcm(x):
    return np.clip(x, -32767, 32767).astype("<i2").tobytes()


def plain_align(x, y):
    votes = Counter(i - j for i, p in enumerate(x) for j, q in enumerate(y) if p == q and p != 0)
    if not votes:
        return 0, 0
    most = max(votes.values())
    return min(k for k, v in votes.items() if v == most), most


def test_alignment_equals_the_plain_histogram():
    base = tune(1)
    x = a.fingerprint(a.chroma(pcm(base)))
    for other in (base, base[7 * a.HOP :], np.concatenate([tune(9, 5), base]), tune(2), base * 0.3):
        y = a.fingerprint(a.chroma(pcm(other)))
        assert a.align(x, y)[:2] == plain_align(x.tolist(), y.tolist())
    assert a.align(x, a.fingerprint(a.chroma(pcm(base[7 * a.HOP :]))))[0] == 7
    assert a.align(x, x) == (0, len(x), 0.0)


def test_quieter_and_noisy_copies_differ_little():
    base = tune(3)
    x = a.fingerprint(a.chroma(pcm(base)))
    noisy = a.fingerprint(a.chroma(pcm(base * 0.5 + np.random.default_rng(0).normal(0, 40, len(base)))))
    assert a.align(x, noisy)[2] < a.MOST_ERROR < a.align(x, a.fingerprint(a.chroma(pcm(tune(4)))))[2]


def test_classes_equal_all_pairs(spark):
    sounds = []
    for s in range(6):
        base = tune(s)
        sounds += [pcm(base), pcm(base), pcm(base * 0.6), pcm(base[5 * a.HOP :])][: 1 + s % 4 + 1]
    sounds += [None, b"", b"\0" * 3, pcm(np.zeros(20000)), pcm(np.zeros(20000)), pcm(tune(0, 1500))]
    rows = [(s, 2 * i + 1, i) for i, s in enumerate(sounds)]
    frame = spark.createDataFrame(rows + rows[:1], "audio binary, id long, node long")
    got = {x.id: x.component_id for x in a.classes(frame, "id", "audio").collect()}
    prints = {i: a.fingerprint(a.chroma(s)) for s, i, _ in rows}
    least = {i: i for i in prints}
    for _ in range(len(prints)):
        for i in prints:
            for j in prints:
                same = len(prints[i]) and np.array_equal(prints[i], prints[j])
                _, votes, error = a.align(prints[min(i, j)], prints[max(i, j)])
                if i != j and (same or votes >= a.LEAST_VOTES and error <= a.MOST_ERROR):
                    least[i] = least[j] = min(least[i], least[j])
    assert got == least


def test_played_vectors_and_empty_table(spark):
    rows = [(1, [0.1, None, float("nan"), 0.5] * 16), (2, None), (3, []), (4, [0.1, None, float("nan"), 0.5] * 16)]
    assert [len(a.tune(v)) for _, v in rows] == [64 * a.HOP * 2, 0, 0, 64 * a.HOP * 2]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {x.id: x.component_id for x in a.classes(frame, "vec_id", "embedding", decode=a.tune).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}
    assert a.classes(frame.limit(0), "vec_id", "embedding", decode=a.tune).count() == 0


def test_no_link_is_lost_without_shared_runs(spark, monkeypatch):
    r = np.random.default_rng(5)
    prints, hot = {}, r.integers(1, 2**32, 5, dtype=np.uint32)
    for k in range(8):
        base = r.integers(1, 2**32, 60, dtype=np.uint32)
        base[10:15] = hot  # a run that unrelated recordings share
        for j in range(4):
            y = base.copy()
            y[np.arange(60) % 4 != j % 2] ^= np.uint32(1 << j)  # integers agree singly, never four in a row
            prints[2 * len(prints) + 1] = y if j < 3 else y[7:]
    prints[101] = np.full(40, 9, dtype=np.uint32)
    prints[103] = np.concatenate([np.zeros(30, dtype=np.uint32), np.full(9, 9, dtype=np.uint32)])
    rows = [(i, p.tobytes()) for i, p in prints.items()]
    monkeypatch.setattr(a, "fingerprints", lambda d, *_: d.selectExpr("id", "length(audio) div 4 as n_frames", "audio as print"))
    got = [{x.id: x.component_id for x in a.classes(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio").collect()}]
    monkeypatch.setattr(a, "BLOCK", 3, raising=False)
    got += [{x.id: x.component_id for x in a.classes(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio").collect()}]
    links = [(i, j) for i in prints for j in prints if i < j and (v := a.align(prints[i], prints[j]))[1] >= a.LEAST_VOTES and v[2] <= a.MOST_ERROR]
    runs = {i: {p[k : k + 4].tobytes() for k in range(len(p) - 3) if p[k : k + 4].any()} for i, p in prints.items()}
    for i in prints:
        runs[i] -= {p[k : k + 4].tobytes() for p in prints.values() for k in range(len(p) - 3) if hot[0] in p[k : k + 4] or hot[-1] in p[k : k + 4]}
    assert any(not runs[i] & runs[j] for i, j in links)
    least = {i: i for i in prints}
    for _ in prints:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    monkeypatch.setattr(a, "LONG", 9)  # keys of one step; single integers for the rest
    got += [{x.id: x.component_id for x in a.classes(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio").collect()}]
    assert got == [least, least, least] and 1 < len(set(least.values())) < len(prints)


def test_every_link_has_a_common_key():
    r = np.random.default_rng(8)
    for n, m in ((8, 8), (50, 50), (57, 400), (256, 900)):
        for _ in range(40):
            x, y = r.integers(1, 2**31, n), r.integers(1, 2**31, m)
            at, off = np.sort(r.choice(n, a.LEAST_VOTES, replace=False)), r.integers(0, m - n + 1)
            y[at + off] = x[at]
            number = np.repeat([0, 1], [n, m])
            nodes, keys = a.steps(number, np.array([n, m])[number], np.concatenate([np.arange(n), np.arange(m)]), np.concatenate([x, y]))
            assert set(keys[nodes == 0].tolist()) & set(keys[nodes == 1].tolist())
