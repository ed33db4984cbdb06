"""Whitening against numpy's eigenvectors over all rows, and its defined edge cases."""

import numpy as np
import pytest

from ledgerloom.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, part string, n string, v string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA).repartition(parts)


def expected(x, k):
    n = len(x)
    apart = n * x - x.sum(axis=0)
    c = apart / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return (apart.astype(object) ** 2).sum(axis=1), c @ u[:, :k] / np.sqrt(e[:k]), e


def result(df, components=32):
    model = w.fit(df)
    return model, w.whitened(df, model, w.identity_error(df, model, components=components), components=components).toPandas()


def test_all_rows_alike_numpy(spark):
    rng = np.random.default_rng(5)
    v = (rng.standard_normal((701, 7)) * [9, 7, 5, 4, 3, 2, 1] + 100).astype(np.float32)
    df = frame(spark, [(i, r.tolist()) for i, r in enumerate(v)], 13)
    model, out = result(df, 4)
    x = np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000
    deviation, white, e = expected(x, 4)
    wide = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((wide * white).sum(axis=0))
    assert np.abs(wide * sign - white).max() < 1e-9
    assert out[out.component == 1].sort_values("vec_id").deviation.tolist() == deviation.tolist()
    assert np.allclose(out.groupby("component").explained.first(), e[:4] / e.sum(), rtol=1e-10)
    assert set(out.n) == {701} and out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-10


def test_merging_loses_nothing():
    rng = np.random.default_rng(6)
    x = rng.integers(-500, 500, (97, 5)) + 1_000_000
    one = w.Summary.of(x)
    parts = [w.Summary.of(p) for p in (x[:1], x[1:3], x[3:40], x[40:])]
    merged = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3]))
    assert merged.n == 97 and (merged.sums == one.sums).all()
    assert np.allclose(merged.spread, one.spread, rtol=1e-12)
    assert np.allclose(np.abs(np.sum(merged.axes * one.axes, axis=1)), 1, atol=1e-10)


def test_rows_that_take_no_part_and_repeats(spark):
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (4, [0.0, 0.5])]
    bad = [(5, None), (6, []), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 0.0]), (10, [1.0, 2.0, 3.0])]
    model, out = result(frame(spark, good + bad))
    assert model.n == 4 and len(out) == 8 and out.vec_id.isna().sum() == 2
    assert sorted(x for x in out.vec_id.dropna()) == [1, 1, 1, 1, 4, 4]


@pytest.mark.parametrize("rows", [[(1, [0.5, 0.25, 1.0])], [(i, [1.0, 1.0, 1.0]) for i in range(5)]])
def test_no_variance_is_null(spark, rows):
    _, out = result(frame(spark, rows))
    assert len(out) == 3 * len(rows) and out.whitened.isna().all() and (out.deviation == 0).all() and (out.identity_error == 0).all()


def test_fewer_rows_than_dimensions(spark):
    _, out = result(frame(spark, [(0, [1.0, 0.0, 0.0, 2.0]), (1, [0.0, 3.0, 0.0, 2.0])]))
    assert out[out.component == 1].whitened.abs().round(9).tolist() == [1.0, 1.0] and out[out.component > 1].whitened.isna().all()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = w.op13_whitening(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_large_entries_have_exact_or_null_deviations(spark):
    rows = [(0, [2.0**20, 0.0]), (1, [-(2.0**20), 0.0]), (2, [2.0**30, 1.0])]
    _, out = result(frame(spark, rows))
    x = np.floor(64 * np.array([r for _, r in rows])).astype(np.int64) + 1_000_000
    want = [int(s) if s < 2**63 else None for s in ((3 * x.astype(object) - x.sum(axis=0)) ** 2).sum(axis=1)]
    got = [None if g != g else int(g) for g in out[out.component == 1].sort_values("vec_id").deviation]
    assert [g is None for g in got] == [g is None for g in want] and all(g is None or abs(g - t) <= abs(t) * 1e-15 for g, t in zip(got, want))
