"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Entries become whole numbers, floor(scale * c) + shift. Each partition folds
its rows, a chunk at a time, into its count, exact sums and the full-rank
singular values and vectors of its centred rows. Two such summaries merge by
stacking their scaled vectors and one row for the difference of their means
and decomposing the stack again, which loses nothing but rounding; partitions
merge in a tree of small groups. So a task holds a chunk and a few summaries,
squares in the number of dimensions and not in the rows, and the driver gets
one summary.

Rows whose vector is null, empty or holds null or non-finite entries take no
part. Of vectors of several lengths, those of the commonest length do (ties:
the shortest). Repeated rows and ids count as often as they stand; a null id
stays null. A component without variance has no whitened values (null) and is
left out of the identity error. Without rows there is no result row. Deviations
of 2**63 or more are null. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, releasing, table

CHUNK, FAN = 4_096, 8
SUMMARY = "part long, n long, sums array<long>, spread array<double>, axes array<double>"


@dataclass(frozen=True)
class Summary:
    """Count and sums of rows, and singular values and vectors of the rows less their mean."""

    n: int
    sums: np.ndarray
    spread: np.ndarray
    axes: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        n, sums = len(x), x.sum(axis=0)
        _, spread, axes = np.linalg.svd((n * x - sums) / n, full_matrices=False)
        return cls(n, sums, spread, axes)

    def merged(self, other: Summary) -> Summary:
        """Both lists' summary: a row carries what lies between their means, from whole numbers."""
        n, m = self.n, other.n
        apart = np.array([float(int(a) * m - int(b) * n) for a, b in zip(self.sums, other.sums)]) / (float(n) * m)
        stack = np.vstack([self.spread[:, None] * self.axes, other.spread[:, None] * other.axes, np.sqrt(n * m / (n + m)) * apart])
        _, spread, axes = np.linalg.svd(stack, full_matrices=False)
        d = len(self.sums)
        return Summary(n + m, self.sums + other.sums, spread[:d], axes[:d])

    def row(self, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "n": [self.n], "sums": [self.sums.tolist()], "spread": [self.spread.tolist()], "axes": [self.axes.ravel().tolist()]})

    @classmethod
    def read(cls, row) -> Summary:
        return cls(int(row.n), np.array(row.sums, dtype=np.int64), np.array(row.spread, dtype=float), np.array(row.axes, dtype=float).reshape(len(row.spread), -1))


@dataclass(frozen=True)
class Whitening:
    """A fit: exact count and sums, eigenvalues falling, an eigenvector a row."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    scale: float
    shift: int

    @property
    def shares(self) -> np.ndarray:
        whole = self.values.sum()
        return self.values / whole if whole > 0 else np.zeros(len(self.values))

    def projection(self, components: int) -> np.ndarray:
        """Centred rows times this are whitened; a column of zeros for a component without variance."""
        e = self.values[:components]
        firm = e > self.values[0] * len(self.sums) * np.finfo(float).eps
        return np.where(firm, self.vectors[:components].T / np.sqrt(np.where(firm, e, 1.0)), 0.0)


def usable(df: DataFrame, id: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and the length of their vectors (0 without rows)."""
    v = F.col(vector)
    rows = df.select(F.col(id).alias("id"), v.alias("v")).filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (rows.filter(F.size("v") == common.d), common.d) if common else (rows, 0)


def whole(batch: pa.RecordBatch, d: int, scale: float, shift: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)
    return (np.floor(scale * flat) + shift).astype(np.int64).reshape(-1, d)


def tree(parts: DataFrame, merge, schema: str) -> DataFrame:
    """One row of many, a row a partition: groups of FAN neighbours merge until none is left to merge with."""
    parts = cut(parts)
    count = parts.agg(F.max("part")).first()[0] + 1
    while count > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInPandas(merge, schema)
        count = -(-count // FAN)
    return parts


def fit(df: DataFrame, vector: str = "embedding", id: str = "vec_id", scale: float = 64.0, shift: int = 1_000_000) -> Whitening | None:
    """The fit over all usable rows; None without any."""
    rows, d = usable(df, id, vector)
    if not d:
        return None

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = None
        for batch in batches:
            x = whole(batch, d, scale, shift)
            for i in range(0, len(x), CHUNK):
                one = Summary.of(x[i : i + CHUNK])
                out = one if out is None else out.merged(one)
        if out is not None:
            yield pa.RecordBatch.from_pandas(out.row(TaskContext.get().partitionId()), preserve_index=False)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        out = None
        for row in group.sort_values("n", kind="stable").itertuples():
            one = Summary.read(row)
            out = one if out is None else out.merged(one)
        return out.row(int(group["part"].iloc[0]))

    last = tree(rows.select("v").mapInArrow(releasing(fold), SUMMARY), merge, SUMMARY).first()
    one = Summary.read(last)
    spread = np.zeros(d)
    spread[: len(one.spread)] = one.spread
    axes = one.axes
    if len(axes) < d:  # fewer rows than dimensions: any completion of the basis has no variance
        axes = np.vstack([axes, np.linalg.svd(axes, full_matrices=True)[2][len(axes) :]])
    return Whitening(one.n, one.sums, spread**2 / one.n, axes, scale, shift)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, whole."""
    return model.n * x - model.sums


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding", id: str = "vec_id", components: int = 32) -> float:
    """The largest entry of the whitened rows' covariance less the identity, over the components that have variance."""
    rows, d = usable(df, id, vector)
    p = model.projection(components)
    k = p.shape[1]
    schema = "part long, total array<double>, square array<double>"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _centred(whole(batch, d, model.scale, model.shift), model) / model.n @ p
            total += w.sum(axis=0)
            square += w.T @ w
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "total": [total.tolist()], "square": [square.ravel().tolist()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        add = lambda c: np.sum(np.stack(group[c].to_list()), axis=0).tolist()
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "total": [add("total")], "square": [add("square")]})

    last = tree(rows.select("v").mapInArrow(releasing(fold), schema), merge, schema).first()
    mean = np.array(last.total) / model.n
    firm = np.flatnonzero((p != 0).any(axis=0))
    off = (np.array(last.square).reshape(k, k) / model.n - np.outer(mean, mean))[np.ix_(firm, firm)] - np.eye(len(firm))
    return float(np.abs(off).max()) if len(firm) else 0.0


def whitened(df: DataFrame, model: Whitening, error: float, vector: str = "embedding", id: str = "vec_id", components: int = 32) -> DataFrame:
    """A row for each usable row and component: deviation, whitened value, explained share."""
    rows, d = usable(df, id, vector)
    p, shares = model.projection(components), model.shares[:components]
    k = p.shape[1]
    firm = (p != 0).any(axis=0)
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, CHUNK):
                batch = big.slice(i, CHUNK)
                apart = _centred(whole(batch, d, model.scale, model.shift), model)
                m = len(apart)
                if d * float(np.abs(apart).max()) ** 2 < 2.0**62:
                    deviation = pa.array((apart * apart).sum(axis=1))
                else:
                    sums = [sum(int(a) ** 2 for a in line) for line in apart]
                    deviation = pa.array([s if s < 2**63 else None for s in sums], pa.int64())
                w = (apart / model.n @ p).ravel()
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation.take(pa.array(each)), pa.array(w, mask=np.tile(~firm, m)), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(releasing(work), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    model = fit(df)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whitened(df, model, identity_error(df, model))
