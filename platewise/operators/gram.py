"""Pairwise-complete moments of all features in one scan.

A task keeps sums of products. Rows without a gap add one product matrix and a few vectors; rows with gaps add, for each pair,
what the pair has in common. Blocks of pairs leave the task when it ends and are summed as they stream by, so the number of scans
does not depend on the number of features, and no row of the merge holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features of a block.
BLOCK = 128
#: A variance below this share of the mean square is rounding.
FLAT = 1e-13

_SUMS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("sums", pa.binary())])
_PAIRS = pa.schema([("pa", pa.int32()), ("pb", pa.int32()), ("n", pa.int64()), ("r", pa.float64())])


class _Sums:
    """Of features i and j over the rows that know both: n, sum of i, sum of squares of i, sum of products."""

    def __init__(self, k: int):
        self.k, self.rows = k, 0
        self.sum, self.square, self.product = np.zeros(k), np.zeros(k), np.zeros((k, k))
        self.gaps = None

    def add(self, x: np.ndarray) -> None:
        known = ~np.isnan(x)
        full = known.all(1)
        if full.any():
            y = x[full]
            self.rows += len(y)
            self.sum += y.sum(0)
            self.square += (y * y).sum(0)
            self.product += y.T @ y
        if not full.all():
            if self.gaps is None:
                self.gaps = np.zeros((3, self.k, self.k))
            m = known[~full].astype(float)
            y = np.where(known[~full], x[~full], 0.0)
            self.gaps[0] += m.T @ m
            self.gaps[1] += y.T @ m
            self.gaps[2] += (y * y).T @ m
            self.product += y.T @ y

    def blocks(self, size: int) -> Iterator[tuple[int, int, bytes]]:
        cut = [slice(i, min(i + size, self.k)) for i in range(0, self.k, size)]
        for i, a in enumerate(cut):
            for j, b in enumerate(cut[i:], i):
                shape = (a.stop - a.start, b.stop - b.start)
                out = np.empty((6, *shape))
                out[0], out[5] = self.rows, self.product[a, b]
                out[1], out[2] = self.sum[a][:, None], self.sum[b][None, :]
                out[3], out[4] = self.square[a][:, None], self.square[b][None, :]
                if self.gaps is not None:
                    out[0] += self.gaps[0][a, b]
                    out[1], out[2] = out[1] + self.gaps[1][a, b], out[2] + self.gaps[1][b, a].T
                    out[3], out[4] = out[3] + self.gaps[2][a, b], out[4] + self.gaps[2][b, a].T
                yield i, j, out.tobytes()


def _correlations(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n and Pearson's r of a block; NaN for fewer than two rows or a constant side."""
    n, a, b, aa, bb, ab = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        va, vb = aa / n - (a / n) ** 2, bb / n - (b / n) ** 2
        r = (ab / n - a * b / n**2) / np.sqrt(va * vb)
        flat = (n < 2) | (va <= FLAT * aa / n) | (vb <= FLAT * bb / n)
    return n.astype(np.int64), np.where(flat, np.nan, np.clip(r, -1.0, 1.0))


def pairwise_correlations(df: DataFrame, features: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(feature_a, feature_b, n, r) of all pairs, pairwise complete: one scan. NaN counts as missing; r is NULL for fewer than
    two rows or where a side is constant. Values are taken from one of the first of each feature, so that large means cost no digits."""
    feats = list(features)
    k = len(feats)
    if k < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, n long, r double")
    cols = df.select(*[F.col(f).cast("double").alias(f"c{i}") for i, f in enumerate(feats)])
    first = cols.limit(1000).agg(*[F.first(F.when(F.abs(c) < 1e300, F.col(c)), ignorenulls=True) for c in cols.columns]).first()
    shift = np.array([0.0 if v is None else v for v in first], float)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sums(k)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                total.add(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns], axis=1) - shift)
        if total.rows or total.gaps is not None:
            for a, c, data in total.blocks(block):
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([c], pa.int32()), pa.array([data], pa.binary())], schema=_SUMS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for b in batches:
            for a, c, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (a, c) != key:
                    if key is not None:
                        yield made(key, total)
                    key, total = (a, c), 0.0
                total = total + np.frombuffer(data.as_buffer())
        if key is not None:
            yield made(key, total)

    def made(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        rows, columns = (min(block, k - x * block) for x in key)
        n, r = _correlations(total.reshape(6, rows, columns))
        i, j = np.indices(n.shape)
        i, j = i + key[0] * block, j + key[1] * block
        keep = i < j
        return pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), pa.array(n[keep], pa.int64()), pa.array(r[keep], pa.float64(), from_pandas=True)], schema=_PAIRS)

    sums = cols.mapInArrow(scan, "a int, b int, sums binary").repartition("a", "b").sortWithinPartitions("a", "b")
    pairs = sums.mapInArrow(merge, "pa int, pb int, n long, r double")
    names = F.array(*[F.lit(f) for f in feats]) if k <= 64 else None
    if names is not None:
        return pairs.select(names[F.col("pa")].alias("feature_a"), names[F.col("pb")].alias("feature_b"), "n", "r")
    place = df.sparkSession.createDataFrame(list(enumerate(feats)), "i int, name string")
    out = pairs.join(place.withColumnsRenamed({"i": "pa", "name": "feature_a"}), "pa").join(place.withColumnsRenamed({"i": "pb", "name": "feature_b"}), "pb")
    return out.select("feature_a", "feature_b", "n", "r")


def summed(parts: DataFrame) -> np.ndarray | None:
    """The sum of vectors, one of doubles in each row's only (binary) column: added up in two levels before it is collected."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(0):
                x = np.frombuffer(v.as_buffer())
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    rows = parts.repartition(16).mapInArrow(merge, "sums binary").coalesce(1).mapInArrow(merge, "sums binary").collect()  # one row
    return np.frombuffer(rows[0][0]).copy() if rows else None
