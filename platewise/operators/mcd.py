"""Minimum covariance determinant of a table of any size: location and scatter of its most concentrated half.

The search starts on a bounded sample, as FAST-MCD does: random subsets of p + 1 rows in up to five parts of 300 rows, two
concentration steps each, the best of every part again on their union. Starts are dealt over the executors. What is best there
is concentrated on all rows: distances of every row in its own task, the h-th smallest by exact order statistics, and sums
of products as one aggregation a step. A last pass reweights: the rows within the 0.975 quantile of chi-square.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.special import gammaincc
from platewise.operators.quantiles import large_quantiles, order_statistics

STARTS, PART, PARTS, BEST = 500, 300, 5, 10

# Simulated small-sample factors by dimension (1 to 9) and number of rows from N_MIN on, raw and reweighted,
# and coefficients of the formulas beyond them.
N_MIN = (1, 4, 6, 8, 10, 12, 14, 16, 18)
RAW = (
    (1.0, 3.075819),
    (3.15342, 1.799889, 2.258497),
    (2.12777, 2.718898, 1.993509, 2.220433, 1.820585),
    (2.950549, 2.145387, 2.382224, 1.927077, 2.032489, 1.8371),
    (2.229573, 2.494447, 2.016117, 2.190061, 1.877996, 1.978964, 1.767284),
    (2.580264, 2.109121, 2.240741, 1.944719, 2.043397, 1.821808, 1.89725),
    (2.165233, 2.320281, 2.007836, 2.086471, 1.884052, 1.950563, 1.76926),
    (2.340443, 2.048262, 2.161097, 1.926082, 1.995422),
    (2.093386, 2.185793, 1.948989),
)
REWEIGHTED = (
    (1.0, 0.984724),
    (2.216302, 1.418526, 1.635601),
    (1.73511, 2.06681, 1.545905, 1.659655, 1.456835),
    (2.388892, 1.847626, 1.96998, 1.630723, 1.701272, 1.521008),
    (1.968153, 2.168931, 1.784373, 1.894409, 1.667912, 1.693007, 1.545176),
    (2.275891, 1.866587, 2.014249, 1.750567, 1.829363, 1.650019, 1.689043),
    (1.95771, 2.074066, 1.847385, 1.905408, 1.71393, 1.768425, 1.63908),
    (2.164121, 1.871024, 1.979485, 1.782417, 1.84489),
    (1.938822, 2.050409, 1.834863),
)
SMALL = {1: ((0.262024211897096, 0.604756680630497), (1.11098143415027, 1.5182890270453)), 2: ((0.673292623522027, 0.691365864961895), (3.11101712909049, 1.91401056721863))}
LARGE = (((-1.42764571687802, 1.26263336932151, 2), (-1.06141115981725, 1.28907991440387, 3)), ((-1.02842572724793, 1.67659883081926, 2), (-0.26800273450853, 1.35968562893582, 3)))


def subset_size(n: int, p: int) -> int:
    """h: the rows of the subset at the highest breakdown point."""
    return min(n, (n + p + 1) // 2)


def chi2_quantile(q: float, df: int) -> float:
    lo, hi = 0.0, 10.0 * df + 200.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if 1.0 - float(gammaincc(df / 2.0, mid / 2.0)) < q else (lo, mid)
    return (lo + hi) / 2.0


def consistency(p: int, share: float) -> float:
    """What the covariance of the central share of a Gaussian is short of the whole."""
    return 1.0 if share >= 1.0 else share / (1.0 - float(gammaincc(p / 2.0 + 1.0, chi2_quantile(share, p) / 2.0)))


def small_sample(p: int, n: int, reweighted: bool) -> float:
    if p <= len(N_MIN) and 0 <= n - N_MIN[p - 1] < len(RAW[p - 1]):
        return (REWEIGHTED if reweighted else RAW)[p - 1][n - N_MIN[p - 1]]
    if p <= 2:
        a, b = SMALL[p][reweighted]
    else:  # a line through the two fitted sizes, in logarithms
        (c2, e2, k2), (c3, e3, k3) = LARGE[reweighted]
        y2, y3, x2, x3 = math.log(-c2 / p**e2), math.log(-c3 / p**e3), -math.log(k2 * p * p), -math.log(k3 * p * p)
        b = (y3 - y2) / (x3 - x2)
        a = y2 - b * x2
    return 1.0 / (1.0 - math.exp(a) / n**b)


def _fit(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log determinant (-inf if singular), mean and covariance of rows."""
    mean = x.mean(0)
    cov = (x - mean).T @ (x - mean) / max(1, len(x) - 1)
    return _logdet(cov), mean, cov


def _logdet(cov: np.ndarray) -> float:
    w = np.linalg.eigvalsh(cov)
    return -np.inf if w[0] <= 1e-12 * max(w[-1], 1e-300) else float(np.log(w).sum())


def _squared(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(cov), x - mean)


def concentrate(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    last = (np.inf, mean, cov)
    for _ in range(steps):
        found = _fit(x[np.argsort(_squared(x, last[1], last[2]), kind="stable")[:h]])
        if found[0] == -np.inf or found[0] >= last[0] - 1e-13 * abs(last[0]):
            return found if found[0] < last[0] else last
        last = found
    return last


def _start(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """A regular subset: p + 1 random rows, and more while they lie on a hyperplane."""
    order = rng.permutation(len(x))
    for k in range(x.shape[1] + 1, len(x) + 1):
        det, mean, cov = _fit(x[order[:k]])
        if det > -np.inf:
            return mean, cov
    return None


def _search(spark, x: np.ndarray, share: float, n: int, seed: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The best fits of the bounded sample x, from random starts in the executors."""
    p = x.shape[1]
    groups = 1 if n < 2 * PART else min(len(x) // PART, PARTS)
    cut = np.array_split(np.random.default_rng([seed, 0]).permutation(len(x)), groups)
    sent = spark.sparkContext.broadcast((x, cut))
    per, tasks = STARTS // groups, 8

    def run(frames):
        x, cut = sent.value
        for df in frames:
            out = []
            for g, t in zip(df["id"] // tasks, df["id"] % tasks):
                part, best = x[cut[g]], []
                h = max(p + 1, int(len(part) * share))
                for s in range(t, per, tasks):
                    first = _start(part, np.random.default_rng([seed, 1, g, s]))
                    if first is not None:
                        best.append(concentrate(part, *first, h, 2))
                best = sorted((b for b in best if b[0] < np.inf), key=lambda b: b[0])[:BEST]
                whole = max(p + 1, int(len(x) * share))
                out += [concentrate(x, b[1], b[2], whole, 2) for b in best] if groups > 1 else best
            out = sorted((b for b in out if b[0] < np.inf), key=lambda b: b[0])[:BEST]
            yield pd.DataFrame({"det": [b[0] for b in out], "mean": [b[1].tolist() for b in out], "cov": [b[2].ravel().tolist() for b in out]})

    rows = spark.range(groups * tasks, numPartitions=groups * tasks).mapInPandas(run, "det double, mean array<double>, cov array<double>")
    rows = rows.orderBy("det").limit(BEST * groups).toPandas()
    found, seen = [], set()
    for r in rows.itertuples():
        if round(r.det, 9) not in seen and len(found) < BEST:
            seen.add(round(r.det, 9))
            found.append((r.det, np.array(r.mean), np.array(r.cov).reshape(p, p)))
    return found


def _weighted_sums(rows: DataFrame, p: int, fits: list[tuple[np.ndarray, np.ndarray]], cut: list[tuple[float, float]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """n, mean and covariance for each fit, of the rows nearer than its cut; rows at the cut count by the second number."""
    inverse = [(m, np.linalg.inv(c)) for m, c in fits]

    def scan(batches):
        total = np.zeros((len(fits), 1 + p + p * p))
        for b in batches:
            x = np.stack(b.column(0).to_numpy(zero_copy_only=False)) if b.num_rows else np.empty((0, p))
            for i, ((mean, inv), (limit, tie)) in enumerate(zip(inverse, cut)):
                y = x - mean
                d = np.einsum("ij,ij->i", y @ inv, y)
                w = np.where(d < limit, 1.0, np.where(d == limit, tie, 0.0))
                y, w = y[w > 0], w[w > 0]
                total[i] += np.concatenate(([w.sum()], w @ y, ((y * w[:, None]).T @ y).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(fits)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["fit", "sums"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), b.column(1)):
                total[i] = total.get(i, 0.0) + np.frombuffer(s.as_buffer())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["fit", "sums"])

    parts = rows.select("x").mapInArrow(scan, "fit int, sums binary")
    few = parts.repartition(16).mapInArrow(merge, "fit int, sums binary").repartition("fit").mapInArrow(merge, "fit int, sums binary").collect()  # a row for each fit
    out: list = [None] * len(fits)
    for r in few:
        s = np.frombuffer(r["sums"])
        n, one, two = s[0], s[1 : 1 + p], s[1 + p :].reshape(p, p)
        off = one / n
        out[r["fit"]] = (n, fits[r["fit"]][0] + off, (two - n * np.outer(off, off)) / max(1.0, n - 1.0))
    return out


def _step(rows: DataFrame, p: int, fits: list[tuple[np.ndarray, np.ndarray]], h: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """One concentration step of several fits over all rows."""
    inverse = [(m, np.linalg.inv(c)) for m, c in fits]

    def distances(batches):
        for b in batches:
            x = np.stack(b.column(0).to_numpy(zero_copy_only=False)) if b.num_rows else np.empty((0, p))
            d = [np.einsum("ij,ij->i", (x - m) @ inv, x - m) for m, inv in inverse]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(d)), len(x)), pa.int32()), pa.array(np.concatenate(d))], names=["fit", "d"])

    far = rows.select("x").mapInArrow(distances, "fit int, d double")
    limit = {r["fit"]: r["value"] for r in order_statistics(far, ["fit"], "d", F.array(F.lit(h - 1).cast("long"))).collect()}  # a row for each fit
    cuts = F.create_map(*[F.lit(v) for i in range(len(fits)) for v in (i, limit[i])])
    edge = {r["fit"]: (r["less"], r["same"]) for r in far.groupBy("fit").agg(F.count(F.when(F.col("d") < cuts[F.col("fit")], 1)).alias("less"), F.count(F.when(F.col("d") == cuts[F.col("fit")], 1)).alias("same")).collect()}
    sums = _weighted_sums(rows, p, fits, [(limit[i], (h - edge[i][0]) / edge[i][1]) for i in range(len(fits))])
    return [(_logdet(c), m, c) for _, m, c in sums]


def robust_covariance(df: DataFrame, features: Sequence[str], row_id: str, seed: int = 0, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(location, scatter) of the complete rows. Rows that stray do not widen it, as long as they are fewer than half.

    The sample that starts are made on is the first 1,500 rows in a hash order of their ids; all rows decide.
    """
    feats, p = list(features), len(features)
    rows = df.select(F.col(row_id).alias("__id"), *[F.col(f).cast("double").alias(f) for f in feats]).dropna(subset=feats)
    n = rows.count()
    if n <= p + 1:
        raise ValueError(f"{n} complete rows are too few for {p} features")
    h = subset_size(n, p)
    median = {r["feature"]: r["q0"] for r in large_quantiles(rows, [], feats, [0.5]).collect()}
    far = rows.select(*[F.abs(F.col(f) - F.lit(float(median[f]))).alias(f) for f in feats]).unpivot([], feats, "feature", "far")
    scale = {r["feature"]: r["value"] for r in order_statistics(far, ["feature"], "far", F.array(F.lit(h - 1).cast("long"))).collect()}
    centre, spread = np.array([median[f] for f in feats], float), np.array([scale[f] for f in feats], float)
    if (spread <= 0).any():
        raise ValueError("half of the rows or more share a value of a feature: their covariance is singular")
    scaled = rows.select("__id", F.array(*[(F.col(f) - float(m)) / float(s) for f, m, s in zip(feats, centre, spread)]).alias("x"))
    sample = scaled.withColumn("__h", F.xxhash64(F.lit(seed), "__id")).orderBy("__h", "__id").limit(PART * PARTS).toPandas()["x"]
    x = np.array([np.asarray(v, float) for v in sample])
    fits = _search(df.sparkSession, x, h / n, n, seed)
    if not fits:
        raise ValueError("more than half of the rows lie on a hyperplane: their covariance is singular")
    if n <= len(x):
        best = min((concentrate(x, m, c, h, 100) for _, m, c in fits), key=lambda b: b[0])
    else:
        fits = fits if n <= 20 * PART * PARTS else fits[:1]
        best = min(_step(scaled, p, [f[1:] for f in fits], h), key=lambda b: b[0])
        for _ in range(steps):
            found = _step(scaled, p, [best[1:]], h)[0]
            if not found[0] < best[0] - 1e-12 * abs(best[0]):
                break
            best = found
    if best[0] == -np.inf:
        raise ValueError("more than half of the rows lie on a hyperplane: their covariance is singular")
    raw = best[2] * consistency(p, h / n) * small_sample(p, n, False)
    kept, mean, cov = _weighted_sums(scaled, p, [(best[1], raw)], [(chi2_quantile(0.975, p), 0.0)])[0]
    if kept < n:
        cov = cov * consistency(p, 0.975) * small_sample(p, n, True)
    return mean * spread + centre, cov * np.outer(spread, spread)
