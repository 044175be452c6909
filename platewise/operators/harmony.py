"""Harmony: batch correction by soft clusters that are rewarded for mixing batches.

A k-means start gives centres on the sphere. A round assigns rows softly, block by block, each block against the counts of the
others, with a penalty on clusters that already hold more of the row's batch than its share; centres follow. When the
objective stands still, each cluster's batch offsets are fitted by ridge regression on the uncorrected rows, the offsets a row's
clusters give are taken off, and the next round starts from the corrected rows. Rows are never collected: a row's state is a
function of the parameters so far, so a pass sends parameters out and brings sums of clusters by batches back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.gram import summed

#: Rows that k-means++ seeds are drawn from, the first in a hash order.
SEEDS = 4000
#: Batches at most: clusters by batches of numbers are in the driver.
BATCHES = 10_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def assign(z: np.ndarray, batch: np.ndarray, centres: np.ndarray, penalty: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Soft assignment of rows on the sphere and their distances; penalty: log weight of each cluster and batch."""
    dist = 2.0 * (1.0 - z @ centres.T)
    logit = -dist / sigma + penalty[:, batch].T
    r = np.exp(logit - logit.max(1, keepdims=True))
    return r / r.sum(1, keepdims=True), dist


@dataclass
class Round:
    """What corrected the rows once: centres, a penalty for each block, and offsets (clusters, batches, features)."""

    centres: np.ndarray
    penalty: list[np.ndarray]
    offsets: np.ndarray


def corrected(x: np.ndarray, batch: np.ndarray, block: np.ndarray, rounds: Sequence[Round], sigma: float) -> np.ndarray:
    """Rows after all rounds: each assigns what the one before left and takes its offsets off the original rows."""
    z = x
    for t in rounds:
        z, now = x.copy(), z
        for b in np.unique(block):
            own = block == b
            r, _ = assign(_unit(now[own]), batch[own], t.centres, t.penalty[b], sigma)
            z[own] -= np.einsum("nk,knf->nf", r, t.offsets[:, batch[own]])
    return z


def ridge_offsets(counts: np.ndarray, sums: np.ndarray, ridge: float) -> np.ndarray:
    """Offsets of each cluster's batches: a mean for the cluster, not penalised, and shrunk deviations of the batches.

    counts (clusters, batches), sums (clusters, batches, features).
    """
    out = np.zeros_like(sums)
    n_batches = counts.shape[1]
    for k in range(len(counts)):
        n = counts[k]
        a = np.zeros((1 + n_batches, 1 + n_batches))
        a[0, 0], a[0, 1:], a[1:, 0] = n.sum(), n, n
        a[1:, 1:] = np.diag(n + ridge)
        out[k] = np.linalg.solve(a + 1e-12 * np.eye(len(a)), np.vstack((sums[k].sum(0), sums[k])))[1:]
    return out


def harmony(df: DataFrame, features: Sequence[str], batch: str, n_clusters: int | None = None, max_iter: int = 10, sigma: float = 0.1, ridge: float = 1.0, theta: float = 2.0, seed: int = 0, blocks: int = 5, max_iter_cluster: int = 8, tolerance: float = 1e-4, tolerance_cluster: float = 1e-3, history: list | None = None) -> DataFrame:
    """The table with corrected features. A batch of NULL is a batch; rows with a missing feature stay as they are.

    history gets the objective after every pass over all blocks.
    """
    feats, d = list(features), len(features)
    names = [r[0] for r in df.select(batch).distinct().limit(BATCHES + 1).collect()]
    if len(names) < 2:
        raise ValueError(f"{batch!r} has one level, so there is nothing to correct for")
    if len(names) > BATCHES:
        raise ValueError(f"more than {BATCHES} batches")
    names.sort(key=lambda b: (b is not None, b))
    place = {b: i for i, b in enumerate(names)}
    ids = F.coalesce(*[F.when(F.col(batch).eqNullSafe(F.lit(b)), i) for b, i in place.items()]) if len(names) <= 50 else None
    block = F.pmod(F.xxhash64(F.lit(seed), *feats), F.lit(blocks)).cast("int")
    rows = df.select(batch, *[F.col(f).cast("double").alias(f) for f in feats]).dropna(subset=feats)
    rows = rows.select(F.array(*feats).alias("x"), batch, block.alias("block"))
    if ids is not None:
        rows = rows.withColumn("b", ids.cast("int")).drop(batch)
    else:
        table = df.sparkSession.createDataFrame(list(enumerate(names)), f"b int, __name {dict(df.dtypes)[batch]}")
        rows = rows.join(table, F.col(batch).eqNullSafe(F.col("__name"))).drop(batch, "__name")

    def passed(what, where=None) -> np.ndarray:
        """Sum over the rows of what(x, b, block) as one vector."""

        def run(batches):
            import pyarrow as pa

            total = None
            for part in batches:
                if part.num_rows:
                    x = np.stack(part.column(0).to_numpy(zero_copy_only=False))
                    v = what(x, part.column(2).to_numpy(), part.column(1).to_numpy())
                    total = v if total is None else total + v
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        picked = rows.select("x", "block", "b")
        return summed((picked if where is None else picked.where(where)).mapInArrow(run, "sums binary"))

    size = passed(lambda x, b, block: np.bincount(b, minlength=len(names)).astype(float))
    n, share = size.sum(), size / size.sum()
    k = n_clusters or int(min(100, max(2, round(n / 30))))
    seeds = rows.select("x", F.xxhash64(F.lit(seed + 1), "x", "b").alias("h")).orderBy("h").limit(SEEDS).toPandas()["x"]
    centres = _plus_plus(_unit(np.array([np.asarray(v, float) for v in seeds])), k, np.random.default_rng(seed))
    k = len(centres)
    for _ in range(10):  # k-means on the sphere

        def nearest(x, b, block, c=centres):
            z = _unit(x)
            own = np.zeros((len(z), k))
            own[np.arange(len(z)), (z @ c.T).argmax(1)] = 1.0
            return (own.T @ z).ravel()

        moved = passed(nearest).reshape(k, d)
        moved = np.where(np.linalg.norm(moved, axis=1, keepdims=True) > 0, _unit(moved), centres)
        done = np.abs(moved - centres).max() < 1e-6
        centres = moved
        if done:
            break

    rounds: list[Round] = []
    penalty = [np.zeros((k, len(names))) for _ in range(blocks)]
    counts = None
    objective: list[float] = []

    def measured(x, b, block, now, pen):
        """Of assigned rows: counts by batch, sums on the sphere, distance and entropy terms."""
        z = _unit(corrected(x, b, block, rounds, sigma))
        counts, sums, terms = np.zeros((k, len(names))), np.zeros((k, d)), np.zeros(2)
        for i in np.unique(block):
            own = block == i
            r, dist = assign(z[own], b[own], now, pen[i], sigma)
            np.add.at(counts.T, b[own], r)
            sums += r.T @ z[own]
            terms += [(r * dist).sum(), sigma * (r * np.log(np.maximum(r, 1e-300))).sum()]
        return np.concatenate((counts.ravel(), sums.ravel(), terms))

    split = lambda v: (v[: k * len(names)].reshape(k, -1), v[k * len(names) : -2].reshape(k, d), v[-2:])
    for _ in range(max_iter):
        now = centres
        each = [split(passed(lambda x, b, block: measured(x, b, block, now, penalty), F.col("block") == i)) if i in _present(rows, blocks) else None for i in range(blocks)] if counts is None else counts
        for _ in range(max_iter_cluster):
            centres = _unit(sum(e[1] for e in each if e is not None))
            for i in range(blocks):
                if each[i] is None:
                    continue
                held = sum(e[0] for j, e in enumerate(each) if e is not None and j != i) if sum(e is not None for e in each) > 1 else np.zeros((k, len(names)))
                expected = held.sum(1, keepdims=True) * share[None, :]
                penalty[i] = theta * np.log((expected + 1.0) / (held + 1.0))
                each[i] = split(passed(lambda x, b, block: measured(x, b, block, centres, penalty), F.col("block") == i))
            held = sum(e[0] for e in each if e is not None)
            expected = held.sum(1, keepdims=True) * share[None, :]
            terms = sum(e[2] for e in each if e is not None)
            objective.append(float(terms.sum() + sigma * theta * (held * np.log((held + 1.0) / (expected + 1.0))).sum()))
            if len(objective) > 1 and abs(objective[-2] - objective[-1]) < tolerance_cluster * abs(objective[-2]):
                break

        def moments(x, b, block):
            z = _unit(corrected(x, b, block, rounds, sigma))
            counts, sums = np.zeros((k, len(names))), np.zeros((len(names), k, d))
            for i in np.unique(block):
                own = block == i
                r, _ = assign(z[own], b[own], centres, penalty[i], sigma)
                np.add.at(counts.T, b[own], r)
                np.add.at(sums, b[own], r[:, :, None] * x[own][:, None, :])
            return np.concatenate((counts.ravel(), sums.transpose(1, 0, 2).ravel()))

        v = passed(moments)
        offsets = ridge_offsets(v[: k * len(names)].reshape(k, -1), v[k * len(names) :].reshape(k, len(names), d), ridge)
        change = np.abs(offsets - rounds[-1].offsets).max() if rounds else np.inf
        rounds.append(Round(centres.copy(), [p.copy() for p in penalty], offsets))
        counts = None
        if change < tolerance * max(1e-12, np.abs(offsets).max()):
            break
    if history is not None:
        history += objective

    def run(frames):
        for pdf in frames:
            x = pdf[feats].to_numpy(float, na_value=np.nan)
            known = ~np.isnan(x).any(1)
            b = pdf[batch].map(lambda v: place[None if pd.isna(v) else v]).to_numpy(int)
            x[known] = corrected(x[known], b[known], pdf["__block"].to_numpy()[known], rounds, sigma)
            yield pdf.assign(**{f: x[:, j] for j, f in enumerate(feats)}).drop(columns="__block")

    names_out = ", ".join(f"`{c}` {'double' if c in feats else t}" for c, t in df.dtypes)
    typed = df.withColumns({f: F.col(f).cast("double") for f in feats})
    return typed.withColumn("__block", block).mapInPandas(run, names_out)


def _present(rows: DataFrame, blocks: int) -> set[int]:
    return {r[0] for r in rows.select("block").distinct().collect()}  # at most as many as there are blocks


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Seeds far from one another, of the distinct rows of a sample."""
    x = np.unique(x, axis=0)
    picked = [int(rng.integers(len(x)))]
    far = 2.0 * (1.0 - x @ x[picked[0]])
    while len(picked) < min(k, len(x)):
        p = np.maximum(far, 0.0)
        if p.sum() <= 0:
            break
        picked.append(int(rng.choice(len(x), p=p / p.sum())))
        far = np.minimum(far, 2.0 * (1.0 - x @ x[picked[-1]]))
    return x[picked]
