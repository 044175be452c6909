"""Group-relative transforms: the fit sees reference rows only, the result covers all rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.special import col_ndtri
from platewise.operators.reference import check_reference, resolve
from platewise.operators.stats import MAD_SCALE, NO_SPREAD, average_rank, join_fit, median_and_spread

METHODS = ("mad_robustize", "standardize", "robustize", "center")


def fit(df: DataFrame, features: Sequence[str], by: Sequence[str], reference=None, method: str = "mad_robustize", epsilon: float = 1e-18) -> DataFrame:
    """(by…, f__c, f__s): centre and scale of each group and feature.

    mad_robustize: median and 1.4826 MAD + epsilon; standardize: mean and population sd; robustize: median and
    interquartile range; center: median and 1. No spread leaves the scale NULL. A group that measured nothing has
    centre 0 and scale 1, so its values stay.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    ref = resolve(df, reference)
    rows = df.where(ref)
    if method == "standardize":
        raw = rows.groupBy(*by).agg(*[F.avg(f).alias(f"{f}__c") for f in features], *[F.stddev_pop(f).alias(f"{f}__s") for f in features])
    elif method == "robustize":
        raw = median_and_spread(rows, by, features, "iqr")
    elif method == "mad_robustize":
        raw = median_and_spread(rows, by, features, "mad")
        raw = raw.withColumns({f"{f}__s": F.col(f"{f}__s") * MAD_SCALE for f in features})
    else:
        raw = rows.groupBy(*by).agg(*[F.median(f).alias(f"{f}__c") for f in features])
        raw = raw.withColumns({f"{f}__s": F.lit(1.0) for f in features})

    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    cols = {}
    for f in features:
        c, s = F.col(f"{f}__c"), F.col(f"{f}__s")
        known = finite(c) & finite(s)
        add = epsilon if method == "mad_robustize" else 0.0
        cols[f"{f}__s"] = F.when(known & (s > NO_SPREAD), s + add).when(known, F.lit(None).cast("double")).otherwise(1.0)
        cols[f"{f}__c"] = F.when(known, c).otherwise(0.0)
    return raw.select(*by, *[v.alias(k) for k, v in cols.items()])


def apply_fit(df: DataFrame, fitted: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(x - centre) / scale by a table of `fit`; row-local but for the join, so it also runs on a stream."""
    out = join_fit(df, fitted, by)
    return out.withColumns({f: (F.col(f) - F.col(f"{f}__c")) / F.col(f"{f}__s") for f in features}).select(*df.columns)


def normalize(df: DataFrame, features: Sequence[str], by: Sequence[str] = ("Metadata_Plate",), reference="negcon", method: str = "mad_robustize", epsilon: float = 1e-18, check: bool = True) -> DataFrame:
    """The flagship transform. Refuses groups without reference rows unless `check` is off."""
    if check:
        check_reference(df, resolve(df, reference), by)
    return apply_fit(df, fit(df, features, by, reference, method, epsilon), features, by)


def erased_treatments(df: DataFrame, by: Sequence[str], treatment: str) -> DataFrame:
    """Groups whose treatment never varies while it varies between groups: normalising on all rows would erase it."""
    each = df.groupBy(*by).agg(F.count_distinct(treatment).alias("within"), F.min(treatment).alias("only"))
    total = each.agg(F.max("within").alias("most"), F.count_distinct("only").alias("levels"))
    return total.select(((F.col("most") <= 1) & (F.col("levels") > 1)).alias("erased"), F.col("most").alias("max_within"), "levels")


def rank_int(df: DataFrame, features: Sequence[str], by: Sequence[str], row_id: str, c: float = 0.375, stochastic: bool = False, seed: int = 0) -> DataFrame:
    """Rank-based inverse normal transform of finite values: ndtri((rank - c) / (n - 2 c + 1)).

    stochastic breaks ties by a hash of row id and seed, the same for all features.
    """
    out = df
    for f in features:
        ok = F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf"))
        key = [*by, ok]
        if stochastic:
            rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(f), F.xxhash64(F.lit(seed), row_id)))
        else:
            rank = average_rank(F.col(f), key)
        n = F.count(F.lit(1)).over(Window.partitionBy(*key))
        out = out.withColumn(f"__{f}", F.when(ok, (rank - c) / (n - 2 * c + 1)))
    return out.withColumns({f: col_ndtri(f"__{f}") for f in features}).drop(*[f"__{f}" for f in features])


def rank_int_quantile(df: DataFrame, feature: str, by: Sequence[str], c: float = 0.375) -> DataFrame:
    """The quantile that `rank_int` maps, without the inverse normal."""
    ok = F.col(feature).isNotNull()
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, ok))
    return df.withColumn("quantile", F.when(ok, (average_rank(F.col(feature), [*by, ok]) - c) / (n - 2 * c + 1)))


def impute(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), reference=None, method: str = "reference_median", k: int = 5, n_donors: int = 10_000, row_id: str | None = None) -> DataFrame:
    """Fill NULLs: zero, the reference median of the group, or the mean of the k nearest donors that measured the feature.

    knn donors are at most n_donors reference rows of the group, the first by a hash of the row id; distances skip
    missing coordinates and scale up by their share. Only rows with gaps are sent to Python, those of a group in parts that
    each meet all its donors.
    """
    if method == "zero":
        return df.fillna(0.0, list(features))
    ref = resolve(df, reference)
    if method == "reference_median":
        med = df.where(ref).groupBy(*by).agg(*[F.median(f).alias(f"{f}__m") for f in features])
        return join_fit(df, med, by).withColumns({f: F.coalesce(f, f"{f}__m") for f in features}).select(*df.columns)
    if method != "knn" or row_id is None:
        raise ValueError("method is zero, reference_median or knn (with row_id)")
    feats = list(features)
    order = Window.partitionBy(*by).orderBy(F.xxhash64(row_id), row_id)
    donors = df.where(ref).withColumn("__d", F.row_number().over(order)).where(F.col("__d") <= n_donors)
    donors = donors.select(*[F.col(b).alias(f"__by_{b}") for b in by], *[F.col(f).alias(f"__donor_{f}") for f in feats])
    gaps = df.where(" or ".join(f"`{f}` is null" for f in feats))
    whole = df.where(" and ".join(f"`{f}` is not null" for f in feats))

    columns = [*gaps.columns, *([] if by else ["__all"])]

    def fill(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        donors_of = right.rename(columns={f"__donor_{f}": f for f in feats})
        return knn_fill(left, donors_of, feats, k)[columns] if len(left) else pd.DataFrame(columns=columns)

    if not by:
        gaps, donors = gaps.withColumn("__all", F.lit(1)), donors.withColumn("__by___all", F.lit(1))
    keys = list(by) or ["__all"]
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    schema = gaps.schema
    gaps = gaps.withColumn("__part", F.pmod(F.xxhash64(F.lit(1), row_id), F.lit(parts)))
    donors = donors.withColumn("__by___part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    keys = [*keys, "__part"]
    filled = gaps.groupBy(*keys).cogroup(donors.groupBy(*[f"__by_{b}" for b in keys])).applyInPandas(fill, schema).select(*df.columns)
    return whole.unionByName(filled)


def knn_fill(left: pd.DataFrame, right: pd.DataFrame, features: list[str], k: int) -> pd.DataFrame:
    if not len(left):
        return left
    x, d = left[features].to_numpy(float), right[features].to_numpy(float) if len(right) else np.empty((0, len(features)))
    out, have = x.copy(), ~np.isnan(d)
    mean = np.array([d[have[:, j], j].mean() if have[:, j].any() else np.nan for j in range(d.shape[1])]) if len(d) else np.full(x.shape[1], np.nan)
    known = ~np.isnan(x)
    gaps = np.flatnonzero(~known.all(1))
    if not len(gaps):
        return left
    kinds, which = np.unique(known[gaps], axis=0, return_inverse=True)
    filled = np.nan_to_num(d)
    for t, seen in enumerate(kinds):
        rows = gaps[which.reshape(-1) == t]
        n = (have & seen).sum(1)
        for j in np.flatnonzero(~seen):
            donors = np.flatnonzero(have[:, j] & (n > 0))  # in the order that decides between equal distances
            if not len(donors):
                out[rows, j] = mean[j]
                continue
            use = [(filled[donors, f], None if have[donors, f].all() else have[donors, f]) for f in np.flatnonzero(seen)]
            share, value = n[donors], d[donors, j]
            step, take = max(1, 500_000 // len(donors)), min(k, len(donors))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                dist = np.zeros((len(part), len(donors)))
                for f, (v, ok) in zip(np.flatnonzero(seen), use):
                    gap = v[None, :] - np.nan_to_num(x[part, f])[:, None]
                    gap *= gap
                    dist += gap if ok is None else np.where(ok, gap, 0.0)
                dist = dist * x.shape[1] / share
                bound = np.partition(dist, take - 1, axis=1)[:, take - 1]
                finite = np.isfinite(dist)
                p, q = np.nonzero((dist <= bound[:, None]) & finite)
                order = np.lexsort((q, dist[p, q], p))
                first = np.searchsorted(p[order], np.arange(len(part)))
                best = order[np.arange(len(order)) - first[p[order]] < take]
                count = np.bincount(p[best], minlength=len(part))
                total = np.bincount(p[best], value[q[best]], len(part))
                out[part, j] = np.where(count > 0, total / np.maximum(count, 1), mean[j])
    return left.assign(**{f: out[:, j] for j, f in enumerate(features)})
