"""Batch and position correction, and the linear maps behind sphering and typical variation normalisation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.select import gram_matrix
from platewise.operators.stats import join_fit


def median_polish(grid: np.ndarray, max_iter: int = 10, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """(row effects, column effects, level) of a grid with gaps: rows, then columns, recentred after each half step."""
    r = grid.astype(float).copy()
    rows, cols, level, last = np.zeros(r.shape[0]), np.zeros(r.shape[1]), 0.0, np.inf
    with np.errstate(all="ignore"):
        for _ in range(max_iter):
            for axis, eff, other in ((1, rows, cols), (0, cols, rows)):
                m = np.array([np.median(v[~np.isnan(v)]) if (~np.isnan(v)).any() else 0.0 for v in (r if axis else r.T)])
                r = r - (m[:, None] if axis else m[None, :])
                eff += m
                mid = np.median(other)
                other -= mid
                level += mid
            total = np.nansum(np.abs(r))
            if abs(last - total) < tol:
                break
            last = total
    mid = np.median(rows)
    return rows - mid, cols, level + mid


def correct_plate_position(df: DataFrame, features: Sequence[str], plate: str, row: str, col: str, reference: Column | None = None, method: str = "b_score", max_iter: int = 10, tol: float = 1e-4) -> DataFrame:
    """Subtract the row and column effects of each plate, fitted by median polish on the well medians of reference rows.

    b_score then divides what is left by its MAD over the fitted wells after taking off its median; a zero MAD counts
    as 1. Only well medians (1,536 a plate at most) go to Python; effects are joined back.
    """
    feats = list(features)
    fit = df.where(reference) if reference is not None else df
    wells = fit.groupBy(plate, row, col).agg(*[F.median(f).alias(f) for f in feats])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf[row].to_numpy(int), pdf[col].to_numpy(int)
        out = []
        for f in feats:
            grid = np.full((i.max() + 1, j.max() + 1), np.nan)
            grid[i, j] = pdf[f].to_numpy(float)
            a, b, _ = median_polish(grid, max_iter, tol)
            resid = (grid - a[:, None] - b[None, :])[i, j]
            resid = resid[~np.isnan(resid)]
            mid = float(np.median(resid)) if len(resid) else 0.0
            mad = float(np.median(np.abs(resid - mid))) if len(resid) else 1.0
            out += [(f, "row", k, float(v), mid, mad or 1.0) for k, v in enumerate(a)] + [(f, "col", k, float(v), mid, mad or 1.0) for k, v in enumerate(b)]
        table = pd.DataFrame(out, columns=["feature", "axis", "k", "effect", "mid", "mad"])
        table.insert(0, plate, pdf[plate].iloc[0])
        return table

    kind = dict(df.dtypes)[plate]
    eff = wells.groupBy(plate).applyInPandas(run, f"`{plate}` {kind}, feature string, axis string, k int, effect double, mid double, mad double")

    def wide(axis: str, key: str) -> DataFrame:
        part = eff.where(F.col("axis") == axis).groupBy(plate, F.col("k").alias(key))
        return part.agg(*[F.max(F.when(F.col("feature") == f, F.col("effect"))).alias(f"{f}__{axis}") for f in feats], *([F.max(F.when(F.col("feature") == f, F.col(x))).alias(f"{f}__{x}") for f in feats for x in ("mid", "mad")] if axis == "row" else []))

    out = join_fit(join_fit(df, wide("row", row), [plate, row]), wide("col", col), [plate, col])
    cols = {}
    for f in feats:
        v = F.col(f) - F.coalesce(f"{f}__row", F.lit(0.0)) - F.coalesce(f"{f}__col", F.lit(0.0))
        cols[f] = (v - F.coalesce(f"{f}__mid", F.lit(0.0))) / F.coalesce(f"{f}__mad", F.lit(1.0)) if method == "b_score" else v
    return out.withColumns(cols).select(*df.columns)


def detect_plate_position(df: DataFrame, features: Sequence[str], plate: str, row: str, col: str, control: Column, n_splits: int = 5, min_controls: int = 20, seed: int = 0) -> DataFrame:
    """(group, n_controls, cv_r2_median, frac_features_positive, reason): out-of-fold R squared of the position model on control wells."""
    feats = list(features)
    wells = df.where(control).groupBy(plate, row, col).agg(*[F.median(f).alias(f) for f in feats])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, n = str(pdf[plate].iloc[0]), len(pdf)
        if n < min_controls:
            return pd.DataFrame({"group": [name], "n_controls": [n], "cv_r2_median": [np.nan], "frac_features_positive": [np.nan], "reason": ["too few controls"]})
        pdf = pdf.sort_values([row, col])
        i, j = pdf[row].to_numpy(int), pdf[col].to_numpy(int)
        fold = np.random.default_rng([seed, *name.encode()]).permutation(n) % n_splits
        r2 = []
        for f in feats:
            y, pred = pdf[f].to_numpy(float), np.zeros(n)
            for k in range(n_splits):
                grid = np.full((i.max() + 1, j.max() + 1), np.nan)
                grid[i[fold != k], j[fold != k]] = y[fold != k]
                a, b, level = median_polish(grid)
                pred[fold == k] = level + a[i[fold == k]] + b[j[fold == k]]
            ss = np.nansum((y - np.nanmean(y)) ** 2)
            if ss > 0:
                r2.append(1.0 - np.nansum((y - pred) ** 2) / ss)
        ok = len(r2) > 0
        return pd.DataFrame({"group": [name], "n_controls": [n], "cv_r2_median": [float(np.median(r2)) if ok else np.nan], "frac_features_positive": [float(np.mean(np.array(r2) > 0)) if ok else np.nan], "reason": ["" if ok else "constant"]})

    return wells.groupBy(plate).applyInPandas(run, "group string, n_controls long, cv_r2_median double, frac_features_positive double, reason string")


def regress_out_one(df: DataFrame, features: Sequence[str], key: str, by: Sequence[str], reference: Column | None = None) -> DataFrame:
    """Remove one numeric covariate by the closed-form slope of the reference rows of each group.

    x - slope * (covariate - anchor) with the covariate cut to the reference range and the reference mean as anchor;
    groups with fewer than three rows or a constant covariate stay.
    """
    fit = df.where(reference) if reference is not None else df
    k = F.col(key).cast("double")
    pairs = [F.regr_slope(F.col(f), k).alias(f"{f}__b") for f in features]
    stats = fit.groupBy(*by).agg(F.avg(k).alias("__a"), F.min(k).alias("__lo"), F.max(k).alias("__hi"), F.count(key).alias("__n"), *pairs)
    out = join_fit(df, stats, by)
    x = F.greatest(F.col("__lo"), F.least(F.col("__hi"), k)) if reference is not None else k
    cols = {f: F.when((F.col("__n") >= 3) & F.col(f"{f}__b").isNotNull() & ~F.isnan(f"{f}__b") & x.isNotNull(), F.col(f) - F.col(f"{f}__b") * (x - F.col("__a"))).otherwise(F.col(f)) for f in features}
    return out.withColumns(cols).select(*df.columns)


def regress_out(df: DataFrame, features: Sequence[str], keys: Sequence[str], by: Sequence[str], reference: Column | None = None) -> DataFrame:
    """Remove several covariates: numeric ones as they are, others as indicator columns.

    Normal equations are summed for each group over bounded blocks of rows, so no group is gathered; coefficients
    (design x features for each group) are broadcast back if their measured size allows it.
    """
    feats, kinds = list(features), dict(df.dtypes)
    numeric = [k for k in keys if kinds[k] in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    labels = [k for k in keys if k not in numeric]
    fit = df.where(reference) if reference is not None else df
    levels = {k: sorted(r[0] for r in df.select(k).distinct().limit(10_001).collect() if r[0] is not None)[1:] for k in labels}
    if any(len(v) > 1000 for v in levels.values()):
        raise ValueError("a label with more than 1,000 levels is no covariate")
    design = [F.lit(1.0), *[F.col(k).cast("double") for k in numeric], *[(F.col(k) == v).cast("double") for k in labels for v in levels[k]]]
    p = len(design)
    rows = fit.dropna(subset=[*keys, *feats]).select(*by, F.array(*design).alias("d"), F.array(*[F.col(f).cast("double") for f in feats]).alias("y"))
    xx = [F.sum(F.col("d")[i] * F.col("d")[j]) for i in range(p) for j in range(i, p)]
    xy = [F.sum(F.col("d")[i] * F.col("y")[j]) for i in range(p) for j in range(len(feats))]
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*xx).alias("xx"), F.array(*xy).alias("xy"))

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for k, u, v in zip(n, a, b):
            m, at = np.zeros((p, p)), 0
            for i in range(p):
                for j in range(i, p):
                    m[i, j] = m[j, i] = u[at]
                    at += 1
            if k < p + 1:
                out.append(np.zeros(p * len(feats)).tolist() + (m[0] / max(k, 1)).tolist())
                continue
            beta = np.linalg.lstsq(m, np.asarray(v, float).reshape(p, len(feats)), rcond=1e-10)[0]
            out.append(beta.ravel().tolist() + (m[0] / k).tolist())
        return pd.Series(out)

    coef = sums.select(*by, solve("n", "xx", "xy").alias("__b"))
    out = join_fit(df, coef, by)
    cols = {}
    for j, f in enumerate(feats):
        shift = F.lit(0.0)
        for i in range(1, p):
            shift = shift + F.col("__b")[i * len(feats) + j] * (design[i] - F.col("__b")[p * len(feats) + i])
        cols[f] = F.when(F.col("__b").isNotNull() & shift.isNotNull(), F.col(f) - shift).otherwise(F.col(f))
    return out.withColumns(cols).select(*df.columns)


def correct_chromosome_arm(df: DataFrame, features: Sequence[str], arm: str, gene: str, unexpressed: DataFrame, min_genes: int = 20) -> DataFrame:
    """Take the mean of the unexpressed genes of an arm off all its rows, where it has more than min_genes of them."""
    flagged = df.join(unexpressed.select(F.col("gene").alias("__g")).distinct(), F.col(gene) == F.col("__g"), "left")
    un = F.col("__g").isNotNull()
    fit = flagged.groupBy(arm).agg(F.count_distinct(F.when(un, F.col(gene))).alias("__n"), *[F.avg(F.when(un, F.col(f))).alias(f"{f}__m") for f in features])
    fit = fit.where(F.col("__n") > min_genes)
    out = join_fit(df, fit, [arm])
    return out.withColumns({f: F.col(f) - F.coalesce(f"{f}__m", F.lit(0.0)) for f in features}).select(*df.columns)


# ---------------------------------------------------------------- linear maps


def covariance(df: DataFrame, features: Sequence[str], ddof: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, rows) of complete rows; only features x features numbers reach the driver."""
    g, s, n = gram_matrix(df, features)
    mean = s / max(n, 1)
    return mean, (g - np.outer(mean, s)) / max(1, n - ddof), n


def apply_matrix(df: DataFrame, features: Sequence[str], matrix: np.ndarray, center: np.ndarray, names: Sequence[str] | None = None) -> DataFrame:
    """(row - centre) @ matrix as JVM expressions; above 64 x 64 in Arrow batches."""
    feats = list(features)
    names = list(names or feats)
    if len(feats) * len(names) <= 4096:
        cols = []
        for k, name in enumerate(names):
            v = F.lit(0.0)
            for i, f in enumerate(feats):
                v = v + (F.col(f) - float(center[i])) * float(matrix[i, k])
            cols.append(v.alias(name))
        return df.select(*[c for c in df.columns if c not in feats and c not in names], *cols)
    rest = [c for c in df.columns if c not in feats and c not in names]
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in rest] + [f"`{n}` double" for n in names])

    def run(batches):
        for b in batches:
            z = (b[feats].to_numpy(float) - center) @ matrix
            yield pd.concat([b[rest], pd.DataFrame(z, columns=names, index=b.index)], axis=1)

    return df.select(*rest, *feats).mapInPandas(run, schema)


def sphere_matrix(mean: np.ndarray, cov: np.ndarray, method: str = "ZCA-cor", epsilon: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(centre, map): whitening of the reference; -cor scales by sd first, ZCA rotates back."""
    sd = np.sqrt(np.diag(cov))
    if (sd <= 0).any() or not np.isfinite(cov).all():
        raise ValueError("the reference must be finite and vary in every feature")
    scale = 1.0 / sd if method.endswith("cor") else np.ones_like(sd)
    w, v = np.linalg.eigh(cov * np.outer(scale, scale))
    if w.min() <= 1e-12 * w.max():
        raise ValueError("the reference does not have full rank")
    m = v / (np.sqrt(w) + epsilon)
    if method.startswith("ZCA"):
        m = m @ v.T
    return mean, scale[:, None] * m


def sphere(df: DataFrame, features: Sequence[str], reference: Column, method: str = "ZCA-cor", epsilon: float = 1e-6) -> DataFrame:
    mean, cov, _ = covariance(df.where(reference), features)
    center, m = sphere_matrix(mean, cov, method, epsilon)
    return apply_matrix(df, features, m, center)


def select_epsilon(df: DataFrame, features: Sequence[str], reference: Column, label: str, row_id: str, epsilons: Sequence[float], method: str = "ZCA-cor") -> DataFrame:
    """(epsilon, score, best): mean average precision of the labels after sphering by one half of the reference, for each epsilon."""
    from platewise.operators.pairs import average_precision_rows

    fit = reference & (F.pmod(F.xxhash64(row_id), F.lit(2)) == 0)
    mean, cov, _ = covariance(df.where(fit), features)
    held = df.where(~F.coalesce(fit, F.lit(False)))
    rows = []
    for e in epsilons:
        center, m = sphere_matrix(mean, cov, method, e)
        z = apply_matrix(held, features, m, center).withColumn("__v", F.array(*features))
        score = average_precision_rows(z, row_id, "__v", pos_sameby=[label], neg_diffby=[label]).agg(F.avg("ap")).first()[0]
        rows.append((float(e), float(score or 0.0)))
    top = max(s for _, s in rows)
    return df.sparkSession.createDataFrame([(e, s, s == top) for e, s in rows], "epsilon double, score double, best boolean")


def symmetric_power(m: np.ndarray, power: float) -> np.ndarray:
    w, v = np.linalg.eigh(m)
    return (v * np.maximum(w, 1e-12) ** power) @ v.T


def tvn(df: DataFrame, features: Sequence[str], batch: str, reference: Column, epsilon: float = 0.5) -> DataFrame:
    """Typical variation normalisation: principal axes of the controls, rescaled by each batch's controls, then the
    covariance of each batch's controls carried to that of all (ridge epsilon on both)."""
    feats = list(features)
    k = len(feats)
    ctl = df.where(reference)
    mean, cov, _ = covariance(ctl, feats)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-24))
    w, v = np.linalg.eigh(cov / np.outer(sd, sd))
    axes = [f"__pc{i}" for i in range(k)]
    rotated = apply_matrix(df, feats, v[:, ::-1] / sd[:, None], mean, axes)
    rotated = rotated.withColumn("__ref", reference)
    stats = rotated.where("__ref").groupBy(batch).agg(*[F.avg(a).alias(f"{a}__m") for a in axes], *[F.stddev_samp(a).alias(f"{a}__s") for a in axes])
    scaled = join_fit(rotated, stats, [batch]).withColumns({a: (F.col(a) - F.col(f"{a}__m")) / F.when(F.col(f"{a}__s") > 0, F.col(f"{a}__s")).otherwise(1.0) for a in axes})
    scaled = scaled.drop(*[f"{a}__{x}" for a in axes for x in "ms"])
    _, target, _ = covariance(scaled.where("__ref"), axes)
    pairs = [F.covar_samp(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    each = scaled.where("__ref").groupBy(batch).agg(F.array(*pairs).alias("c"))
    goal = symmetric_power(target + epsilon * np.eye(k), 0.5)

    @F.pandas_udf("array<double>")
    def maps(c: pd.Series) -> pd.Series:
        out = []
        for u in c:
            m, at = np.zeros((k, k)), 0
            for i in range(k):
                for j in range(i, k):
                    m[i, j] = m[j, i] = u[at] if u[at] is not None and np.isfinite(u[at]) else float(i == j)
                    at += 1
            out.append((symmetric_power(m + epsilon * np.eye(k), -0.5) @ goal).ravel().tolist())
        return pd.Series(out)

    done = join_fit(scaled, each.select(batch, maps("c").alias("__w")), [batch])
    cols = []
    for j, f in enumerate(feats):
        z = F.lit(0.0)
        for i, a in enumerate(axes):
            z = z + F.col(a) * F.coalesce(F.col("__w")[i * k + j], F.lit(float(i == j)))
        cols.append(z.alias(f))
    return done.select(*[c for c in df.columns if c not in feats], *cols)


def pca(df: DataFrame, features: Sequence[str], n_comps: int, fit: Column | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(scores pc1…, loadings, variances): eigenvectors of the covariance of the fitted rows, largest element positive."""
    mean, cov, _ = covariance(df.where(fit) if fit is not None else df, features)
    w, v = np.linalg.eigh(cov)
    order = np.argsort(-w, kind="stable")[:n_comps]
    v = v[:, order]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return apply_matrix(df, features, v, mean, [f"pc{i + 1}" for i in range(len(order))]), v, w[order]
