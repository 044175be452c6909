"""Row, well and image quality control, outlier scores and sampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.stats import MAD_SCALE, average_rank, join_fit, median_and_spread, robust_z, to_long
from platewise.operators.tiles import nearest_neighbours

AREA_CUTOFF = 5.0


def qc_fail(flags: Sequence[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def row_missing(df: DataFrame, features: Sequence[str], max_fraction: float = 0.5) -> DataFrame:
    """qc_n_missing, qc_missing_fraction and qc_high_nan (fraction above the limit)."""
    n = sum((F.col(f).isNull().cast("int") for f in features), F.lit(0)).cast("long")
    return df.withColumns({"qc_n_missing": n, "qc_missing_fraction": n / float(len(features)), "qc_high_nan": n / float(len(features)) > max_fraction})


def border_flag(x: Column, y: Column, width: float, height: float, margin: float = 10.0) -> Column:
    return (x < margin) | (y < margin) | (x > width - margin) | (y > height - margin)


def area_outliers(df: DataFrame, area: Sequence[str], by: Sequence[str], cutoff: float = AREA_CUTOFF) -> DataFrame:
    """qc_area_outlier: any area feature further than cutoff robust deviations from its plate's median."""
    z = join_fit(df, median_and_spread(df, by, area), by)
    flag = qc_fail([F.abs(robust_z(F.col(f), F.col(f"{f}__c"), F.col(f"{f}__s"))) > cutoff for f in area])
    return z.withColumn("qc_area_outlier", flag).drop(*[f"{f}__{x}" for f in area for x in "cs"])


def calculate_qc_metrics(df: DataFrame, features: Sequence[str], by: Sequence[str], area: Sequence[str] = (), position: tuple[str, str] | None = None, image_shape: tuple[float, float] | None = None, margin: float = 10.0, max_nan_fraction: float = 0.5) -> DataFrame:
    """All row flags and qc_fail, the union of them."""
    out = row_missing(df, features, max_nan_fraction)
    flags = ["qc_high_nan"]
    if position and image_shape:
        out = out.withColumn("qc_border", border_flag(F.col(position[0]), F.col(position[1]), *image_shape, margin))
        flags.append("qc_border")
    if area:
        out = area_outliers(out, area, by)
        flags.append("qc_area_outlier")
    return out.withColumn("qc_fail", qc_fail([F.col(f) for f in flags]))


def feature_metrics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, n_missing, variance, n_distinct) in one aggregation."""
    aggs = [F.struct(F.lit(f).alias("feature"), F.count(F.when(F.col(f).isNull(), 1)).alias("n_missing"), F.var_pop(f).alias("variance"), F.count_distinct(f).alias("n_distinct")) for f in features]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def filter_cells(df: DataFrame, wells: Sequence[str], min_cells: int = 50, flag: str | None = "qc_fail") -> DataFrame:
    """Drop failed rows, then wells with too few survivors."""
    kept = df.where(~F.col(flag)) if flag else df
    n = F.count(F.lit(1)).over(Window.partitionBy(*wells))
    return kept.withColumn("__n", n).where(F.col("__n") >= min_cells).drop("__n")


def filter_features(metrics: DataFrame, n_rows: int, min_variance: float = 0.0, blocklist: Sequence[str] = ()) -> DataFrame:
    """Features that are not all missing, vary more than min_variance (if above 0) and are not listed."""
    keep = F.col("n_missing") < n_rows
    if min_variance > 0:
        keep = keep & (F.coalesce("variance", F.lit(0.0)) > min_variance)
    if blocklist:
        keep = keep & ~F.col("feature").isin(*blocklist)
    return metrics.where(keep)


def image_qc_mad(images: DataFrame, metrics: Sequence[str], by: Sequence[str], threshold: float = 5.0) -> DataFrame:
    """qc_image_score: the largest absolute robust z of an image's metrics; qc_image_fail above the threshold."""
    z = join_fit(images, median_and_spread(images, by, metrics), by)
    score = F.greatest(*[F.abs(robust_z(F.col(m), F.col(f"{m}__c"), F.col(f"{m}__s"))) for m in metrics], F.lit(0.0))
    return z.withColumn("qc_image_score", score).withColumn("qc_image_fail", score > threshold).select(*images.columns, "qc_image_score", "qc_image_fail")


def image_qc_knn(images: DataFrame, metrics: Sequence[str], by: Sequence[str], image_id: str, k: int = 15, threshold: float = 3.5) -> DataFrame:
    """Mean distance to the k nearest images of the group in standardised space; fails by its lower-half robust z."""
    stats = images.groupBy(*by).agg(*[F.avg(m).alias(f"{m}__c") for m in metrics], *[F.stddev_pop(m).alias(f"{m}__s") for m in metrics])
    std = join_fit(images, stats, by)
    vector = F.array(*[F.coalesce(F.when(F.col(f"{m}__s") > 0, (F.col(m) - F.col(f"{m}__c")) / F.col(f"{m}__s")), F.lit(0.0)) for m in metrics])
    pts = std.select(*by, image_id, vector.alias("v"))
    near = neighbours(pts, image_id, "v", k, by).withColumnRenamed("id", image_id)
    score = near.groupBy(*by, image_id).agg(F.avg("d").alias("qc_image_score"))
    mid = score.groupBy(*by).agg(F.median("qc_image_score").alias("m"))
    low = join_fit(score, mid, by)
    half = low.where("qc_image_score <= m").groupBy(*by).agg(F.median(F.col("m") - F.col("qc_image_score")).alias("h"))
    out = join_fit(low, half, by)
    z = F.when(F.col("h") * MAD_SCALE > 0, (F.col("qc_image_score") - F.col("m")) / (F.col("h") * MAD_SCALE)).otherwise(0.0)
    return out.withColumn("qc_image_fail", z > threshold).drop("m", "h")


def filter_images(cells: DataFrame, images: DataFrame, image_id: str) -> DataFrame:
    """Drop the cells of failed images."""
    return cells.join(images.where("qc_image_fail").select(image_id).distinct(), image_id, "left_anti")


def well_qc(df: DataFrame, wells: Sequence[str], features: Sequence[str], control: Column | None = None, min_cells: int = 50, max_nan_fraction: float = 0.1) -> DataFrame:
    """Each well's cells, missing share and, for wells with controls, the median coefficient of variation of its features."""
    ids = [*wells, "__control"]
    long = to_long(df.withColumn("__control", control if control is not None else F.lit(False)), ids, features, keep_missing=True)
    each = long.groupBy(*wells, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("measured"), F.max("__control").alias("has_control"), F.abs(F.stddev_samp("value") / F.when(F.avg("value") != 0, F.avg("value"))).alias("cv")
    )
    out = each.groupBy(*wells).agg(
        F.max("n").alias("n_cells"), (1 - F.sum("measured") / F.sum("n")).alias("missing_fraction"), F.median(F.when(F.col("has_control") & (F.col("n") > 1), F.col("cv"))).alias("control_cv")
    )
    return out.withColumn("well_pass", (F.col("n_cells") >= min_cells) & (F.col("missing_fraction") <= max_nan_fraction))


# ---------------------------------------------------------------- outlier scores


def mad_scores(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """outlier_score: largest absolute robust z over the features."""
    z = join_fit(df, median_and_spread(df, by, features), by)
    score = F.greatest(*[F.abs(robust_z(F.col(f), F.col(f"{f}__c"), F.col(f"{f}__s"))) for f in features], F.lit(None).cast("double"))
    return z.withColumn("outlier_score", score).select(*df.columns, "outlier_score")


def ecod_scores(df: DataFrame, features: Sequence[str], row_id: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, row_id, outlier_score): empirical-tail outlier detection over the long form.

    Each feature gives L = -ln F(<= x) and R = -ln F(>= x); missing values take the column mean. The score sums the
    larger tail, or both where the feature has no skew.
    """
    long = to_long(df, [*by, row_id], features, keep_missing=True)
    mean = F.avg("value").over(Window.partitionBy(*by, "feature"))
    long = long.withColumn("value", F.coalesce("value", mean))
    part = Window.partitionBy(*by, "feature")
    left = -F.log(F.cume_dist().over(part.orderBy(F.col("value").asc())))
    right = -F.log(F.cume_dist().over(part.orderBy(F.col("value").desc())))
    tails = long.select(*by, row_id, "feature", left.alias("l"), right.alias("r"), F.skewness("value").over(part).alias("skew"))
    one = F.when(F.coalesce("skew", F.lit(0.0)) == 0, F.col("l") + F.col("r")).otherwise(F.greatest("l", "r"))
    return tails.groupBy(*by, row_id).agg(F.sum(one).alias("outlier_score"))


def neighbours(points: DataFrame, row_id: str, vector: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by…, id, o_id, d, r): the k nearest other rows of each row by Euclidean distance, ties by id."""
    return nearest_neighbours(points, row_id, vector, k, by, pivots=64 if by else None)


def lof_scores(points: DataFrame, row_id: str, vector: str, k: int = 20) -> DataFrame:
    """(id, outlier_score): local outlier factor from the k-nearest-neighbour table."""
    near = neighbours(points, row_id, vector, k)
    kdist = near.groupBy("id").agg(F.max("d").alias("kd"))
    reach = near.join(kdist.select(F.col("id").alias("o_id"), "kd"), "o_id").select("id", "o_id", F.greatest("d", "kd").alias("reach"))
    density = reach.groupBy("id").agg((1.0 / (F.avg("reach") + 1e-10)).alias("lrd"))
    out = near.select("id", "o_id").join(density.select(F.col("id").alias("o_id"), F.col("lrd").alias("o_lrd")), "o_id").join(density, "id")
    return out.groupBy("id").agg((F.avg("o_lrd") / F.first("lrd")).alias("outlier_score"))


def isolation_scores(df: DataFrame, features: Sequence[str], row_id: str, n_trees: int = 200, sample: int = 256, seed: int = 0) -> DataFrame:
    """(row_id, outlier_score): isolation forest grown on a bounded hash sample, applied to all rows in Arrow batches."""
    feats = list(features)
    top = df.select(row_id, *feats).orderBy(F.xxhash64(F.lit(seed), row_id), row_id).limit(n_trees * sample).toPandas()
    data = np.nan_to_num(top[feats].to_numpy(float))
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray, depth: int, limit: int):
        if depth >= limit or len(rows) <= 1 or not (rows.max(0) > rows.min(0)).any():
            return len(rows), depth
        j = rng.choice(np.flatnonzero(rows.max(0) > rows.min(0)))
        cut = rng.uniform(rows[:, j].min(), rows[:, j].max())
        return int(j), float(cut), grow(rows[rows[:, j] < cut], depth + 1, limit), grow(rows[rows[:, j] >= cut], depth + 1, limit)

    def harmonic_path(n: int) -> float:
        return 0.0 if n < 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n

    size = min(sample, len(data))
    limit = max(1, math.ceil(math.log2(max(2, size))))
    trees = [grow(data[rng.choice(len(data), size, replace=False)], 0, limit) for _ in range(n_trees)] if size else []
    norm = max(1e-12, harmonic_path(size))

    def paths(node, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if len(node) == 2:
            out[rows] += node[1] + harmonic_path(node[0])
            return
        left = x[rows, node[0]] < node[1]
        for child, part in ((node[2], rows[left]), (node[3], rows[~left])):
            if len(part):
                paths(child, x, part, out)

    def run(batches):
        for b in batches:
            x, out = np.nan_to_num(b[feats].to_numpy(float)), np.zeros(len(b))
            for t in trees:
                paths(t, x, np.arange(len(b)), out)
            yield pd.DataFrame({row_id: b[row_id], "outlier_score": 2.0 ** (-out / max(1, len(trees)) / norm)})

    return df.select(row_id, *feats).mapInPandas(run, f"{row_id} {dict(df.dtypes)[row_id]}, outlier_score double")


def flag_outliers(scores: DataFrame, row_id: str, by: Sequence[str] = (), contamination: float = 0.01, cutoff: float | None = None) -> DataFrame:
    """is_outlier: the top ceil(contamination n) by score (ties by row id), or all above the cutoff; NULL scores never."""
    if cutoff is not None:
        return scores.withColumn("is_outlier", F.coalesce(F.col("outlier_score") > cutoff, F.lit(False)))
    part = Window.partitionBy(*by)
    rank = F.row_number().over(part.orderBy(F.col("outlier_score").desc_nulls_last(), row_id))
    limit = F.ceil(F.count(F.lit(1)).over(part) * contamination)
    return scores.withColumn("is_outlier", F.col("outlier_score").isNotNull() & (rank <= limit))


def downsample(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int = 500, stratify: Sequence[str] = ()) -> DataFrame:
    """At most n rows of each group, the first by `order`; strata get max(1, round(n share)) each, then n in all."""
    part = Window.partitionBy(*by)
    if not stratify:
        return df.withColumn("__r", F.row_number().over(part.orderBy(*order))).where(F.col("__r") <= n).drop("__r")
    stratum = Window.partitionBy(*by, *stratify)
    share = F.count(F.lit(1)).over(stratum) / F.count(F.lit(1)).over(part)
    out = df.withColumn("__q", F.greatest(F.lit(1), F.round(share * n))).withColumn("__s", F.row_number().over(stratum.orderBy(*order)))
    small = F.count(F.lit(1)).over(part) <= n
    out = out.withColumn("__all", small).where((F.col("__s") <= F.col("__q")) | F.col("__all"))
    return out.withColumn("__r", F.row_number().over(part.orderBy("__s", *order))).where(F.col("__r") <= n).drop("__q", "__s", "__all", "__r")


def hash_order(row_id: str, seed: int = 0) -> Column:
    """A random but repeatable order for `downsample`."""
    return F.xxhash64(F.lit(seed), F.col(row_id))


__all__ = [n for n in dir() if not n.startswith("_")] + ["average_rank"]
