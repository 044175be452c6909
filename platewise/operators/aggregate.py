"""Aggregation to wells and groups, replicate consensus, compositions and signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.special import col_f_sf
from platewise.operators.stats import average_rank, correlation, join_fit


def constant_columns(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Columns with one value in every group; NULL counts as a value."""
    if not columns:
        return []
    n = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns]
    most = df.groupBy(*by).agg(*n).agg(*[F.max(c).alias(c) for c in columns]).first()
    return [c for c in columns if (most[c] or 0) <= 1]


def aggregate(df: DataFrame, features: Sequence[str], by: Sequence[str] = ("Metadata_Plate", "Metadata_Well"), func: str = "median", min_cells: int = 10, carry: Sequence[str] = (), count: Column | None = None, site: Sequence[str] = ()) -> DataFrame:
    """One row for each group: medians or means, Metadata_CellCount and, with site columns, Metadata_SiteCount.

    The count is rows, or the sum of `count`; groups below min_cells go, groups of unknown count stay. `carry` holds
    columns that are constant in every group (see `constant_columns`).
    """
    stat = F.median if func == "median" else F.avg
    cells = F.count(F.lit(1)) if count is None else F.when(F.count(F.when(count.isNull(), 1)) == 0, F.sum(count))
    aggs = [cells.alias("Metadata_CellCount")]
    if site:
        aggs.append(F.count_distinct(F.struct(*site)).alias("Metadata_SiteCount"))
    out = df.groupBy(*by).agg(*[F.first(c).alias(c) for c in carry], *aggs, *[stat(f).alias(f) for f in features])
    return out.where(F.col("Metadata_CellCount").isNull() | (F.col("Metadata_CellCount") >= min_cells))


def resolution_of(by: Sequence[str]) -> str:
    return "well" if {"Metadata_Plate", "Metadata_Well"} <= set(by) else "aggregate"


def consensus_median(df: DataFrame, features: Sequence[str], by: Sequence[str], min_replicates: int = 2) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("Metadata_ReplicateCount"), *[F.median(f).alias(f) for f in features])
    return out.where(F.col("Metadata_ReplicateCount") >= min_replicates)


def array_ranks(v: Column) -> Column:
    """Average ranks of the elements of an array."""
    return F.transform(v, lambda x: F.size(F.filter(v, lambda y: y < x)) + (F.size(F.filter(v, lambda y: y == x)) + 1) / 2.0)


def array_corr(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of equal length."""
    n = F.size(a)

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    ma, mb = total(a) / n, total(b) / n
    ca, cb = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
    top = total(F.zip_with(ca, cb, lambda x, y: x * y))
    low = F.sqrt(total(F.transform(ca, lambda x: x * x)) * total(F.transform(cb, lambda x: x * x)))
    return top / F.when(low > 0, low)


def consensus_modz(df: DataFrame, features: Sequence[str], by: str, row_id: str, method: str = "spearman", min_replicates: int = 2, min_weight: float = 0.01, precision: int = 4) -> DataFrame:
    """Weighted mean of replicates: weight = mean correlation with the others, floored, normalised and rounded."""
    vec = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(by, row_id, vec.alias("__v"))
    rows = rows.withColumn("__k", array_ranks(F.col("__v")) if method == "spearman" else F.col("__v"))
    other = rows.select(F.col(by).alias("__g"), F.col(row_id).alias("__o"), F.col("__k").alias("__w"))
    pairs = rows.join(other, (F.col(by) == F.col("__g")) & (F.col(row_id) != F.col("__o")))
    raw = pairs.groupBy(by, row_id).agg(F.avg(F.greatest(F.lit(0.0), F.coalesce(array_corr(F.col("__k"), F.col("__w")), F.lit(0.0)))).alias("raw"))
    weighed = rows.join(raw, [by, row_id], "left").withColumn("raw", F.greatest(F.lit(min_weight), F.coalesce("raw", F.lit(1.0))))
    part = Window.partitionBy(by)
    weighed = weighed.withColumn("weight", F.round(F.col("raw") / F.sum("raw").over(part), precision))
    out = weighed.groupBy(by).agg(F.count(F.lit(1)).alias("Metadata_ReplicateCount"), *[F.sum(F.col("weight") * F.col("__v")[i]).alias(f) for i, f in enumerate(features)])
    return out.where(F.col("Metadata_ReplicateCount") >= min_replicates)


def viability(counts: DataFrame, count: str, control: Column, by: Sequence[str] = (), sites: str | None = None) -> DataFrame:
    """viability: cells (for each site) over the median of the controls, of the level where `by` names one."""
    tally = F.col(count) / F.greatest(F.col(sites), F.lit(1)) if sites else F.col(count).cast("double")
    rows = counts.withColumn("__t", tally)
    base = rows.where(control).groupBy(*by).agg(F.median("__t").alias("__b"))
    return join_fit(rows, base, by).withColumn("viability", F.col("__t") / F.when(F.col("__b") > 0, F.col("__b"))).drop("__t", "__b")


def cluster_composition(df: DataFrame, cluster: str, by: Sequence[str]) -> DataFrame:
    """(by…, cluster, n, fraction) with a row for every group and cluster; absent clusters are 0."""
    rows = df.where(F.col(cluster).isNotNull())
    counts = rows.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"))
    grid = rows.select(*by).distinct().crossJoin(rows.select(cluster).distinct())
    full = grid.join(counts, [*by, cluster], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def composition_test(comp: DataFrame, cluster: str, by: Sequence[str], control: Column, p_values: bool = True) -> DataFrame:
    """(by…, chi2, dof, dispersion[, f, pvalue]): chi-square of each group against the pooled control share.

    The dispersion is the mean of the controls' own chi-square by degrees of freedom, each against the other controls,
    at least 1; the quasi-likelihood F divides by it.
    """
    ctl = comp.where(control)
    shares = ctl.groupBy(cluster).agg(F.sum("n").alias("cn"))
    shares = shares.withColumn("share", F.col("cn") / F.sum("cn").over(Window.partitionBy()))
    total = F.sum("n").over(Window.partitionBy(*by))
    rows = comp.withColumn("__total", total).join(shares, cluster, "left")
    expected = F.col("__total") * F.col("share")
    stat = rows.groupBy(*by).agg(F.sum(F.when(expected > 0, (F.col("n") - expected) * (F.col("n") - expected) / expected)).alias("chi2"), (F.count(F.when(F.col("share") > 0, 1)) - 1).alias("dof"))
    own = rows.where(control).withColumn("rest", F.col("cn") - F.col("n"))
    own = own.withColumn("rest_share", F.col("rest") / F.sum("rest").over(Window.partitionBy(*by)))
    e = F.col("__total") * F.col("rest_share")
    loo = own.groupBy(*by).agg(F.sum(F.when(e > 0, (F.col("n") - e) * (F.col("n") - e) / e)).alias("c"), (F.count(F.when(F.col("rest_share") > 0, 1)) - 1).alias("k"))
    disp = loo.agg(F.greatest(F.lit(1.0), F.coalesce(F.avg(F.col("c") / F.when(F.col("k") > 0, F.col("k"))), F.lit(1.0))).alias("dispersion"), F.sum("k").alias("den"))
    out = stat.crossJoin(disp).withColumn("f", F.col("chi2") / F.when(F.col("dof") > 0, F.col("dof")) / F.col("dispersion"))
    return out.withColumn("pvalue", col_f_sf("f", "dof", "den")).drop("den") if p_values else out.drop("den")


def feature_signature(effects: DataFrame, families: DataFrame, group: str = "group", value: str = "effect", family: str = "family", levels: Sequence[str] | None = None) -> DataFrame:
    """Groups by feature families: mean of the statistic; a family with a missing part is `none`."""
    named = effects.join(families.select("feature", F.coalesce(family, F.lit("none")).alias("__family")), "feature")
    wide = named.groupBy(group)
    wide = wide.pivot("__family", list(levels)) if levels else wide.pivot("__family")
    return wide.agg(F.avg(value))


def spearman_within(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """(by…, rho, n): correlation of average ranks of complete rows."""
    rows = df.where(f"{x} is not null and {y} is not null")
    ranked = rows.select(*by, average_rank(x, list(by)).alias("rx"), average_rank(y, list(by)).alias("ry"))
    return ranked.groupBy(*by).agg(correlation("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))
