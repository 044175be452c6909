"""Grouped statistics, ranks and multiple testing as DataFrame operations.

Missing values are NULL; `clean` turns NaN into NULL at ingest. Infinite values are kept as measured extremes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826
#: A spread at or below this is no spread.
NO_SPREAD = 1e-18


def clean(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """NaN to NULL, features as double."""
    return df.withColumns({f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features})


def to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str], keep_missing: bool = False) -> DataFrame:
    """(ids…, feature, value): one row for each row and feature."""
    out = df.unpivot(list(ids), [F.col(f).cast("double").alias(f) for f in features], "feature", "value")
    return out if keep_missing else out.where("value is not null")


def to_packed(df: DataFrame, ids: Sequence[str], features: Sequence[str], name: str = "features") -> DataFrame:
    return df.select(*ids, F.array(*[F.col(f).cast("double") for f in features]).alias(name))


def assert_no_null_keys(df: DataFrame, keys: Sequence[str]) -> None:
    """A group key may not be missing."""
    if not df.where(" or ".join(f"`{k}` is null" for k in keys)).isEmpty():
        raise ValueError(f"NULL in the group keys {list(keys)}")


def statistic(name: str, x: Column, q: float = 0.5, ddof: int = 0) -> Column:
    """Aggregate expression of a named statistic; MAD needs two passes (see `grouped_mad`)."""
    return {
        "mean": lambda: F.avg(x),
        "median": lambda: F.median(x),
        "std": lambda: F.stddev_samp(x) if ddof else F.stddev_pop(x),
        "var": lambda: F.var_samp(x) if ddof else F.var_pop(x),
        "quantile": lambda: F.percentile(x, F.lit(q)),
        "iqr": lambda: F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25)),
        "count": lambda: F.count(x),
    }[name]()


def grouped_stat(df: DataFrame, by: Sequence[str], features: Sequence[str], stat: str, q: float = 0.5, ddof: int = 0) -> DataFrame:
    """One row for each group with the statistic of every feature, all in one aggregation."""
    if stat == "mad":
        return grouped_mad(df, by, features)
    if stat == "lower_median":
        return df.groupBy(*by).agg(*[F.expr(f"percentile_disc(0.5) within group (order by `{f}`)").alias(f) for f in features])
    return df.groupBy(*by).agg(*[statistic(stat, F.col(f), q, ddof).alias(f) for f in features])


def grouped_mad(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Unscaled median absolute deviation: medians, then medians of the distances to them."""
    med = df.groupBy(*by).agg(*[F.median(f).alias(f"{f}__m") for f in features])
    far = join_fit(df, med, by)
    return far.groupBy(*by).agg(*[F.median(F.abs(F.col(f) - F.col(f"{f}__m"))).alias(f) for f in features])


def join_fit(df: DataFrame, fit: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Attach a table of fitted values, one row for each group.

    The join is null-safe. No hint is given: adaptive execution broadcasts the fit if its measured size is below
    spark.sql.autoBroadcastJoinThreshold and shuffles otherwise.
    """
    if not by:
        return df.crossJoin(fit)  # a fit without keys is one row
    fit = fit.select(*[F.col(k).alias(f"__k_{k}") for k in by], *[c for c in fit.columns if c not in by])
    cond = None
    for k in by:
        c = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        cond = c if cond is None else cond & c
    return df.join(fit, cond, how).drop(*[f"__k_{k}" for k in by])


def median_and_spread(df: DataFrame, by: Sequence[str], features: Sequence[str], spread: str = "mad") -> DataFrame:
    """(by…, f__c, f__s): median with unscaled MAD, or with the interquartile range in one aggregation."""
    if spread == "iqr":
        q = df.groupBy(*by).agg(*[F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f) for f in features])
        return q.select(*by, *[F.col(f)[1].alias(f"{f}__c") for f in features], *[(F.col(f)[2] - F.col(f)[0]).alias(f"{f}__s") for f in features])
    med = df.groupBy(*by).agg(*[F.median(f).alias(f"{f}__c") for f in features])
    far = join_fit(df, med, by)
    out = far.groupBy(*by).agg(*[F.first(f"{f}__c").alias(f"{f}__c") for f in features], *[F.median(F.abs(F.col(f) - F.col(f"{f}__c"))).alias(f"{f}__s") for f in features])
    return out


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of the rows where both are known; NULL for fewer than two rows or where a side is constant.

    Built on moments, as the built-in `corr` divides by zero for a constant side in ANSI mode.
    """
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def robust_z(x: Column, center: Column, mad: Column) -> Column:
    """(x - median) / (1.4826 MAD); no spread gives 0."""
    return F.when(mad * MAD_SCALE <= NO_SPREAD, F.lit(0.0)).otherwise((x - center) / (mad * MAD_SCALE))


def average_rank(value: Column | str, by: Sequence[str | Column] = (), descending: bool = False) -> Column:
    """Rank from 1 with ties at their mean."""
    value = F.col(value) if isinstance(value, str) else value
    order = Window.partitionBy(*by).orderBy(value.desc() if descending else value.asc())
    ties = Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def benjamini_hochberg(df: DataFrame, p: str = "pvalue", by: Sequence[str] = (), out: str = "qvalue", tie: Sequence[str] = ()) -> DataFrame:
    """q of each p within its family; NULL p stays NULL and is not counted.

    Families named by keys are the partitions of one window. A whole table as one family goes through fixed buckets of
    p (`benjamini_hochberg_large`), so it is not one task.
    """
    if not by:
        return benjamini_hochberg_large(df, p, out, tie)
    family = Window.partitionBy(*by, F.col(p).isNull())
    up = family.orderBy(F.col(p).asc(), *tie)
    step = F.least(F.lit(1.0), F.col(p) * F.count(F.lit(1)).over(family) / F.row_number().over(up))
    ranked = df.withColumn("__step", step)
    down = family.orderBy(F.col(p).asc(), *tie).rowsBetween(0, Window.unboundedFollowing)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.min("__step").over(down))).drop("__step")


def permutation_pvalue(observed: Column, null: Column) -> Column:
    """(1 + nulls at least as large) / (1 + finite nulls) of an array of null draws."""
    finite = F.filter(null, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    hits = F.size(F.filter(finite, lambda v: v >= observed))
    return F.when(observed.isNotNull() & ~F.isnan(observed) & (F.size(finite) > 0), (hits + 1.0) / (F.size(finite) + 1.0))


def cumulative_counts(a: DataFrame, b: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, value, na, nb): rows of a and of b at or below each distinct value; a merge by window, not a range join."""
    both = a.select(*by, value, F.lit(1).alias("ia"), F.lit(0).alias("ib")).unionByName(b.select(*by, value, F.lit(0).alias("ia"), F.lit(1).alias("ib")))
    each = both.groupBy(*by, value).agg(F.sum("ia").alias("ia"), F.sum("ib").alias("ib"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return each.select(*by, value, F.sum("ia").over(upto).alias("na"), F.sum("ib").over(upto).alias("nb"))


def variance_by_feature(df: DataFrame, features: Sequence[str], ddof: int = 0) -> DataFrame:
    return to_long(df, [], features).groupBy("feature").agg(statistic("var", F.col("value"), ddof=ddof).alias("variance"))


def bucketed(df: DataFrame, value: str, buckets: int = 64, name: str = "__bucket") -> DataFrame:
    """A bucket of each row by approximate quantiles of the value: an ordered partition of one long list.

    Bucket borders are few numbers; equal values share a bucket, so orders within and between buckets agree with the
    order of all rows.
    """
    bounds = sorted(set(df.where(F.col(value).isNotNull()).approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    border = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter(border, lambda b: b < F.col(value)))))


def p_bucket(p: Column, buckets: int) -> Column:
    """Ordered bucket of a p-value: equal steps down to 1 / buckets, below that one for each halving."""
    small = -F.floor(-F.log2(F.greatest(p, F.lit(1e-300))))
    return F.when(p.isNotNull(), F.when(F.isnan(p), buckets + 1).when(p < 1.0 / buckets, small - 1).otherwise(F.floor(F.least(p, F.lit(1.0)) * buckets)))


def benjamini_hochberg_large(df: DataFrame, p: str = "pvalue", out: str = "qvalue", tie: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """The same for one family of any size: ranks and running minima within buckets of p, joined over the few buckets."""
    rows = df.withColumn("__bucket", p_bucket(F.col(p), buckets))
    local = Window.partitionBy("__bucket").orderBy(F.col(p).asc(), *tie)
    sizes = rows.where("__bucket is not null").groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.orderBy("__bucket")  # over the buckets only
    sizes = sizes.withColumns({"__before": F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n"), "__all": F.sum("__n").over(Window.partitionBy())})
    ranked = join_fit(rows, sizes, ["__bucket"])
    step = F.col(p) * F.col("__all") / (F.col("__before") + F.row_number().over(local))
    ranked = ranked.withColumn("__step", F.when(F.col("__bucket").isNotNull(), F.least(F.lit(1.0), step)))
    least = ranked.where("__bucket is not null").groupBy("__bucket").agg(F.min("__step").alias("__min"))
    least = least.withColumn("__later", F.min("__min").over(Window.orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1))).drop("__min")
    done = join_fit(ranked, least, ["__bucket"])
    own = F.min("__step").over(local.rowsBetween(0, Window.unboundedFollowing))
    q = F.when(F.col("__bucket").isNotNull(), F.least(own, F.coalesce("__later", F.lit(1.0))))
    return done.withColumn(out, q).drop("__bucket", "__n", "__before", "__all", "__step", "__later")


def running_total(df: DataFrame, value: str, totals: dict[str, Column], descending: bool = False, least: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """Rows of a known value with sums (of `least`: minima) over all rows at or before it in the order of the value.

    Ties count as before. Windows run within buckets of the value and once more over the few buckets, so the order of
    the whole table is never one task.
    """
    rows = bucketed(df.where(F.col(value).isNotNull()).withColumns({f"__x_{k}": x for k, x in totals.items()}), value, buckets)
    order, around = (F.col(value).desc(), F.col("__bucket").desc()) if descending else (F.col(value).asc(), F.col("__bucket").asc())
    local = Window.partitionBy("__bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(around).rowsBetween(Window.unboundedPreceding, -1)  # over the buckets only
    over = lambda k, x: (F.min if k in least else F.sum)(x)
    each = rows.groupBy("__bucket").agg(*[over(k, F.col(f"__x_{k}")).alias(f"__t_{k}") for k in totals])
    each = each.select("__bucket", *[over(k, F.col(f"__t_{k}")).over(before).alias(f"__b_{k}") for k in totals])
    joined = join_fit(rows.withColumns({f"__l_{k}": over(k, F.col(f"__x_{k}")).over(local) for k in totals}), each, ["__bucket"])
    whole = {k: F.least(f"__l_{k}", f"__b_{k}") if k in least else F.col(f"__l_{k}") + F.coalesce(f"__b_{k}", F.lit(0)) for k in totals}
    return joined.withColumns(whole).drop("__bucket", *[f"__{c}_{k}" for k in totals for c in "xlb"])
