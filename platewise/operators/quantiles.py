"""Exact order statistics of groups of any size.

Spark's percentile keeps every distinct value of a group in one buffer. Here a group is narrowed by histograms: one
aggregation counts its values in buckets, a second counts the values of the buckets that hold a wanted rank in finer ones, and
only the values of those are counted one by one. Every step is a count that combines before the shuffle, so no task sees more
of a group than a few thousand buckets, and the last step sorts what is left of a bucket of a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.stats import join_fit, to_long

#: Buckets of a step.
BUCKETS = 1024
_EDGE = 1.7e308


def _scaled(x: Column) -> Column:
    """A monotone scale on which huge values do not leave everything else in one bucket."""
    return F.asinh(F.greatest(F.least(x, F.lit(_EDGE)), F.lit(-_EDGE)))


def _bucket(x: Column, lo: Column, hi: Column, buckets: int) -> Column:
    share = F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return F.least(F.lit(buckets - 1), F.floor(share * buckets)).cast("int")


def _wanted(counts: DataFrame, keys: Sequence[str], order: Sequence[str], ranks: DataFrame) -> DataFrame:
    """Of counted buckets (or values) those that hold a wanted rank, with the number of values before them."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("__before", F.sum("c").over(upto) - F.col("c"))
    joined = join_fit(placed, ranks, keys, "inner")
    return joined.where(F.exists("ranks", lambda k: (k >= F.col("__before")) & (k < F.col("__before") + F.col("c"))))


def order_statistics(long: DataFrame, by: Sequence[str], value: str, ranks: Column, buckets: int = BUCKETS) -> DataFrame:
    """(by…, n, rank, value): the values of the wanted ranks (from 0) of each group.

    long: one value a row, without NULL and NaN. ranks: an array of ranks as an expression of the group's size `n`.
    """
    keys, rows = list(by), long.select(*by, F.col(value).cast("double").alias("x"))
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("n > 0")
    want = whole.select(*keys, "n", F.array_distinct(ranks).alias("ranks"))
    # coarse buckets on the monotone scale
    first = join_fit(rows, whole.drop("n"), keys, "inner").select(*keys, "x", _bucket(_scaled(F.col("x")), _scaled(F.col("lo")), _scaled(F.col("hi")), buckets).alias("b"))
    counts = first.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    coarse = _wanted(counts, keys, ["b"], want)
    # fine buckets within them; the intervals of a group are disjoint
    inside = coarse.groupBy(*keys).agg(F.collect_list(F.struct("b", "lo", "hi", "__before")).alias("parts"))

    def within(parts: DataFrame) -> DataFrame:
        held = join_fit(rows, parts, keys, "inner")
        return held.select(*keys, "x", F.explode(F.filter("parts", lambda p: (F.col("x") >= p["lo"]) & (F.col("x") <= p["hi"]))).alias("p"))

    fine = within(inside).select(*keys, "x", F.col("p")["b"].alias("b"), F.col("p")["__before"].alias("start"), _bucket(F.col("x"), F.col("p")["lo"], F.col("p")["hi"], buckets).alias("b2"))
    counts = fine.groupBy(*keys, "b", "start", "b2").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    upto = Window.partitionBy(*keys, "b").orderBy("b2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("__before", F.col("start") + F.sum("c").over(upto) - F.col("c")).drop("start")
    holds = F.exists("ranks", lambda k: (k >= F.col("__before")) & (k < F.col("__before") + F.col("c")))
    narrow = join_fit(counts, want, keys, "inner").where(holds)
    inside = narrow.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "__before")).alias("parts"))
    # what is left, one value at a time
    each = within(inside).groupBy(*keys, F.col("p")["lo"].alias("lo"), F.col("p")["__before"].alias("start"), "x").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys, "lo").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("__before", F.col("start") + F.sum("c").over(upto) - F.col("c"))
    found = join_fit(each, want, keys, "inner")
    found = found.withColumn("rank", F.explode(F.filter("ranks", lambda k: (k >= F.col("__before")) & (k < F.col("__before") + F.col("c")))))
    return found.select(*keys, "n", "rank", F.col("x").alias("value"))


def sum_before(df: DataFrame, by: Sequence[str], value: str, amount: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows with the sum of `amount` over their group's rows of smaller value; values of a group are distinct.

    Windows run within monotone buckets of the values and over the few buckets, so a group is never one task.
    """
    keys = list(by)
    ends = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    rows = join_fit(df, ends, keys).withColumn("__b", _bucket(_scaled(F.col(value)), _scaled(F.col("__lo")), _scaled(F.col("__hi")), buckets)).drop("__lo", "__hi")
    each = rows.groupBy(*keys, "__b").agg(F.sum(amount).alias("__t"))
    each = each.withColumn("__start", F.sum("__t").over(Window.partitionBy(*keys).orderBy("__b")) - F.col("__t")).drop("__t")  # over the buckets only
    local = F.sum(amount).over(Window.partitionBy(*keys, "__b").orderBy(value)) - F.col(amount)
    return join_fit(rows.withColumn("__local", local), each, [*keys, "__b"]).withColumn(name, F.col("__start") + F.col("__local")).drop("__b", "__local", "__start")


def large_quantiles(df: DataFrame, by: Sequence[str], features: Sequence[str], q: Sequence[float], lower: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """(by…, feature, n, q0, q1, …): exact quantiles of every feature, interpolated between neighbours as `percentile` does, or
    (lower) the value of rank ceil(n q) - 1 as `percentile_disc` does. Missing values and NaN are left out."""
    long = to_long(df, list(by), features).where(~F.isnan("value"))
    keys = [*by, "feature"]
    place = [F.greatest(F.ceil(F.col("n") * p) - 1, F.lit(0)).cast("double") if lower else (F.col("n") - 1) * F.lit(float(p)) for p in q]
    ranks = F.flatten(F.array(*[F.array(F.floor(p).cast("long"), F.ceil(p).cast("long")) for p in place]))
    found = order_statistics(long, keys, "value", ranks, buckets).groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    out = []
    for i, p in enumerate(place):
        low, high = F.col("at")[F.floor(p).cast("long")], F.col("at")[F.ceil(p).cast("long")]
        share = p - F.floor(p)
        out.append(F.when(low == high, low).otherwise(low * (1.0 - share) + high * share).alias(f"q{i}"))
    return found.select(*keys, "n", *out)


def large_median_and_mad(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(by…, feature, center, spread): median and unscaled median absolute deviation of groups of any size."""
    center = large_quantiles(df, by, features, [0.5]).select(*by, "feature", F.col("q0").alias("center"))
    long = to_long(df, list(by), features).where(~F.isnan("value"))
    far = join_fit(long, center, [*by, "feature"]).select(*by, "feature", F.abs(F.col("value") - F.col("center")).alias("far"))
    wide = order_statistics(far.where("far is not null and not isnan(far)"), [*by, "feature"], "far", F.array(F.floor((F.col("n") - 1) / 2).cast("long"), F.ceil((F.col("n") - 1) / 2).cast("long")))
    spread = wide.groupBy(*by, "feature").agg(F.avg("value").alias("spread"))
    return join_fit(center, spread, [*by, "feature"])
