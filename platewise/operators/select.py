"""Feature selection: each operation answers with the features it keeps; pairs come from one aggregation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.special import col_chi2_sf
from platewise.functions.wells import parse_feature_name
from platewise.operators.gram import pairwise_correlations
from platewise.operators.qc import feature_metrics
from platewise.operators.quantiles import sum_before
from platewise.operators.stats import average_rank, benjamini_hochberg, correlation, to_long

DEFAULT_OPERATIONS = ("drop_degenerate", "blocklist", "drop_na_columns", "variance_threshold", "correlation_threshold")


def variance_threshold(df: DataFrame, features: Sequence[str], min_variance: float = 1e-6) -> DataFrame:
    """(feature, variance, keep): population variance above the limit; an undefined one is 0."""
    v = feature_metrics(df, features).select("feature", "variance")
    usable = F.when(F.col("variance").isNull() | F.isnan("variance") | (F.col("variance") == float("inf")), 0.0).otherwise(F.col("variance"))
    return v.withColumn("variance", usable).withColumn("keep", F.col("variance") > min_variance)


def frequency_threshold(df: DataFrame, features: Sequence[str], row_id: str, freq_cut: float = 0.05, unique_cut: float = 0.01) -> DataFrame:
    """(feature, ratio, unique_ratio, keep): the second most common value against the first, distinct values against rows."""
    n = df.count()
    counts = to_long(df, [row_id], features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("r", F.row_number().over(order))
    out = ranked.groupBy("feature").agg(F.sum(F.when(F.col("r") == 1, F.col("n"))).alias("first"), F.sum(F.when(F.col("r") == 2, F.col("n"))).alias("second"), F.count(F.lit(1)).alias("distinct"))
    out = out.select("feature", (F.coalesce("second", F.lit(0)) / F.col("first")).alias("ratio"), (F.col("distinct") / float(max(n, 1))).alias("unique_ratio"))
    return out.withColumn("keep", ~((F.col("ratio") < freq_cut) | (F.col("unique_ratio") < unique_cut)))


def drop_na_columns(df: DataFrame, features: Sequence[str], cutoff: float = 0.05) -> DataFrame:
    n = df.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in features])
    return n.unpivot([], list(features), "feature", "missing").withColumn("keep", F.coalesce("missing", F.lit(0.0)) <= cutoff)


def drop_outliers(df: DataFrame, features: Sequence[str], cutoff: float = 500.0) -> DataFrame:
    m = df.agg(*[F.max(F.abs(f)).alias(f) for f in features])
    return m.unpivot([], list(features), "feature", "largest").withColumn("keep", F.coalesce("largest", F.lit(0.0)) <= cutoff)


def noise_removal(df: DataFrame, features: Sequence[str], by: Sequence[str], cutoff: float = 0.8, mode: str = "absolute", quantile: float = 0.95) -> DataFrame:
    """(feature, noise, keep): mean population sd within groups; absolute, as a share of the total sd, or by quantile."""
    within = df.groupBy(*by).agg(*[F.stddev_pop(f).alias(f) for f in features]).agg(*[F.avg(f).alias(f) for f in features])
    noise = within.unpivot([], list(features), "feature", "noise")
    if mode == "ratio":
        total = df.agg(*[F.stddev_pop(f).alias(f) for f in features]).unpivot([], list(features), "feature", "total")
        noise = noise.join(total, "feature").select("feature", (F.col("noise") / F.when(F.col("total") > 0, F.col("total"))).alias("noise"))
    if mode == "quantile":
        cutoff = noise.agg(F.percentile("noise", F.lit(quantile))).first()[0]
    return noise.withColumn("keep", F.coalesce("noise", F.lit(0.0)) <= cutoff)


def read_blocklist(spark, path: str) -> list[str]:
    """Names of a text file, one on each line; # begins a comment."""
    rows = spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("n")).where("n <> ''")
    return [r["n"] for r in rows.collect()]


def without_blocklisted(features: Sequence[str], blocklist: Sequence[str]) -> list[str]:
    """Features that are not listed by name, nor by what they measure under another object."""

    def identity(name: str) -> tuple:
        f = parse_feature_name(name)
        return (f.feature_group, f.measure, f.channel, f.scale, f.angle, f.gray_levels, f.radial_bin) if f.feature_group else (name,)

    listed = {identity(n) for n in blocklist}
    return [f for f in features if f not in set(blocklist) and identity(f) not in listed]


# ---------------------------------------------------------------- correlation


def correlated_pairs(df: DataFrame, features: Sequence[str], method: str = "pearson") -> DataFrame:
    """(feature_a, feature_b, r) of all pairs, pairwise complete, from one scan whatever the number of features.

    Spearman ranks every feature once, over the rows that know it.
    """
    feats = list(features)
    if method == "spearman":
        df = df.select(*[F.when(F.col(f).isNotNull(), average_rank(F.col(f), [F.col(f).isNull()])).alias(f) for f in feats])
    return pairwise_correlations(df, feats).select("feature_a", "feature_b", "r")


def correlation_threshold(df: DataFrame, features: Sequence[str], threshold: float = 0.9, method: str = "pearson", absolute: bool = False) -> DataFrame:
    """(feature, total, keep): of each pair above the threshold the one with the larger total |r| goes, the later on ties."""
    feats = list(features)
    pairs = correlated_pairs(df, feats, method)
    order = df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(feats)], "feature string, place int")
    both = pairs.select(F.col("feature_a").alias("feature"), "r").unionByName(pairs.select(F.col("feature_b").alias("feature"), "r"))
    total = both.groupBy("feature").agg((1.0 + F.sum(F.abs(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))))).alias("total"))
    total = order.join(total, "feature", "left").select("feature", "place", F.coalesce("total", F.lit(1.0)).alias("total"))
    r = F.abs("r") if absolute else F.col("r")
    high = pairs.where(r > threshold)
    a = total.select(F.col("feature").alias("feature_a"), F.col("total").alias("ta"), F.col("place").alias("pa"))
    b = total.select(F.col("feature").alias("feature_b"), F.col("total").alias("tb"), F.col("place").alias("pb"))
    worse = F.when((F.col("ta") > F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("pa") > F.col("pb"))), F.col("feature_a")).otherwise(F.col("feature_b"))
    gone = high.join(a, "feature_a").join(b, "feature_b").select(worse.alias("feature")).distinct().withColumn("gone", F.lit(True))
    return total.join(gone, "feature", "left").select("feature", "total", F.col("gone").isNull().alias("keep"))


def correlation_iterative(pairs: Sequence[tuple[str, str, float]], features: Sequence[str], threshold: float = 0.9) -> list[str]:
    """Features left after dropping the one in most high pairs again and again; ties by total |r|, then the first."""
    feats = list(features)
    at = {f: i for i, f in enumerate(feats)}
    total = np.ones(len(feats))
    linked: list[set[int]] = [set() for _ in feats]
    for a, b, r in pairs:
        r = 0.0 if r is None or math.isnan(r) else r
        total[at[a]] += abs(r)
        total[at[b]] += abs(r)
        if r > threshold:
            linked[at[a]].add(at[b])
            linked[at[b]].add(at[a])
    left = set(range(len(feats)))
    while True:
        degree = {i: len(linked[i] & left) for i in left}
        if not degree or max(degree.values()) == 0:
            return [feats[i] for i in sorted(left)]
        left.remove(min((i for i in left if degree[i] == max(degree.values())), key=lambda i: (-total[i], i)))


def correlation_window(df: DataFrame, features: Sequence[str], threshold: float = 0.9, window: int = 200, stride: int = 100) -> list[str]:
    """Correlate inside sliding windows of name-sorted features, then once among the survivors."""
    names = sorted(features)
    keep = set(names)
    for i in range(0, max(1, len(names) - window + stride), stride):
        part = [f for f in names[i : i + window] if f in keep]
        if len(part) > 1:
            keep -= {r["feature"] for r in correlation_threshold(df, part, threshold).where("not keep").collect()}
    rest = [f for f in features if f in keep]
    if len(rest) < 2:
        return rest
    gone = {r["feature"] for r in correlation_threshold(df, rest, threshold).where("not keep").collect()}
    return [f for f in rest if f not in gone]


def gram_matrix(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(sums of products, sums, rows) of complete rows: one distributed pass, features x features to the driver."""
    feats = list(features)
    k = len(feats)
    complete = df.select(*[F.col(f).cast("double").alias(f) for f in feats]).dropna()

    def run(batches):
        import pandas as pd

        total, sums, n = np.zeros((k, k)), np.zeros(k), 0
        for b in batches:
            x = b.to_numpy(float)
            total += x.T @ x
            sums += x.sum(0)
            n += len(x)
        yield pd.DataFrame({"g": [total.ravel().tolist()], "s": [sums.tolist()], "n": [n]})

    parts = complete.mapInPandas(run, "g array<double>, s array<double>, n long")
    size = k * k
    total = parts.agg(F.array(*[F.sum(F.col("s")[i]) for i in range(k)]).alias("s"), F.sum("n").alias("n")).first()
    cells = parts.select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    g = np.zeros(size)
    for r in cells:
        g[r["pos"]] = r["v"]
    return g.reshape(k, k), np.array([x or 0.0 for x in total["s"]]), int(total["n"] or 0)


def decorrelate(df: DataFrame, features: Sequence[str], threshold: float = 0.99) -> list[str]:
    """Pivoted Gram-Schmidt on unit-norm centred columns: keep those with a residual above sqrt(1 - t^2)."""
    feats = list(features)
    g, s, n = gram_matrix(df, feats)
    cov = g - np.outer(s, s) / max(n, 1)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    live = [i for i in range(len(feats)) if sd[i] > 1e-12 * max(1.0, abs(s[i]))]
    r = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
    limit, kept = math.sqrt(max(0.0, 1.0 - threshold**2)), []
    residual = np.ones(len(live))
    q = np.zeros((len(live), 0))
    while residual.size and residual.max() > limit**2:
        p = int(residual.argmax())
        kept.append(live[p])
        new = (r[:, p] - q @ q[p]) / math.sqrt(residual[p])
        q = np.column_stack([q, new])
        residual = np.where(np.isin(np.arange(len(live)), [live.index(x) for x in kept]), -1.0, residual - new**2)
    return [feats[i] for i in sorted(kept)]


def feature_select(df: DataFrame, features: Sequence[str], row_id: str, operations: Sequence[str] = DEFAULT_OPERATIONS, degenerate: Sequence[str] = (), blocklist: Sequence[str] = (), by: Sequence[str] = (), **options) -> DataFrame:
    """(feature, place, removed_by, selected): operations in order, each judging what earlier ones kept."""
    feats, removed = list(features), {}
    steps: dict[str, Callable[[list[str]], set[str]]] = {
        "drop_degenerate": lambda left: set(degenerate) & set(left),
        "blocklist": lambda left: set(left) - set(without_blocklisted(left, blocklist)),
        "drop_na_columns": lambda left: _gone(drop_na_columns(df, left, options.get("na_cutoff", 0.05))),
        "variance_threshold": lambda left: _gone(variance_threshold(df, left, options.get("min_variance", 1e-6))),
        "frequency_threshold": lambda left: _gone(frequency_threshold(df, left, row_id, options.get("freq_cut", 0.05), options.get("unique_cut", 0.01))),
        "correlation_threshold": lambda left: _gone(correlation_threshold(df, left, options.get("corr_threshold", 0.9), options.get("corr_method", "pearson"))) if len(left) > 1 else set(),
        "drop_outliers": lambda left: _gone(drop_outliers(df, left, options.get("outlier_cutoff", 500.0))),
        "noise_removal": lambda left: _gone(noise_removal(df, left, by, options.get("noise_cutoff", 0.8))),
        "decorrelate": lambda left: set(left) - set(decorrelate(df, left, options.get("decorr_threshold", 0.99))),
    }
    for op in operations:
        left = [f for f in feats if f not in removed]
        if left:
            removed |= {f: op for f in steps[op](left)}
    rows = [(f, i, removed.get(f), f not in removed) for i, f in enumerate(feats)]
    return df.sparkSession.createDataFrame(rows, "feature string, place int, removed_by string, selected boolean")


def _gone(judged: DataFrame) -> set[str]:
    return {r["feature"] for r in judged.where("not keep").select("feature").collect()}


def subset_features(df: DataFrame, selected: DataFrame, metadata: Sequence[str]) -> DataFrame:
    keep = [r["feature"] for r in selected.where("selected").orderBy("place").select("feature").collect()]
    return df.select(*metadata, *keep)


def decorr_threshold_sweep(df: DataFrame, features: Sequence[str], thresholds: Sequence[float], scorers: dict[str, Callable[[list[str]], float]]) -> DataFrame:
    """(threshold, n_kept, one column for each scorer of the kept features)."""
    rows = []
    for t in thresholds:
        kept = decorrelate(df, features, t)
        rows.append((float(t), len(kept), *[float(s(kept)) for s in scorers.values()]))
    return df.sparkSession.createDataFrame(rows, "threshold double, n_kept int" + "".join(f", {k} double" for k in scorers))


# ---------------------------------------------------------------- association with groups


def chatterjee_xi(df: DataFrame, x: str, y: str, row_id: str) -> DataFrame:
    """(xi, n): Chatterjee's coefficient of y on x over complete rows; ties of x by row id, tie-aware in y."""
    rows = df.where(f"{x} is not null and {y} is not null").select(row_id, x, y)
    every = Window.partitionBy()
    ranked = rows.select(row_id, x, F.row_number().over(Window.orderBy(x, row_id)).alias("o"), (F.cume_dist().over(Window.orderBy(y)) * F.count(F.lit(1)).over(every)).alias("r"), (F.cume_dist().over(Window.orderBy(F.desc(y))) * F.count(F.lit(1)).over(every)).alias("l"))
    step = ranked.withColumn("d", F.abs(F.lead("r").over(Window.orderBy("o")) - F.col("r")))
    out = step.agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"), F.sum("l").alias("sl"), F.sum(F.col("l") * F.col("l")).alias("sll"))
    return out.select((1.0 - F.col("n") * F.col("d") / (2.0 * (F.col("n") * F.col("sl") - F.col("sll")))).alias("xi"), "n")


def grouped_xi(df: DataFrame, group: str, features: Sequence[str], row_id: str, m: int = 1) -> DataFrame:
    """(feature, n, xi): dependence of each feature on a group label with m right neighbours.

    xi = -2 + (3 n m - S scaled) / (n m + m (m + 1) / 4) of the published revision: rows in order of the group (ties
    by row id), each compared with its next m rows by the smaller rank.
    """
    long = to_long(df, [row_id, group], features)
    by = Window.partitionBy("feature")
    ranks = long.withColumn("r", average_rank("value", ["feature"])).withColumn("o", F.row_number().over(by.orderBy(group, row_id))).withColumn("n", F.count(F.lit(1)).over(by))
    least = F.lit(0.0)
    for j in range(1, m + 1):
        least = least + F.coalesce(F.least("r", F.lead("r", j).over(by.orderBy("o"))), F.col("r"))
    out = ranks.withColumn("s", least).groupBy("feature").agg(F.max("n").alias("n"), F.sum("s").alias("s"))
    n = F.col("n")
    return out.select("feature", "n", (-2.0 + 6.0 * F.col("s") / ((n + 1.0) * (n * m + m * (m + 1) / 4.0))).alias("xi"))


def icc(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(feature, icc, keep at .2): one-way intraclass correlation of finite values, in [-1, 1], 0 if undefined."""
    long = to_long(df, by, features).where(F.abs("value") != float("inf"))
    each = long.groupBy("feature", *by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    t = each.groupBy("feature").agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"),
    )
    msb = (F.col("ss") - F.col("s") * F.col("s") / F.col("N")) / F.when(F.col("g") > 1, F.col("g") - 1)
    msw = F.col("ssw") / F.when(F.col("N") > F.col("g"), F.col("N") - F.col("g"))
    k0 = (F.col("N") - F.col("nn") / F.col("N")) / F.when(F.col("g") > 1, F.col("g") - 1)
    bottom = msb + (k0 - 1.0) * msw
    value = F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (msb - msw) / F.when(bottom != 0, bottom))), F.lit(0.0))
    return t.select("feature", value.alias("icc"))


def kruskal(df: DataFrame, features: Sequence[str], group: str, p_values: bool = True) -> DataFrame:
    """(feature, h, df[, pvalue, qvalue]): tie-corrected Kruskal-Wallis of each feature over the groups."""
    long = to_long(df, [group], features)
    cells = long.groupBy("feature", "value", group).agg(F.count(F.lit(1)).alias("c"))
    values = sum_before(cells.groupBy("feature", "value").agg(F.sum("c").alias("ties")), ["feature"], "value", "ties", "before")
    size = F.col("ties").cast("double")
    tie = values.groupBy("feature").agg(F.sum(size * (size * size - 1.0)).alias("t"), F.sum("ties").alias("n"))
    ranked = cells.join(values, ["feature", "value"]).withColumn("r", F.col("before") + (F.col("ties") + 1) / 2.0)
    each = ranked.groupBy("feature", group).agg(F.sum(F.col("r") * F.col("c")).alias("s"), F.sum("c").alias("k"))
    total = each.groupBy("feature").agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("ss"), (F.count(F.lit(1)) - 1).alias("df"))
    n = F.col("n").cast("double")
    raw = 12.0 / (n * (n + 1)) * F.col("ss") - 3.0 * (n + 1)
    scale = 1.0 - F.col("t") / (n * n * n - n)
    out = total.join(tie, "feature").select("feature", (raw / F.when(scale != 0, scale)).alias("h"), "df")
    if not p_values:
        return out
    return benjamini_hochberg(out.withColumn("pvalue", col_chi2_sf("h", "df")), tie=["feature"])
