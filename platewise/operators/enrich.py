"""Enrichment of feature and gene sets, cell populations, DNA content and clustering."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import special as S
from platewise.operators.stats import average_rank, benjamini_hochberg, cumulative_counts, join_fit


def feature_sets(families: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(source, target, weight): `a|b` of each feature's family columns; rows with a missing part are left out."""
    rows = families.where(" and ".join(f"`{c}` is not null" for c in columns))
    return rows.select(F.concat_ws("|", *columns).alias("source"), F.col("feature").alias("target"), F.lit(1.0).alias("weight"))


def read_gmt(spark, path: str) -> DataFrame:
    """Gene sets of a GMT file: name, description, genes, tab-separated."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p")).where("size(p) > 2")
    return lines.select(F.col("p")[0].alias("source"), F.explode(F.slice("p", 3, 1_000_000)).alias("target"), F.lit(1.0).alias("weight")).where("target <> ''")


def ulm(long: DataFrame, net: DataFrame, row: str, p_values: bool = True, tmin: int = 5) -> DataFrame:
    """(row, source, score[, pvalue, padj]): t of the slope of a row's values on the set's weights, absent targets 0.

    long: (row, feature, value). Closed-form sums, so a set costs its members only.
    """
    total = long.groupBy(row).agg(F.count("value").alias("n"), F.sum("value").alias("sy"), F.sum(F.col("value") * F.col("value")).alias("syy"))
    known = long.select("feature").distinct()
    net = net.join(known, net["target"] == known["feature"], "left_semi")
    sets = net.groupBy("source").agg(F.count(F.lit(1)).alias("k"), F.sum("weight").alias("sx"), F.sum(F.col("weight") * F.col("weight")).alias("sxx")).where(F.col("k") >= tmin)
    hit = long.join(net, F.col("feature") == F.col("target")).groupBy(row, "source").agg(F.sum(F.col("weight") * F.col("value")).alias("sxy"))
    j = hit.join(sets, "source").join(total, row)
    n = F.col("n").cast("double")
    sxx, syy, sxy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n, F.col("sxy") - F.col("sx") * F.col("sy") / n
    r = sxy / F.sqrt(F.when(sxx * syy > 0, sxx * syy))
    t = r * F.sqrt((n - 2) / F.when((F.abs(r) < 1) & (n > 2), 1.0 - r * r))
    out = j.select(row, "source", t.alias("score"), (n - 2).alias("__df"))
    if not p_values:
        return out.drop("__df")
    return benjamini_hochberg(out.withColumn("pvalue", S.col_t_sf2("score", "__df")), by=[row], out="padj", tie=["source"]).drop("__df")


def zscore(long: DataFrame, net: DataFrame, row: str, tmin: int = 5) -> DataFrame:
    """(row, source, score): (mean of the set - mean of the row) * sqrt(k) / sd of the row."""
    total = long.groupBy(row).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    hit = long.join(net, F.col("feature") == F.col("target")).groupBy(row, "source").agg(F.avg("value").alias("sm"), F.count(F.lit(1)).alias("k")).where(F.col("k") >= tmin)
    return hit.join(total, row).select(row, "source", ((F.col("sm") - F.col("m")) * F.sqrt(F.col("k").cast("double")) / F.when(F.col("s") > 0, F.col("s"))).alias("score"))


def _top(long: DataFrame, row: str, fraction: float) -> DataFrame:
    part = Window.partitionBy(row)
    rank = F.row_number().over(part.orderBy(F.desc("value"), "feature"))
    return long.withColumns({"r": rank, "n": F.count(F.lit(1)).over(part)}).withColumn("top", F.greatest(F.lit(1), F.round(F.col("n") * fraction)).cast("int"))


def ora_rows(long: DataFrame, net: DataFrame, row: str, fraction: float = 0.05, tmin: int = 5, p_values: bool = True) -> DataFrame:
    """(row, source, overlap, size, top, n[, pvalue, padj]): sets among each row's top features."""
    ranked = _top(long, row, fraction)
    hit = ranked.join(net, F.col("feature") == F.col("target")).groupBy(row, "source").agg(F.count(F.when(F.col("r") <= F.col("top"), 1)).alias("overlap"), F.count(F.lit(1)).alias("size"), F.max("top").alias("top"), F.max("n").alias("n")).where(F.col("size") >= tmin)
    if not p_values:
        return hit
    p = S.col_hypergeom_sf(F.col("overlap") - 1, "n", "size", "top")
    return benjamini_hochberg(hit.withColumn("pvalue", p), by=[row], out="padj", tie=["source"])


def aucell(long: DataFrame, net: DataFrame, row: str, fraction: float = 0.05, tmin: int = 5) -> DataFrame:
    """(row, source, score): area under the recovery curve of a set over each row's top features, 1 at best."""
    ranked = _top(long, row, fraction)
    hit = ranked.join(net, F.col("feature") == F.col("target")).groupBy(row, "source").agg(
        F.sum(F.when(F.col("r") <= F.col("top"), F.col("top") - F.col("r") + 1).otherwise(0)).alias("area"), F.count(F.lit(1)).alias("k"), F.max("top").alias("top")
    )
    hit = hit.where(F.col("k") >= tmin)
    k = F.least("k", "top").cast("double")
    return hit.select(row, "source", (F.col("area") / (k * F.col("top") - k * (k - 1) / 2.0)).alias("score"))


def gsea(long: DataFrame, net: DataFrame, row: str, tmin: int = 5) -> DataFrame:
    """(row, source, score): weighted running-sum enrichment score, the extreme deviation with its sign."""
    ranked = long.withColumn("r", F.row_number().over(Window.partitionBy(row).orderBy(F.desc("value"), "feature")))
    n = ranked.groupBy(row).agg(F.count(F.lit(1)).alias("n"))
    hit = ranked.join(net, F.col("feature") == F.col("target")).withColumn("w", F.abs("value"))
    part = Window.partitionBy(row, "source")
    w = part.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.join(n, row).withColumns({"k": F.count(F.lit(1)).over(part), "tw": F.sum("w").over(part), "cw": F.sum("w").over(w), "i": F.count(F.lit(1)).over(w)}).where((F.col("k") >= tmin) & (F.col("k") < F.col("n")))
    miss_after, miss = (F.col("r") - F.col("i")) / (F.col("n") - F.col("k")), F.col("tw")
    after = F.col("cw") / miss - miss_after
    before = (F.col("cw") - F.col("w")) / miss - miss_after
    ext = hit.groupBy(row, "source").agg(F.max(after).alias("hi"), F.min(before).alias("lo"))
    return ext.select(row, "source", F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("score"))


def mlm(df: DataFrame, features: Sequence[str], net: DataFrame, row: str, tmin: int = 5) -> DataFrame:
    """(row, source, score): t of each set in one linear model of a row on all set weights.

    Sets and features are bounded (features x sets goes to every task); rows stream in Arrow batches.
    """
    feats = list(features)
    w = net.where(F.col("target").isin(feats)).groupBy("source", "target").agg(F.sum("weight").alias("w")).toPandas()
    sizes = w.groupby("source").size()
    sources = sorted(sizes[sizes >= tmin].index)
    x = np.zeros((len(feats), len(sources) + 1))
    x[:, 0] = 1.0
    at, place = {f: i for i, f in enumerate(feats)}, {s: i + 1 for i, s in enumerate(sources)}
    for s, t, v in w.itertuples(index=False):
        if s in place:
            x[at[t], place[s]] = v
    inv, dof = np.linalg.pinv(x.T @ x), len(feats) - x.shape[1]

    def run(batches):
        for b in batches:
            y = np.nan_to_num(b[feats].to_numpy(float)).T
            beta = inv @ x.T @ y
            s2 = ((y - x @ beta) ** 2).sum(0) / max(1, dof)
            t = beta[1:] / np.sqrt(np.maximum(np.outer(np.diag(inv)[1:], s2), 1e-300))
            yield pd.DataFrame({row: np.repeat(b[row].to_numpy(), len(sources)), "source": np.tile(sources, len(b)), "score": t.T.ravel()})

    return df.select(row, *feats).mapInPandas(run, f"`{row}` {dict(df.dtypes)[row]}, source string, score double")


def viper(long: DataFrame, net: DataFrame, row: str, tmin: int = 5) -> DataFrame:
    """(row, source, score): normalised rank-based regulon score: weighted mean of normal quantiles of ranks."""
    part = Window.partitionBy(row)
    q = F.row_number().over(part.orderBy("value", "feature")) / (F.count(F.lit(1)).over(part) + 1.0)
    z = long.withColumn("z", S.col_ndtri(q))
    hit = z.join(net, F.col("feature") == F.col("target")).groupBy(row, "source").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col("weight") * F.col("z")).alias("a"), F.sum(F.abs("weight")).alias("b"), F.sum(F.col("weight") * F.col("weight")).alias("c")
    )
    return hit.where(F.col("k") >= tmin).select(row, "source", (F.col("a") / F.sqrt("c")).alias("score"))


def gsva(long: DataFrame, net: DataFrame, row: str, tmin: int = 5) -> DataFrame:
    """(row, source, score): random-walk score of ranks among rows for each feature: largest less largest negative deviation."""
    by_feature = Window.partitionBy("feature")
    d = F.cume_dist().over(by_feature.orderBy("value"))
    ranked = long.withColumn("d", d).withColumn("value", F.col("d")).drop("d")
    order = Window.partitionBy(row).orderBy(F.desc("value"), "feature")
    ranked = ranked.withColumn("r", F.row_number().over(order))
    n = ranked.groupBy(row).agg(F.count(F.lit(1)).alias("n"))
    hit = ranked.join(net, F.col("feature") == F.col("target")).join(n, row).withColumn("w", F.abs(F.col("n") / 2.0 - F.col("r")) + 1e-12)
    part = Window.partitionBy(row, "source")
    w = part.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumns({"k": F.count(F.lit(1)).over(part), "tw": F.sum("w").over(part), "cw": F.sum("w").over(w), "i": F.count(F.lit(1)).over(w)}).where((F.col("k") >= tmin) & (F.col("k") < F.col("n")))
    miss = (F.col("r") - F.col("i")) / (F.col("n") - F.col("k"))
    return hit.groupBy(row, "source").agg((F.greatest(F.lit(0.0), F.max(F.col("cw") / F.col("tw") - miss)) + F.least(F.lit(0.0), F.min((F.col("cw") - F.col("w")) / F.col("tw") - miss))).alias("score"))


def consensus(scores: Sequence[DataFrame], row: str) -> DataFrame:
    """(row, source, score): mean over methods of scores standardised within each row."""
    out = None
    for i, s in enumerate(scores):
        part = Window.partitionBy(row)
        z = s.withColumn("score", (F.col("score") - F.avg("score").over(part)) / F.when(F.stddev_pop("score").over(part) > 0, F.stddev_pop("score").over(part))).select(row, "source", "score")
        out = z if out is None else out.unionByName(z)
    return out.groupBy(row, "source").agg(F.avg("score").alias("score"))


def permutation_padj(long: DataFrame, net: DataFrame, row: str, n_permutations: int = 100, seed: int = 0, tmin: int = 5) -> DataFrame:
    """(row, source, score, pvalue, padj): set means against means of the same sets with features relabelled by hash."""
    def score(values: DataFrame) -> DataFrame:
        return values.join(net, F.col("feature") == F.col("target")).groupBy(row, "d", "source").agg(F.avg("value").alias("score"), F.count(F.lit(1)).alias("k")).where(F.col("k") >= tmin)

    obs = score(long.withColumn("d", F.lit(-1).cast("long"))).select(row, "source", "score")
    names = long.select("feature").distinct()
    draws = names.crossJoin(long.sparkSession.range(n_permutations).withColumnRenamed("id", "d"))
    a = draws.withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy("feature")))
    b = draws.withColumnRenamed("feature", "other").withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64(F.lit(seed), "d", "other"), "other")))
    moved = long.join(a.join(b, ["d", "k"]).select("d", "feature", "other"), "feature").select(row, "d", F.col("other").alias("feature"), "value")
    null = score(moved).select(row, "source", F.col("score").alias("null"))
    p = obs.join(null, [row, "source"], "left").groupBy(row, "source").agg(F.first("score").alias("score"), ((F.count(F.when(F.abs("null") >= F.abs("score"), 1)) + 1.0) / (F.count("null") + 1.0)).alias("pvalue"))
    return benjamini_hochberg(p, by=[row], out="padj", tie=["source"])


def ora(groups: DataFrame, net: DataFrame, universe: DataFrame | None = None, tmin: int = 5, min_overlap: int = 1, padj_by: str = "all", p_values: bool = True) -> DataFrame:
    """(group, source, overlap, size, n_group, n, odds_ratio[, pvalue, padj]) of gene lists (group, gene).

    The universe is the distinct genes; odds_ratio is the logarithm of the ratio with 0.5 added to each cell; groups
    of no or all genes are left out.
    """
    genes = (universe if universe is not None else groups.select("gene")).where("gene is not null and gene <> ''").distinct()
    n = genes.agg(F.count(F.lit(1)).alias("n"))
    mem = groups.where("gene is not null and gene <> ''").distinct()
    sets = net.select("source", F.col("target").alias("gene")).distinct().join(genes, "gene", "left_semi")
    size = sets.groupBy("source").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= tmin)
    gsize = mem.groupBy("group").agg(F.count(F.lit(1)).alias("n_group"))
    both = mem.join(sets, "gene").groupBy("group", "source").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= min_overlap)
    out = both.join(size, "source").join(gsize, "group").crossJoin(n).where("n_group > 0 and n_group < n")
    a, b, c = F.col("overlap"), F.col("n_group") - F.col("overlap"), F.col("size") - F.col("overlap")
    d = F.col("n") - F.col("n_group") - c
    out = out.withColumn("odds_ratio", F.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))))
    if not p_values:
        return out
    out = out.withColumn("pvalue", S.col_fisher(a, b, c, d))
    return benjamini_hochberg(out, by=["group"] if padj_by == "group" else [], out="padj", tie=["group", "source"])


def enrich_hits(rows: DataFrame, net: DataFrame, gene: str, hit: Column, **options) -> DataFrame:
    """Sets among the genes with a hit in any row."""
    each = rows.groupBy(F.col(gene).alias("gene")).agg(F.max(hit).alias("hit"))
    return ora(each.where("hit").select(F.lit("hits").alias("group"), "gene"), net, each.select("gene"), **options)


def rank_features(long: DataFrame, group: str) -> DataFrame:
    """(group, feature, score): one-vs-rest rank-sum z of each feature, ties corrected. long: (group, feature, value)."""
    ties = F.count(F.lit(1)).over(Window.partitionBy("feature", "value"))
    ranked = long.withColumns({"r": average_rank("value", ["feature"]), "t": ties})
    n = ranked.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t") * F.col("t") - 1.0).alias("tie"))
    each = ranked.groupBy(F.col(group).alias("group"), "feature").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("k"))
    j = each.join(n, "feature")
    k, m = F.col("k").cast("double"), (F.col("n") - F.col("k")).cast("double")
    total = F.col("n").cast("double")
    sd = F.sqrt(k * m / 12.0 * ((total + 1) - F.col("tie") / (total * (total - 1))))
    return j.select("group", "feature", ((F.col("s") - k * (total + 1) / 2.0) / F.when(sd > 0, sd)).alias("score"))


def rank_sets(scores: DataFrame, group: str) -> DataFrame:
    """(group, source, score): mean inside less mean outside. scores: (group, source, score) by row."""
    total = scores.groupBy("source").agg(F.sum("score").alias("ts"), F.count("score").alias("tn"))
    each = scores.groupBy(F.col(group).alias("group"), "source").agg(F.sum("score").alias("s"), F.count("score").alias("n"))
    rest = F.col("tn") - F.col("n")
    return each.join(total, "source").select("group", "source", (F.col("s") / F.col("n") - (F.col("ts") - F.col("s")) / F.when(rest > 0, rest)).alias("score"))


# ---------------------------------------------------------------- populations


def composition_shift(df: DataFrame, cluster: str, group: str, control: Column, block: str | None = None) -> DataFrame:
    """(group, cluster, shift, distance): mean over blocks of group share less reference share; half the sum of |shift|."""
    b = [block] if block else []
    rows = df.where(F.col(cluster).isNotNull()).withColumn("__c", control)
    ctl = rows.where("__c").groupBy(*b, cluster).agg(F.count(F.lit(1)).alias("cn"))
    ctl = ctl.withColumn("cs", F.col("cn") / F.sum("cn").over(Window.partitionBy(*b))).drop("cn")
    trt = rows.where("not __c").groupBy(F.col(group).alias("group"), *b, cluster).agg(F.count(F.lit(1)).alias("n"))
    units = trt.select("group", *b).distinct()
    clusters = rows.select(cluster).distinct()
    if block:
        units = units.join(ctl.select(block).distinct(), block, "left_semi")
    full = units.crossJoin(clusters).join(trt, ["group", *b, cluster], "left")
    full = full.withColumn("share", F.coalesce("n", F.lit(0)) / F.sum("n").over(Window.partitionBy("group", *b)))
    full = join_fit(full, ctl, [*b, cluster])
    shift = full.groupBy("group", cluster).agg(F.avg(F.col("share") - F.coalesce("cs", F.lit(0.0))).alias("shift"))
    return shift.withColumn("distance", 0.5 * F.sum(F.abs("shift")).over(Window.partitionBy("group")))


def composition_shift_pvalues(df: DataFrame, cluster: str, group: str, control: Column, unit: str, n_permutations: int = 999, seed: int = 0) -> DataFrame:
    """(group, distance, pvalue, qvalue): whole units (replicates) relabelled between the group and the controls.

    A unit enters as its cluster counts; the controls' counts (units x clusters) are sent to every group's task.
    """
    counts = df.where(F.col(cluster).isNotNull()).withColumn("__c", control).groupBy("__c", F.col(group).cast("string").alias("group"), F.col(unit).cast("string").alias("unit"), F.col(cluster).cast("string").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    ctl = counts.where("__c").toPandas().pivot_table(index="unit", columns="cluster", values="n", aggfunc="sum", fill_value=0)
    names = sorted(r[0] for r in counts.select("cluster").distinct().collect())
    base = ctl.reindex(columns=names, fill_value=0).to_numpy(float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot_table(index="unit", columns="cluster", values="n", aggfunc="sum", fill_value=0).reindex(columns=names, fill_value=0).to_numpy(float)
        both, k, name = np.concatenate([x, base]), len(x), pdf["group"].iloc[0]
        total = both.sum(0)

        def value(rows: np.ndarray) -> float:
            a = both[rows].sum(0)
            b = total - a
            return 0.5 * float(np.abs(a / max(1, a.sum()) - b / max(1, b.sum())).sum())

        obs, rng = value(np.arange(k)), np.random.default_rng([seed, *name.encode()])
        hits = sum(value(rng.choice(len(both), k, replace=False)) >= obs - 1e-12 for _ in range(n_permutations))
        return pd.DataFrame({"group": [name], "distance": [obs], "pvalue": [(hits + 1.0) / (n_permutations + 1.0)]})

    out = counts.where("not __c").groupBy("group").applyInPandas(run, "group string, distance double, pvalue double")
    return benjamini_hochberg(out, tie=["group"])


def subpopulation_hits(df: DataFrame, features: Sequence[str], cluster: str, group: str, control: Column, half: Column, min_cells: int = 2) -> DataFrame:
    """(cluster, group, ks, n, m, pvalue, qvalue): in each cluster, distance to the mean of one half of its controls; the
    group's distances against those of the other half; p by the asymptotic bound."""
    feats = list(features)
    rows = df.withColumns({"__c": control, "__h": half})
    ref = rows.where("__c and __h").groupBy(cluster).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(f).alias(f"{f}__m") for f in feats]).where(F.col("__n") >= max(min_cells, 2))
    d2 = sum((F.coalesce(F.pow(F.col(f) - F.col(f"{f}__m"), F.lit(2.0)), F.lit(0.0)) for f in feats), F.lit(0.0))
    far = join_fit(rows.where("not (__c and __h)"), ref, [cluster], "inner").select(cluster, group, "__c", F.sqrt(d2).alias("value"))
    groups = far.where("not __c").select(F.col(cluster).alias("cluster"), F.col(group).alias("group"), "value")
    pool = far.where("__c").select(F.col(cluster).alias("cluster"), "value").join(groups.select("cluster", "group").distinct(), "cluster").select("cluster", "group", "value")
    by = ["cluster", "group"]
    counts = cumulative_counts(groups, pool, "value", by)
    part = Window.partitionBy(*by)
    t = counts.withColumns({"ta": F.max("na").over(part), "tb": F.max("nb").over(part)}).where("ta > 0 and tb > 0")
    out = t.groupBy(*by).agg(F.max(F.abs(F.col("na") / F.col("ta") - F.col("nb") / F.col("tb"))).alias("ks"), F.max("ta").alias("n"), F.max("tb").alias("m"))
    lam = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))) * F.col("ks")
    return benjamini_hochberg(out.withColumn("pvalue", F.least(F.lit(1.0), 2.0 * F.exp(-2.0 * lam * lam))), tie=by)


def dna_content(df: DataFrame, feature: str, by: Sequence[str], min_cells: int = 50, grid: int = 512) -> DataFrame:
    """dna_content: log2 intensity less the G1 peak of the group.

    The peak is the mode of a kernel density; a peak one doubling lower wins if it is a tenth as high. Groups are
    reduced to `grid` histogram counts before the peak is sought, so no group is gathered.
    """
    rows = df.withColumn("__x", F.when(F.col(feature) > 0, F.log2(feature)))
    stats = rows.groupBy(*by).agg(F.min("__x").alias("lo"), F.max("__x").alias("hi"), F.count("__x").alias("n"), F.stddev_samp("__x").alias("s"))
    binned = join_fit(rows, stats, by).where("__x is not null and hi > lo").withColumn("bin", F.least(F.lit(grid - 1), F.floor((F.col("__x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * grid)).cast("int"))
    hist = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("k"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("n"), F.first("s").alias("s"))
    packed = hist.groupBy(*by).agg(F.collect_list(F.struct("bin", "k")).alias("h"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("n"), F.first("s").alias("s"))

    @F.pandas_udf("double")
    def peak(h: pd.Series, lo: pd.Series, hi: pd.Series, n: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([g1_peak({int(x["bin"]): int(x["k"]) for x in a}, b, c, d, e, grid) if d >= min_cells else np.nan for a, b, c, d, e in zip(h, lo, hi, n, s)], dtype=float)

    fit = packed.select(*by, F.nanvl(peak("h", "lo", "hi", "n", "s"), F.lit(None).cast("double")).alias("__peak"))
    return join_fit(rows, fit, by).withColumn("dna_content", F.col("__x") - F.col("__peak")).drop("__x", "__peak")


def g1_peak(counts: dict[int, int], lo: float, hi: float, n: int, sd: float, grid: int) -> float:
    at = lo + (np.arange(grid) + 0.5) * (hi - lo) / grid
    k = np.zeros(grid)
    for b, c in counts.items():
        k[b] = c
    width = max((hi - lo) / grid, 1.06 * (sd or 0.1) * n ** (-0.2) * 0.5)
    density = np.exp(-0.5 * ((at[:, None] - at[None, :]) / width) ** 2) @ k
    top = int(density.argmax())
    lower = np.abs(at - (at[top] - 1.0)) < 0.15
    inner = np.r_[False, (density[1:-1] >= density[:-2]) & (density[1:-1] >= density[2:]), False]
    cand = np.flatnonzero(lower & inner & (density >= 0.1 * density[top]))
    return float(at[cand[density[cand].argmax()]]) if len(cand) else float(at[top])


def dna_state(content: Column, cutoffs: tuple[float, float] = (1.25, 1.75)) -> Column:
    """2N, S or 4N of a log2 content."""
    return F.when(content < float(np.log2(cutoffs[0])), "2N").when(content < float(np.log2(cutoffs[1])), "S").when(content.isNotNull(), "4N")


def fit_cell_cycle(df: DataFrame, content: str, reference: Column, bins: int = 400) -> dict[str, float]:
    """Mixture of a 2N and a 4N normal with a uniform S between, by expectation steps on a histogram of the reference."""
    h = df.where(reference).where(f"`{content}` between -1 and 2").groupBy(F.floor((F.col(content) + 1.0) * bins / 3.0).alias("b")).agg(F.count(F.lit(1)).alias("k")).toPandas()
    x, k = -1.0 + (h["b"].to_numpy(float) + 0.5) * 3.0 / bins, h["k"].to_numpy(float)
    w, sd = np.array([0.5, 0.25, 0.25]), 0.1
    mid = np.array([0.0, 1.0])
    for _ in range(200):
        d = np.column_stack([np.exp(-0.5 * ((x - m) / sd) ** 2) / sd / np.sqrt(2 * np.pi) for m in mid] + [((x > mid[0]) & (x < mid[1])) / max(1e-9, mid[1] - mid[0])])
        r = d * w[[0, 2, 1]] + 1e-300
        r = r / r.sum(1, keepdims=True) * k[:, None]
        new = r.sum(0)[[0, 2, 1]] / max(1e-9, k.sum())
        mid = np.array([(r[:, i] @ x) / max(1e-9, r[:, i].sum()) for i in (0, 1)])
        sd = max(0.02, np.sqrt(sum(r[:, i] @ (x - mid[i]) ** 2 for i in (0, 1)) / max(1e-9, r[:, :2].sum())))
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return {"g1": float(w[0]), "s": float(w[1]), "g2": float(w[2]), "mean_2n": float(mid[0]), "mean_4n": float(mid[1]), "sd": float(sd)}


def project_cell_cycle(df: DataFrame, content: str, model: dict[str, float]) -> DataFrame:
    """phase and cycle_position in [0, 1] from the fitted mixture, as JVM expressions."""
    x, sd = F.col(content), model["sd"]

    def normal(m: float) -> Column:
        return F.exp(-0.5 * F.pow((x - m) / sd, F.lit(2.0))) / (sd * float(np.sqrt(2 * np.pi)))

    width = max(1e-9, model["mean_4n"] - model["mean_2n"])
    g1, g2 = normal(model["mean_2n"]) * model["g1"], normal(model["mean_4n"]) * model["g2"]
    s = F.when((x > model["mean_2n"]) & (x < model["mean_4n"]), model["s"] / width).otherwise(0.0)
    phase = F.when(x.isNull(), None).when((g1 >= s) & (g1 >= g2), "G1").when(s >= g2, "S").otherwise("G2")
    total = F.greatest(g1 + s + g2, F.lit(1e-300))
    frac = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - model["mean_2n"]) / width))
    pos = (g1 * (model["g1"] / 2.0) + s * (model["g1"] + model["s"] * frac) + g2 * (1.0 - model["g2"] / 2.0)) / total
    return df.withColumns({"phase": phase, "cycle_position": pos})


def phase_order(df: DataFrame, phase: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """phase_order in [0, 1]: rank of the value within its phase."""
    return df.withColumn("phase_order", F.when(F.col(phase).isNotNull(), F.percent_rank().over(Window.partitionBy(*by, phase).orderBy(value))))
