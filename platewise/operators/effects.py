"""Two-sample operators: effect sizes, rank tests, distribution distances, hits and genetic screens."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import special as S
from platewise.operators.mcd import robust_covariance
from platewise.operators.quantiles import sum_before
from platewise.operators.stats import MAD_SCALE, average_rank, benjamini_hochberg, cumulative_counts, join_fit, running_total, to_long


def _long(df: DataFrame, features: Sequence[str], group: str, control: Column, ids: Sequence[str] = ()) -> DataFrame:
    return to_long(df.withColumn("__ctl", control), [group, "__ctl", *ids], features)


def cohens_d(df: DataFrame, features: Sequence[str], group: str, control: Column, min_obs: int = 2) -> DataFrame:
    """(group, feature, effect): difference of means over the pooled sd; the pooling weights are row counts."""
    rows = df.withColumn("__ctl", control)
    stats = [x for f in features for x in (F.avg(f).alias(f"{f}__m"), F.var_samp(f).alias(f"{f}__v"))]
    ctl = rows.where("__ctl").agg(F.count(F.lit(1)).alias("nc"), *[s for s in stats])
    ctl = ctl.select("nc", *[F.col(c).alias(f"c_{c}") for c in ctl.columns if c != "nc"])
    trt = rows.where(~F.col("__ctl")).groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), *stats).where(F.col("n") >= min_obs)
    both = trt.crossJoin(ctl)  # one row of controls
    out = []
    for f in features:
        pooled = F.sqrt(((F.col("n") - 1) * F.col(f"{f}__v") + (F.col("nc") - 1) * F.col(f"c_{f}__v")) / (F.col("n") + F.col("nc") - 2))
        out.append(F.struct(F.lit(f).alias("feature"), ((F.col(f"{f}__m") - F.col(f"c_{f}__m")) / F.when(pooled > 0, pooled)).alias("effect")))
    return both.select("group", F.explode(F.array(*out)).alias("e")).select("group", "e.feature", "e.effect")


def robust_effect(df: DataFrame, features: Sequence[str], group: str, control: Column) -> DataFrame:
    """(group, feature, effect): difference of medians over the controls' 1.4826 MAD."""
    rows = df.withColumn("__ctl", control)
    long = to_long(rows, [group, "__ctl"], features)
    med = long.where("__ctl").groupBy("feature").agg(F.median("value").alias("cm"))
    mad = join_fit(long.where("__ctl"), med, ["feature"]).groupBy("feature").agg(F.median(F.abs(F.col("value") - F.col("cm"))).alias("cs"), F.first("cm").alias("cm"))
    trt = long.where(~F.col("__ctl")).groupBy(F.col(group).alias("group"), "feature").agg(F.median("value").alias("m"))
    scale = F.col("cs") * MAD_SCALE
    return join_fit(trt, mad, ["feature"]).select("group", "feature", ((F.col("m") - F.col("cm")) / F.when(scale > 0, scale)).alias("effect"))


def mann_whitney(df: DataFrame, features: Sequence[str], group: str, control: Column, row_id: str, p_values: bool = True, exact: bool | str = "auto", exact_up_to: int = 8) -> DataFrame:
    """(group, feature, u, n1, n2[, pvalue, qvalue]): each group against the controls, ranks with ties at their mean.

    u is the sum over the group's rows of the controls below, equal ones at half. The controls are ranked once: each
    value of a feature knows how many of them are below it and equal to it, and groups are joined by value. p is the
    tie-corrected normal with continuity correction, or exact: never (exact=False), for every untied sample (True), or
    ("auto") for the untied samples of groups of which a feature has at most exact_up_to values on either side, however
    many there are on the other; q is over the whole table.
    """
    if exact not in (True, False, "auto"):
        raise ValueError(f"exact must be True, False or 'auto', got {exact!r}")
    long = _long(df, features, group, control, [row_id])
    ctl = long.groupBy("feature", "value").agg(F.count(F.when(F.col("__ctl"), 1)).alias("eq"))
    ctl = sum_before(ctl, ["feature"], "value", "eq", "lt")
    cube = lambda t: t * t * t - t
    total = ctl.groupBy("feature").agg(F.sum("eq").alias("n2"), F.sum(cube(F.col("eq").cast("double"))).alias("tie2"))
    own = long.where(~F.col("__ctl")).groupBy(F.col(group).alias("group"), "feature", "value").agg(F.count(F.lit(1)).alias("k"))
    eq, k = F.col("eq").cast("double"), F.col("k").cast("double")
    agg = own.join(ctl, ["feature", "value"]).groupBy("group", "feature").agg(
        F.sum(k * (F.col("lt") + eq / 2.0)).alias("u"), F.sum("k").alias("n1"), F.sum(cube(eq + k) - cube(eq)).alias("tie1")
    )
    agg = agg.join(total, "feature").withColumn("tie", F.col("tie1") + F.col("tie2"))
    if not p_values:
        return agg.select("group", "feature", "u", "n1", "n2")
    n = (F.col("n1") + F.col("n2")).cast("double")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = F.greatest(F.lit(0.0), F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2.0) - 0.5) / F.when(sd > 0, sd)
    normal = F.least(F.lit(1.0), 2.0 * S.col_norm_sf(z))
    if exact is False:
        p = normal
    else:
        least = F.min(F.least("n1", "n2")).over(Window.partitionBy("group"))
        agg = agg.withColumn("__exact", (F.col("tie") == 0) & (F.lit(exact is True) | (least <= exact_up_to)))
        p = F.when(F.col("__exact"), S.col_mann_whitney_exact(F.when(F.col("__exact"), F.col("u")), "n1", "n2")).otherwise(normal)
    return benjamini_hochberg(agg.withColumn("pvalue", p), tie=["group", "feature"]).select("group", "feature", "u", "n1", "n2", "pvalue", "qvalue")


def wasserstein(df: DataFrame, features: Sequence[str], group: str, control: Column) -> DataFrame:
    """(group, feature, distance): area between the distribution functions of the group and the controls."""
    long = _long(df, features, group, control)
    groups = long.where(~F.col("__ctl")).select(F.col(group).alias("group")).distinct()
    a = long.where(~F.col("__ctl")).select(F.col(group).alias("group"), "feature", "value")
    b = long.where("__ctl").select("feature", "value").crossJoin(groups).select("group", "feature", "value")
    return _between(cumulative_counts(a, b, "value", ["group", "feature"]), ["group", "feature"])


def _between(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    part = Window.partitionBy(*by)
    step = F.lead("value").over(part.orderBy("value")) - F.col("value")
    rows = counts.withColumns({"step": step, "ta": F.max("na").over(part), "tb": F.max("nb").over(part)})
    gap = F.abs(F.col("na") / F.col("ta") - F.col("nb") / F.col("tb")) * F.col("step")
    return rows.groupBy(*by).agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("distance"))


def ks_statistic(a: DataFrame, b: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by…, ks): largest gap of the distribution functions from either side of each jump."""
    counts = cumulative_counts(a, b, value, by)
    part = Window.partitionBy(*by)
    rows = counts.withColumns({"ta": F.max("na").over(part), "tb": F.max("nb").over(part)})
    gap = F.abs(F.col("na") / F.when(F.col("ta") > 0, F.col("ta")) - F.col("nb") / F.when(F.col("tb") > 0, F.col("tb")))
    return rows.groupBy(*by).agg(F.max(gap).alias("ks"))


def mean_square_distances(df: DataFrame, vector: str, group: str) -> DataFrame:
    """(group_a, group_b, m), group_a <= group_b: mean squared Euclidean distance of rows of either group, self pairs left out.

    From each group's sums and sums of squares about the overall mean, so no pair of rows is ever made.
    """
    long = df.select(F.col(group).alias("g"), F.posexplode(vector).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    centre = long.groupBy("pos").agg(F.avg("v").alias("c"))
    each = long.join(centre, "pos").groupBy("g", "pos").agg(F.count("v").alias("n"), F.sum(F.col("v") - F.col("c")).alias("s"), F.sum((F.col("v") - F.col("c")) * (F.col("v") - F.col("c"))).alias("q"))
    a, b = (each.select("pos", F.col("g").alias(f"group_{k}"), *[F.col(c).alias(f"{c}{k}") for c in "nsq"]) for k in "ab")
    both = a.join(b, "pos").where("group_a <= group_b")
    total = F.col("nb") * F.col("qa") + F.col("na") * F.col("qb") - 2.0 * F.col("sa") * F.col("sb")
    out = both.groupBy("group_a", "group_b").agg(F.sum(total).alias("t"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    pairs = F.when(F.col("group_a") == F.col("group_b"), F.col("na") * (F.col("na") - 1)).otherwise(F.col("na") * F.col("nb"))
    return out.where(pairs > 0).select("group_a", "group_b", (F.greatest(F.lit(0.0), F.col("t")) / pairs).alias("m"))


def energy_distance(df: DataFrame, row_id: str, vector: str, group: str) -> DataFrame:
    """(group_a, group_b, distance): 2 E|ab| - E|aa'| - E|bb'| of squared Euclidean distances, self pairs left out."""
    mean = mean_square_distances(df, vector, group)
    own = mean.where("group_a = group_b")
    out = mean.where("group_a < group_b").join(own.select("group_a", F.col("m").alias("ma")), "group_a").join(own.select("group_b", F.col("m").alias("mb")), "group_b")
    return out.select("group_a", "group_b", (2.0 * F.col("m") - F.col("ma") - F.col("mb")).alias("distance"))


def edistance(df: DataFrame, row_id: str, vector: str, group: str, control: Column, n_permutations: int = 1000, max_reference: int = 2000, seed: int = 0) -> DataFrame:
    """(group, distance, pvalue, qvalue): energy distance to the controls and its permutation p of row labels.

    At most max_reference controls, the first by a hash of their id, are sent to every group's task.
    """
    order = F.xxhash64(F.lit(seed), row_id)
    ref = df.where(control).orderBy(order, row_id).limit(max_reference).select(vector).toPandas()[vector]
    ref = np.array([np.asarray(v, float) for v in ref])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([np.asarray(v, float) for v in pdf.sort_values(row_id)[vector]])
        z = np.concatenate([x, ref])
        z -= z.mean(0)
        sq = (z * z).sum(1)
        n, m = len(x), len(ref)
        every, every_sq = z.sum(0), sq.sum()

        def value(mask: np.ndarray) -> float:
            """Sums of squared distances of two sets come from their sums, so no table of distances is made."""
            a, a_sq = z[mask].sum(0), sq[mask].sum()
            b, b_sq = every - a, every_sq - a_sq
            between = m * a_sq + n * b_sq - 2.0 * a @ b
            own, other = 2.0 * (n * a_sq - a @ a), 2.0 * (m * b_sq - b @ b)
            return 2.0 * between / (n * m) - own / max(1, n * (n - 1)) - other / max(1, m * (m - 1))

        mask = np.arange(n + m) < n
        obs = value(mask)
        rng = np.random.default_rng([seed, *str(pdf[group].iloc[0]).encode()])
        hits = sum(value(rng.permutation(mask)) >= obs for _ in range(n_permutations))
        return pd.DataFrame({"group": [str(pdf[group].iloc[0])], "distance": [obs], "pvalue": [(hits + 1.0) / (n_permutations + 1.0)]})

    out = df.where(~control).groupBy(group).applyInPandas(run, "group string, distance double, pvalue double")
    return benjamini_hochberg(out, tie=["group"])


# ---------------------------------------------------------------- hit calling


def mahalanobis_fit(df: DataFrame, features: Sequence[str], regularization: float = 1e-6, covariance: str = "empirical", row_id: str | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(centre, whitening) of complete rows: medians, and the symmetric inverse root of the covariance about them, or
    (robust) those of the minimum covariance determinant, which rows that stray do not widen."""
    feats = list(features)
    rows = df.dropna(subset=feats)
    if covariance == "robust":
        center, m = robust_covariance(rows, feats, row_id, seed)
        w, q = np.linalg.eigh(m + regularization * np.eye(len(feats)))
        return center, (q / np.sqrt(np.maximum(w, 1e-12))) @ q.T
    med = np.array(rows.agg(*[F.median(f) for f in feats]).first(), float)
    pairs = [(i, j) for i in range(len(feats)) for j in range(i, len(feats))]
    cov = rows.agg(*[F.sum((F.col(feats[i]) - med[i]) * (F.col(feats[j]) - med[j])) for i, j in pairs], F.count(F.lit(1))).first()
    m, n = np.zeros((len(feats), len(feats))), cov[len(pairs)]
    for (i, j), v in zip(pairs, cov):
        m[i, j] = m[j, i] = v / max(1, n - 1)
    w, q = np.linalg.eigh(m + regularization * np.eye(len(feats)))
    return med, (q / np.sqrt(np.maximum(w, 1e-12))) @ q.T


def distance_column(features: Sequence[str], center: np.ndarray, white: np.ndarray) -> Column:
    """Norm of the whitened row as one JVM expression; missing whitened values count as 0."""
    out = F.lit(0.0)
    for k in range(white.shape[1]):
        z = F.lit(0.0)
        for i, f in enumerate(features):
            z = z + F.coalesce(F.col(f) - float(center[i]), F.lit(0.0)) * float(white[i, k])
        out = out + z * z
    return F.sqrt(out)


def split_half(row_id: str, seed: int = 0) -> Column:
    """True for a random half of the rows that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(2)) == 0


def hit_calling(df: DataFrame, features: Sequence[str], group: str, control: Column, row_id: str, method: str = "mahalanobis", n_permutations: int = 1000, threshold: float = 0.05, seed: int = 0, replicate: str | None = None, null: str = "permutation", n_pseudogenes: int = 0, covariance: str = "empirical") -> DataFrame:
    """(group, n, statistic, pvalue, qvalue, is_hit): distance of each group from the controls.

    Half of the controls fit centre and whitening, the other half is the null pool. The statistic is the median row
    distance (ks: the Kolmogorov-Smirnov distance to the pool); its null draws the group's size from the group
    together with the held-out controls, whose distances are collected (one number for each). With `replicate`, whole
    units are split and drawn, as many as the group has.

    null="pseudogenes": draws are made of held-out control units alone, as many as the group has, so a group's own rows
    never enter its null; a group of more units than there are has no p. `n_pseudogenes` such draws of the median
    number of units are returned as rows `pseudogene_<i>`, each against the others: a screen where nothing is a hit.
    """
    if covariance not in ("empirical", "robust"):
        raise ValueError(f"covariance must be 'empirical' or 'robust', got {covariance!r}")
    rows = df.withColumns({"__ctl": control, "__fit": split_half(replicate or row_id, seed), "__unit": F.col(replicate or row_id).cast("string")})
    center, white = mahalanobis_fit(rows.where("__ctl and __fit"), features, covariance=covariance, row_id=row_id, seed=seed)
    scored = rows.where("not (__ctl and __fit)").select(row_id, group, "__ctl", "__unit", distance_column(features, center, white).alias("d"))
    held = scored.where("__ctl").select("d", "__unit").toPandas().sort_values(["__unit", "d"])
    pool, pool_units = held["d"].to_numpy(float), held["__unit"].to_numpy()
    if len(pool) < 2:
        raise ValueError("hit calling needs four controls at least")

    pool_by = [pool[pool_units == u] for u in pd.unique(pool_units)]

    def stat(x: np.ndarray) -> float:
        if method == "mahalanobis":
            return float(np.median(x))
        both = np.sort(np.concatenate([x, pool]))
        return float(np.abs(np.searchsorted(np.sort(x), both, "right") / len(x) - np.searchsorted(np.sort(pool), both, "right") / len(pool)).max())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(row_id)["d"].to_numpy(float)
        name = str(pdf[group].iloc[0])
        rng = np.random.default_rng([seed, *name.encode()])
        every, obs = np.concatenate([x, pool]), stat(x)
        if null == "pseudogenes":
            k = pdf["__unit"].nunique()
            if k > len(pool_by):
                return pd.DataFrame({"group": [name], "n": [len(x)], "statistic": [obs], "pvalue": [np.nan]})
            draws = (np.concatenate([pool_by[i] for i in rng.choice(len(pool_by), k, replace=False)]) for _ in range(n_permutations))
        elif replicate is None:
            draws = (rng.choice(every, len(x), replace=False) for _ in range(n_permutations))
        else:
            own = pdf.sort_values(row_id)["__unit"].to_numpy()
            units = [x[own == u] for u in pd.unique(own)] + [pool[pool_units == u] for u in pd.unique(pool_units)]
            k = len(pd.unique(own))
            draws = (np.concatenate([units[i] for i in rng.choice(len(units), k, replace=False)]) for _ in range(n_permutations))
        hits = sum(stat(d) >= obs - 1e-12 for d in draws)
        return pd.DataFrame({"group": [name], "n": [len(x)], "statistic": [obs], "pvalue": [(hits + 1.0) / (n_permutations + 1.0)]})

    out = scored.where("not __ctl").groupBy(group).applyInPandas(run, "group string, n long, statistic double, pvalue double")
    if null == "pseudogenes":
        out = out.withColumn("pvalue", F.nanvl("pvalue", F.lit(None).cast("double")))
    out = benjamini_hochberg(out, tie=["group"]).withColumn("is_hit", F.col("qvalue") <= threshold)
    if null == "pseudogenes" and n_pseudogenes:
        k = scored.where("not __ctl").groupBy(group).agg(F.count_distinct("__unit").alias("k")).agg(F.percentile_approx("k", F.lit(0.5))).first()[0]
        rng = np.random.default_rng([seed, 1])
        k = min(int(k or 1), len(pool_by))
        made = [np.concatenate([pool_by[i] for i in rng.choice(len(pool_by), k, replace=False)]) for _ in range(n_pseudogenes)]
        scores = np.array([stat(x) for x in made])
        rows = [(f"pseudogene_{i}", len(x), float(s), float((1 + (np.delete(scores, i) >= s - 1e-12).sum()) / n_pseudogenes)) for i, (x, s) in enumerate(zip(made, scores))]
        fake = df.sparkSession.createDataFrame(rows, "group string, n long, statistic double, pvalue double")
        out = out.unionByName(fake.withColumns({"qvalue": F.lit(None).cast("double"), "is_hit": F.lit(None).cast("boolean")}))  # of no family
    return out


def hellinger(df: DataFrame, features: Sequence[str], group: str, control: Column, regularization: float = 1e-6) -> DataFrame:
    """(group, hellinger2, mp_distance): Gaussian Hellinger distance squared to the controls, and the squared Mahalanobis
    distance of the means in the averaged covariance."""
    feats = list(features)
    ctl = df.where(control).dropna(subset=feats)
    k = len(feats)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = ctl.agg(*[F.avg(f) for f in feats], *[F.covar_samp(feats[i], feats[j]) for i, j in pairs]).first()
    m0, c0 = np.array(row[:k], float), np.zeros((k, k))
    for (i, j), v in zip(pairs, row[k:]):
        c0[i, j] = c0[j, i] = v

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[feats].dropna().to_numpy(float)
        reg = regularization * np.eye(k)
        m, c = x.mean(0), np.cov(x.T).reshape(k, k) + reg if len(x) > 1 else reg
        mid = (c + c0 + reg) / 2.0
        diff = m - m0
        maha = float(diff @ np.linalg.solve(mid, diff))
        logs = [np.linalg.slogdet(z)[1] for z in (c, c0 + reg, mid)]
        h2 = 1.0 - float(np.exp(0.25 * logs[0] + 0.25 * logs[1] - 0.5 * logs[2] - maha / 8.0))
        return pd.DataFrame({"group": [str(pdf[group].iloc[0])], "hellinger2": [h2], "mp_distance": [maha]})

    return df.where(~control).groupBy(group).applyInPandas(run, "group string, hellinger2 double, mp_distance double")


def differential(df: DataFrame, features: Sequence[str], group: str, control: Column, block: str | None = None, min_replicates: int = 2) -> DataFrame:
    """(group, feature, effect, t, df, pvalue, qvalue): moderated t of each group against the controls of shared blocks.

    Ordinary least squares on [1, treated, block]; variances are shrunk towards a fitted prior over the features.
    Controls are joined to each group by block, so a group's task holds its blocks only.
    """
    feats = list(features)
    b = block or "__b"
    rows = df if block else df.withColumn("__b", F.lit(0))
    trt = rows.where(~control).select(F.col(group).alias("group"), b, *feats, F.lit(1.0).alias("__t"))
    ctl = rows.where(control).select(b, *feats, F.lit(0.0).alias("__t"))
    both = trt.unionByName(ctl.join(trt.select("group", b).distinct(), b).select("group", b, *feats, "__t"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shared = [x for x, g in pdf.groupby(b) if g["__t"].nunique() == 2]
        pdf = pdf[pdf[b].isin(shared)]
        n1 = int(pdf["__t"].sum())
        if n1 < min_replicates or len(pdf) - n1 < 2:
            return pd.DataFrame(columns=["group", "feature", "effect", "t", "df", "pvalue"])
        x = np.column_stack([np.ones(len(pdf)), pdf["__t"], *[(pdf[b] == s).astype(float) for s in shared[1:]]])
        y = pdf[feats].to_numpy(float)
        ok = ~np.isnan(y).any(0)
        beta, *_ = np.linalg.lstsq(x, y[:, ok], rcond=None)
        dof = len(x) - np.linalg.matrix_rank(x)
        if dof < 1:
            return pd.DataFrame(columns=["group", "feature", "effect", "t", "df", "pvalue"])
        s2 = ((y[:, ok] - x @ beta) ** 2).sum(0) / dof
        post, prior = moderate(s2, dof)
        se = np.sqrt(post * np.linalg.pinv(x.T @ x)[1, 1])
        t = beta[1] / np.where(se > 0, se, np.nan)
        total = dof + (prior if np.isfinite(prior) else 1e6)
        return pd.DataFrame({"group": str(pdf["group"].iloc[0]), "feature": np.array(feats)[ok], "effect": beta[1], "t": t, "df": float(total), "pvalue": S.t_sf2(t, total)})

    out = both.groupBy("group").applyInPandas(run, "group string, feature string, effect double, t double, df double, pvalue double")
    return benjamini_hochberg(out, by=["group"], tie=["feature"])


def moderate(s2: np.ndarray, dof: float) -> tuple[np.ndarray, float]:
    """(posterior variances, prior degrees of freedom) by matching the moments of log variances."""
    ok = s2 > 0
    if ok.sum() < 2:
        return s2, 0.0
    z = np.log(s2[ok]) - S.digamma(np.array([dof / 2.0])) + np.log(dof / 2.0)
    spread = z.var(ddof=1) - float(S.trigamma(np.array([dof / 2.0]))[0])
    if spread <= 0:
        prior, s0 = np.inf, float(np.exp(z.mean()))
        return np.full_like(s2, s0), prior
    prior = 2.0 * float(S.trigamma_inverse(np.array([spread]))[0])
    s0 = float(np.exp(z.mean() + S.digamma(np.array([prior / 2.0]))[0] - np.log(prior / 2.0)))
    return (prior * s0 + dof * s2) / (prior + dof), prior


# ---------------------------------------------------------------- tables over scores


def tail_counts(df: DataFrame, score: str, control: Column, row_id: str) -> DataFrame:
    """Rows with the numbers of controls and of all rows at or above their score: running totals, not a range join."""
    return running_total(df, score, {"ctl_ge": control.cast("long"), "all_ge": F.lit(1).cast("long")}, descending=True)


def empirical_fdr(df: DataFrame, score: str, control: Column, row_id: str, alpha: float = 0.01, criterion: str = "p") -> DataFrame:
    """(row_id, score, pvalue, qvalue, is_hit) of the non-controls with a score, from the controls' tail shares."""
    rows = tail_counts(df.withColumn("__c", control), score, F.col("__c"), row_id)
    counts = df.where(F.col(score).isNotNull()).agg(F.sum(control.cast("long")).alias("nc"), F.sum((~control).cast("long")).alias("nt"))
    rows = rows.where(~F.col("__c")).crossJoin(counts)  # one row
    p = (F.col("ctl_ge") + 1.0) / (F.col("nc") + 1.0)
    fdr = (F.col("ctl_ge") / F.col("nc")) / ((F.col("all_ge") - F.col("ctl_ge")) / F.col("nt"))
    rows = rows.withColumns({"pvalue": p, "fdr": fdr})
    low = running_total(rows, score, {"low": F.col("fdr")}, least=["low"])
    out = low.withColumn("qvalue", F.least(F.lit(1.0), F.greatest("low", "pvalue")))
    hit = F.col("pvalue") <= alpha if criterion == "p" else F.col("qvalue") <= alpha
    return out.select(row_id, score, "pvalue", "qvalue", hit.alias("is_hit"))


def guide_activity(df: DataFrame, features: Sequence[str], reference: Column, guide: str) -> DataFrame:
    """(guide, activity, pvalue): root mean square of robust z against the reference guides; their own p is NULL."""
    rows = df.withColumn("__r", reference)
    long = to_long(rows, [guide, "__r"], features)
    med = long.where("__r").groupBy("feature").agg(F.median("value").alias("m"))
    fit = join_fit(long.where("__r"), med, ["feature"]).groupBy("feature").agg((F.median(F.abs(F.col("value") - F.col("m"))) * MAD_SCALE).alias("s"), F.first("m").alias("m")).where("s > 1e-9")
    z = join_fit(long, fit, ["feature"], "inner").groupBy(guide, "__r").agg(F.sqrt(F.avg(F.pow((F.col("value") - F.col("m")) / F.col("s"), F.lit(2.0)))).alias("activity"))
    rows = tail_counts(z, "activity", F.col("__r"), guide)
    rows = rows.crossJoin(z.where("activity is not null").agg(F.sum(F.col("__r").cast("long")).alias("n")))  # one row
    return rows.select(guide, "activity", F.when(~F.col("__r"), (F.col("ctl_ge") + 1.0) / (F.col("n") + 1.0)).alias("pvalue"))


def combine_stouffer(p: str, weight: Column | None = None) -> tuple[Column, Column]:
    """(sum of w z, sum of w^2) of one-sided p as aggregates; their ratio z = a / sqrt(b)."""
    w = weight if weight is not None else F.lit(1.0)
    z = -S.col_ndtri(F.greatest(F.lit(1e-12), F.least(F.lit(1.0 - 1e-12), F.col(p))))
    return F.sum(w * z), F.sum(w * w)


def combine(df: DataFrame, p: str, by: Sequence[str], method: str = "stouffer", weight: str | None = None, p_values: bool = True) -> DataFrame:
    """(by…, n, statistic[, pvalue]): Stouffer, Fisher or the order statistic r = n // 2 + 1 of one-sided p-values."""
    clipped = F.greatest(F.lit(1e-12), F.least(F.lit(1.0 - 1e-12), F.col(p)))
    if method == "fisher":
        out = df.groupBy(*by).agg(F.count(p).alias("n"), (-2.0 * F.sum(F.log(clipped))).alias("statistic"))
        return out.withColumn("pvalue", S.col_chi2_sf("statistic", F.col("n") * 2)) if p_values else out
    if method == "order":
        r = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last()))
        n = F.count(p).over(Window.partitionBy(*by))
        rows = df.withColumns({"__r": r, "__n": n}).where("__r = floor(__n / 2) + 1 and __n > 0")
        out = rows.select(*by, F.col("__n").alias("n"), F.col(p).alias("statistic"))
        return out.withColumn("pvalue", S.col_binom_sf(F.floor(F.col("n") / 2), "n", "statistic")) if p_values else out
    rows = df.where(F.col(p).isNotNull()).withColumn("__z", -S.col_ndtri(clipped)).withColumn("__w", F.col(weight) if weight else F.lit(1.0))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("__w") * F.col("__z")) / F.sqrt(F.sum(F.col("__w") * F.col("__w")))).alias("statistic"))
    return out.withColumn("pvalue", S.col_norm_sf("statistic")) if p_values else out


def aggregate_guides(df: DataFrame, p: str, gene: str, control: Column, guide: str, method: str = "stouffer", n_null: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(gene, n, statistic, pvalue, qvalue, is_hit): combined guides against null genes drawn from control guides.

    Null genes have the gene's number of guides; the control p-values (one number for each control guide) are collected.
    """
    pool = df.where(control).orderBy(guide).select(p).dropna().toPandas()[p].to_numpy(float)
    stats = combine(df.where(~control), p, [gene], method, p_values=False)

    def draw(n: int) -> np.ndarray:
        rng = np.random.default_rng([seed, n])
        step, out = max(1, 2_000_000 // n), []
        for lo in range(0, n_null, step):  # the same stream of draws, some null genes at a time
            x = rng.choice(terms, (min(step, n_null - lo), n))
            out.append(-np.partition(x, n // 2, 1)[:, n // 2] if method == "order" else x.sum(1))
        return np.concatenate(out) / (np.sqrt(n) if method == "stouffer" else 1.0)

    clipped = np.clip(pool, 1e-12, 1 - 1e-12)
    terms = clipped if method == "order" else -2.0 * np.log(clipped) if method == "fisher" else -S.ndtri(clipped)  # a control guide's part of a null

    @F.pandas_udf("double")
    def p_value(n: pd.Series, stat: pd.Series) -> pd.Series:
        memo = {k: np.sort(draw(int(k))) for k in set(n)}
        sign = -1.0 if method == "order" else 1.0
        return pd.Series([(n_null - np.searchsorted(memo[k], sign * s - 1e-12) + 1.0) / (n_null + 1.0) for k, s in zip(n, stat)], dtype=float)

    sizes = stats.select("n").distinct().count()
    spread = stats.repartition(min(sizes, 4 * df.sparkSession.sparkContext.defaultParallelism), "n") if sizes > 1 else stats  # a size is drawn once, in its task
    out = benjamini_hochberg(spread.withColumn("pvalue", p_value("n", "statistic")), tie=[gene])
    return out.withColumn("qvalue", F.greatest("qvalue", "pvalue")).withColumn("is_hit", F.col("qvalue") <= alpha)


def guide_medians(cells: DataFrame, feature: str, guide: str, gene: str, control: Column) -> DataFrame:
    """(guide, gene, n, median): lower median of the measured cells of each guide that is no control."""
    rows = cells.where(F.col(feature).isNotNull()).where(~control)
    return rows.groupBy(guide, gene).agg(F.count(F.lit(1)).alias("n"), F.expr(f"percentile_disc(0.5) within group (order by `{feature}`)").alias("median"))


def bootstrap_medians(cells: DataFrame, feature: str, guide: str, gene: str, control: Column) -> DataFrame:
    """(guide, gene, n, median, p_up, p_down): exact bootstrap of the lower median, without simulation.

    The chance that the lower median of n draws from a control guide lies above x is a binomial tail of the share of
    its cells above x; the null is the cell-weighted mixture over control guides, ties counting half.
    """
    rows = cells.where(F.col(feature).isNotNull()).withColumn("__c", control)
    med = guide_medians(cells, feature, guide, gene, control)
    marks = med.select(guide, F.col("median").alias(feature)).crossJoin(rows.where("__c").select(F.col(guide).alias("ctl")).distinct())
    ctl = rows.where("__c").select(F.col(guide).alias("ctl"), feature)
    both = ctl.select("ctl", feature, F.lit(None).cast(dict(rows.dtypes)[guide]).alias(guide), F.lit(1).alias("k")).unionByName(marks.select("ctl", feature, guide, F.lit(0).alias("k")))
    part, at = Window.partitionBy("ctl"), Window.partitionBy("ctl", feature)
    le = F.sum("k").over(part.orderBy(feature).rangeBetween(Window.unboundedPreceding, 0))
    counted = both.withColumns({"le": le, "eq": F.sum("k").over(at), "m": F.sum("k").over(part)}).where("k = 0")
    j = counted.join(med, guide)
    # the lower median is order statistic (n - 1) // 2 (from 0): above x iff at most that many draws are <= x
    need = F.floor((F.col("n") - 1) / 2)
    above = 1.0 - S.col_binom_sf(need, "n", F.col("le") / F.col("m"))
    at_least = 1.0 - S.col_binom_sf(need, "n", (F.col("le") - F.col("eq")) / F.col("m"))
    j = j.withColumns({"__up": above, "__ge": at_least})
    out = j.groupBy(guide, gene, "n", "median").agg((F.sum((F.col("__up") + F.col("__ge")) / 2.0 * F.col("m")) / F.sum("m")).alias("p_up"))
    return out.withColumn("p_down", 1.0 - F.col("p_up"))


def bootstrap_genes(guides: DataFrame, gene: str) -> DataFrame:
    """(gene, n_guides, effect, pvalue, qvalue): both directions combined with weight sqrt(n), the better one doubled."""
    clip = lambda c: F.greatest(F.lit(1e-12), F.least(F.lit(1.0 - 1e-12), c))
    rows = guides.withColumns({"__zu": -S.col_ndtri(clip(F.col("p_up"))), "__zd": -S.col_ndtri(clip(F.col("p_down"))), "__w": F.sqrt("n")})
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")))
    out = rows.groupBy(gene).agg(
        F.count(F.lit(1)).alias("n_guides"), (F.sum(F.col("__w") * F.col("__zu")) / norm).alias("zu"), (F.sum(F.col("__w") * F.col("__zd")) / norm).alias("zd"),
        (F.sum(F.when(F.col("p_up") < 0.5, F.col("__w") * F.col("median"))) / F.sum(F.when(F.col("p_up") < 0.5, F.col("__w")))).alias("eu"),
        (F.sum(F.when(F.col("p_up") >= 0.5, F.col("__w") * F.col("median"))) / F.sum(F.when(F.col("p_up") >= 0.5, F.col("__w")))).alias("ed"),
    )
    up = F.col("zu") >= F.col("zd")
    out = out.withColumn("pvalue", F.least(F.lit(1.0), 2.0 * S.col_norm_sf(F.greatest("zu", "zd")))).withColumn("effect", F.when(up, F.col("eu")).otherwise(F.col("ed")))
    return benjamini_hochberg(out.select(gene, "n_guides", "effect", "pvalue"), tie=[gene])


def guide_qc(guides: DataFrame, gene: str, guide: str, p: str, z: str, n_cells: str, alpha: float = 0.05, min_cells: int = 10) -> DataFrame:
    """(guide, gene, inactive, thin, outlying_p): inactive if p >= alpha while one and half of the siblings are below;
    outlying by the leave-one-out residual of z / sqrt(n) in genes of three guides or more."""
    part = Window.partitionBy(gene)
    sig = F.coalesce((F.col(p) < alpha).cast("long"), F.lit(0))
    rows = guides.withColumns({"k": F.count(F.lit(1)).over(part), "s": F.sum(sig).over(part)})
    sib, others = F.col("s") - sig, F.col("k") - 1
    inactive = F.coalesce((F.col(p) >= alpha) & (sib >= 1) & (sib * 2 >= others), F.lit(False))
    n = F.col(n_cells).cast("double")
    # leave-one-out mean of effects z / sqrt(n) weighted by n, residual in units of its sd
    total_w, total = F.sum(n).over(part), F.sum(F.sqrt(n) * F.col(z)).over(part)
    rest_w, rest = total_w - n, total - F.sqrt(n) * F.col(z)
    residual = (F.col(z) / F.sqrt(n) - rest / F.when(rest_w > 0, rest_w)) / F.sqrt(1.0 / n + 1.0 / F.when(rest_w > 0, rest_w))
    rows = rows.withColumns({"inactive": inactive, "thin": F.col(n_cells) < min_cells, "residual": F.when(F.col("k") >= 3, F.abs(residual))})
    return rows.withColumn("outlying_p", 2.0 * S.col_norm_sf("residual")).select(guide, gene, "inactive", "thin", "residual", "outlying_p")


def guide_summary(guides: DataFrame, gene: str, p: str, z: str, n_cells: str, alpha: float = 0.05, p_values: bool = True) -> DataFrame:
    """(gene, n_guides, n_significant, q, df, i2[, het_p], single_guide): agreement of a gene's guides."""
    n = F.col(n_cells).cast("double")
    out = guides.groupBy(gene).agg(
        F.count(F.lit(1)).alias("n_guides"), F.count(F.when(F.col(p) < alpha, 1)).alias("n_significant"), (F.sum(F.col(z) * F.col(z)) - F.pow(F.sum(F.sqrt(n) * F.col(z)), F.lit(2.0)) / F.sum(n)).alias("q")
    )
    out = out.withColumn("df", F.col("n_guides") - 1).withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("q"))).otherwise(0.0))
    out = out.withColumn("single_guide", F.col("n_guides") == 1)
    return out.withColumn("het_p", F.when(F.col("df") > 0, S.col_chi2_sf("q", F.when(F.col("df") > 0, F.col("df"))))) if p_values else out


def cytotoxicity(df: DataFrame, group: str, viability: str, distance: str, control: Column, min_viability: float = 0.7) -> DataFrame:
    """(group, viability, distance, suspect): few cells and further away than the median control."""
    cut = df.where(control).agg(F.median(distance).alias("cut"))
    out = df.where(~control).groupBy(F.col(group).alias("group")).agg(F.median(viability).alias("viability"), F.median(distance).alias("distance")).crossJoin(cut)
    return out.select("group", "viability", "distance", ((F.col("viability") < min_viability) & (F.col("distance") > F.col("cut"))).alias("suspect"))


def transport(df: DataFrame, features: Sequence[str], setting: str, group: str, control: Column, min_shared: int = 3, weighted: bool = True, p_values: bool = True) -> DataFrame:
    """(group, agreement, n_settings, pvalue): effects that hold in other settings.

    Effect: group median less control median in each setting. Agreement: mean correlation over pairs of settings,
    weighted by the smaller effect norm. The null is every mismatched pair of groups, not a sample.
    """
    from platewise.operators.aggregate import array_corr

    feats = list(features)
    ctl = df.where(control).groupBy(setting).agg(*[F.median(f).alias(f"{f}__c") for f in feats])
    trt = df.where(~control).groupBy(setting, F.col(group).alias("group")).agg(*[F.median(f).alias(f) for f in feats])
    eff = join_fit(trt, ctl, [setting], "inner").select(F.col(setting).alias("s"), "group", F.array(*[F.coalesce(F.col(f) - F.col(f"{f}__c"), F.lit(0.0)) for f in feats]).alias("v"))
    eff = eff.withColumn("norm", F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)))
    o = eff.select(F.col("s").alias("s2"), F.col("group").alias("g2"), F.col("v").alias("w"), F.col("norm").alias("norm2"))
    pairs = eff.join(o, (F.col("s") < F.col("s2"))).withColumn("r", array_corr(F.col("v"), F.col("w"))).where("r is not null")
    w = F.least("norm", "norm2") if weighted else F.lit(1.0)
    obs = pairs.where("group = g2").groupBy("group").agg((F.sum(w * F.col("r")) / F.sum(w)).alias("agreement"), F.count(F.lit(1)).alias("n_pairs")).where(F.col("n_pairs") >= max(1, min_shared * (min_shared - 1) // 2))
    if not p_values:
        return obs
    null = pairs.where("group <> g2").select(F.col("r").alias("v"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("group"))
    both = null.unionByName(obs.select(F.col("agreement").alias("v"), F.lit(1).alias("k"), F.col("group").cast("string").alias("group")))
    ge = F.sum(1 - F.col("k")).over(Window.orderBy(F.desc("v")).rangeBetween(Window.unboundedPreceding, 0))
    n = F.sum(1 - F.col("k")).over(Window.partitionBy())
    p = both.withColumns({"ge": ge, "n": n}).where("k = 1").select("group", ((F.col("ge") + 1.0) / (F.col("n") + 1.0)).alias("pvalue"))
    return benjamini_hochberg(obs.withColumn("group", F.col("group").cast("string")).join(p, "group"), tie=["group"])


def roc_auc(df: DataFrame, score: str, label: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by…, auc): rank formula with ties at their mean."""
    ranked = df.withColumns({"__l": label, "__r": average_rank(score, list(by))})
    agg = ranked.groupBy(*by).agg(F.sum(F.when(F.col("__l"), F.col("__r"))).alias("s"), F.count(F.when(F.col("__l"), 1)).alias("p"), F.count(F.when(~F.col("__l"), 1)).alias("n"))
    return agg.select(*by, ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("p") * F.col("n"))).alias("auc"))


def replicate_saturation(df: DataFrame, features: Sequence[str], group: str, row_id: str, max_replicates: int = 10, n_draws: int = 5, min_groups: int = 3, seed: int = 0) -> DataFrame:
    """(replicates, score, n_groups): correlation of the median profiles of two random halves, by half size."""
    feats = list(features)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(row_id)[feats].to_numpy(float)
        rng, rows = np.random.default_rng([seed, *str(pdf[group].iloc[0]).encode()]), []
        for k in range(1, min(max_replicates, len(x) // 2) + 1):
            r = []
            for _ in range(n_draws):
                o = rng.permutation(len(x))
                a, b = np.nanmedian(x[o[:k]], 0), np.nanmedian(x[o[k : 2 * k]], 0)
                r.append(np.corrcoef(a, b)[0, 1] if a.std() > 0 and b.std() > 0 else np.nan)
            rows.append((str(pdf[group].iloc[0]), k, float(np.nanmean(r)) if not np.isnan(r).all() else np.nan))
        return pd.DataFrame(rows, columns=["group", "replicates", "r"])

    each = df.groupBy(group).applyInPandas(run, "group string, replicates int, r double")
    out = each.where("r is not null and not isnan(r)").groupBy("replicates").agg(F.avg("r").alias("score"), F.count(F.lit(1)).alias("n_groups"))
    return out.where(F.col("n_groups") >= min_groups)
