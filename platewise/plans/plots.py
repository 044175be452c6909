"""The tables behind the plots: what a drawing needs, computed by Spark. Importing this module registers its queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators import aggregate as A
from platewise.operators import dose as D
from platewise.operators import effects as E
from platewise.operators import enrich as N
from platewise.operators import metrics as M
from platewise.operators import pairs as P
from platewise.operators import qc as Q
from platewise.operators import select as S
from platewise.operators import stats as ST
from platewise.plans import data as T
from platewise.plans.data import FEATURES
from platewise.plans.queries import PAIRS, SQL, WC, WD, WP, WW, LONG, query, rsql


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by…, bin, n): counts over even bins; values outside go to the first or last."""
    width = (high - low) / bins
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - low) / width))).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, flags: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Share of true flags in each group."""
    return df.groupBy(*by).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags])


def wide(df: DataFrame, row: str, col: str, value: Column, levels: Sequence | None = None) -> DataFrame:
    """Pivot of one value; the levels are read if not given."""
    g = df.groupBy(row)
    return (g.pivot(col, list(levels)) if levels else g.pivot(col)).agg(value)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def plate_layout(df: DataFrame, plate: str, row: str, col: str, value: str) -> DataFrame:
    return df.groupBy(plate, row, col).agg(F.median(value).alias("value"), F.count(F.lit(1)).alias("n"))


def minus_log10(p: str) -> Column:
    return -F.log10(F.greatest(F.col(p), F.lit(1e-300)))


# ---------------------------------------------------------------- queries


@query("pl_batch_variance", rsql("SELECT feature, r2, variance FROM r", "r2 variance", prefix=f"{WC}, l AS (SELECT plate, unnest(['q','d','t']) AS feature, unnest([q,d,t]) AS value FROM cells), e AS (SELECT feature, plate, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM l WHERE value IS NOT NULL GROUP BY feature, plate), s AS (SELECT feature, sum(n) AS nn, sum(n * v) AS w, sum(n * m) AS s1, sum(n * m * m) AS s2 FROM e GROUP BY feature), r AS (SELECT feature, (s2 - s1 * s1 / nn) / (s2 - s1 * s1 / nn + w) AS r2, (s2 - s1 * s1 / nn + w) / (nn - 1) AS variance FROM s)"))
def pl_batch_variance(spark, sf):
    return M.anova_r2(T.cells(spark, sf), ["q", "d", "t"], "plate")


@query("pl_cell_counts", f"{WW} SELECT plate, CAST(sum(n) AS BIGINT) AS cells, count(*) AS wells FROM wells GROUP BY plate")
def pl_cell_counts(spark, sf):
    return T.wells(spark, sf).groupBy("plate").agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("wells"))


@query("pl_density", f"{WP} SELECT grp, CAST(least(19, greatest(0, floor(value / 5.0))) AS INTEGER) AS bin, count(*) AS n FROM pop WHERE value IS NOT NULL GROUP BY 1, 2")
def pl_density(spark, sf):
    return histogram(T.populations(spark, sf), "value", 0.0, 100.0, 20, ["grp"])


@query("pl_feature_distributions", f"{WC} SELECT plate, CAST(least(9, greatest(0, floor(q / 5.0))) AS INTEGER) AS bin, count(*) AS n FROM cells WHERE q IS NOT NULL GROUP BY 1, 2")
def pl_feature_distributions(spark, sf):
    return histogram(T.cells(spark, sf), "q", 0.0, 50.0, 10, ["plate"])


_PHASE = "CASE WHEN q < 20 THEN '2N' WHEN q < 35 THEN 'S' WHEN q IS NOT NULL THEN '4N' END"


@query("pl_cell_cycle", f"{WC} SELECT pert, {_PHASE} AS phase, CAST(least(24, greatest(0, floor(q / 2.0))) AS INTEGER) AS bin, count(*) AS n FROM cells WHERE q IS NOT NULL GROUP BY 1, 2, 3")
def pl_cell_cycle(spark, sf):
    return histogram(T.cells(spark, sf).withColumn("phase", F.expr(_PHASE)), "q", 0.0, 50.0, 25, ["pert", "phase"])


@query("pl_cell_cycle_occupancy", rsql(f"SELECT pert, phase, n / sum(n) OVER (PARTITION BY pert) AS share FROM (SELECT pert, {_PHASE} AS phase, count(*) AS n FROM cells WHERE q IS NOT NULL GROUP BY 1, 2)", "share", prefix=WC))
def pl_occupancy(spark, sf):
    c = T.cells(spark, sf).where("q is not null").groupBy("pert", F.expr(_PHASE).alias("phase")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("pert", "phase", (F.col("n") / F.sum("n").over(Window.partitionBy("pert"))).alias("share"))


@query("pl_cell_cycle_clock", f"{WC} SELECT phase, CAST(floor(position * 12) AS INTEGER) AS slot, count(*) AS n FROM (SELECT {_PHASE} AS phase, percent_rank() OVER (PARTITION BY {_PHASE} ORDER BY p) * 0.999 AS position FROM cells WHERE q IS NOT NULL) GROUP BY 1, 2")
def pl_clock(spark, sf):
    c = N.phase_order(T.cells(spark, sf).where("q is not null").withColumn("phase", F.expr(_PHASE)), "phase", "p")
    return c.groupBy("phase", F.floor(F.col("phase_order") * 0.999 * 12).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query("pl_cluster_composition", rsql("SELECT grp, cluster, avg(f) AS fraction FROM (SELECT u.grp, u.usr, c.cluster, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY u.usr) AS f FROM (SELECT DISTINCT grp, \"user\" AS usr FROM pop) u CROSS JOIN (SELECT DISTINCT cluster FROM pop) c LEFT JOIN (SELECT \"user\" AS usr, cluster, count(*) AS n FROM pop GROUP BY 1, 2) k ON k.usr = u.usr AND k.cluster = c.cluster) GROUP BY grp, cluster", "fraction", prefix=WP))
def pl_cluster_composition(spark, sf):
    comp = A.cluster_composition(T.populations(spark, sf), "cluster", ["grp", "user"])
    return comp.groupBy("grp", "cluster").agg(F.avg("fraction").alias("fraction"))


@query("pl_control_drift")
def pl_control_drift(spark, sf):
    from platewise.operators.batch import pca

    w = T.wells(spark, sf).dropna().withColumns({"p": F.col("p") / 10000, "d": F.col("d") * 100, "t": F.col("t") * 100})
    scores, _, _ = pca(w, FEATURES, 2, F.col("control"))
    return scores.where("control").select("plate", "well", "pc1", "pc2")


@query("pl_dendrogram")
def pl_dendrogram(spark, sf):
    w = A.consensus_median(T.wells(spark, sf), FEATURES, ["well", "pert"]).withColumn("id", F.concat("well", "pert"))
    _, z = M.cluster(w, "id", FEATURES)
    return spark.createDataFrame([(int(a), int(b), float(h), int(n)) for a, b, h, n in z], "a long, b long, height double, size long")


@query("pl_distance_heatmap", rsql("SELECT a.label AS group_a, b.label AS group_b, avg(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS mean_sq FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.label <= b.label GROUP BY 1, 2", "mean_sq", prefix=f"WITH e AS ({T.EMBEDDED})"))
def pl_distance_heatmap(spark, sf):
    return E.mean_square_distances(T.embedded(spark, sf), "v", "label").withColumnRenamed("m", "mean_sq")


@query("pl_dose_response", rsql("SELECT compound, dose, avg(f2) AS response, count(*) AS n FROM doses WHERE dose > 0 GROUP BY compound, dose", "response", prefix=WD))
def pl_dose_response(spark, sf):
    d = D.usable(T.doses(spark, sf), "compound", "dose", 1)
    return d.groupBy("compound", "dose").agg(F.avg("f2").alias("response"), F.count(F.lit(1)).alias("n"))


@query("pl_dose_response_curve")
def pl_dose_curve(spark, sf):
    fit = D.dose_response(T.doses(spark, sf), "compound", "dose", "f2")
    at = fit.where("r_squared is not null and not isnan(r_squared)").select("compound", "bottom", "top", "ec50", "slope", F.explode(F.array(*[F.lit(float(x)) for x in (1, 2, 4, 8)])).alias("dose"))
    return at.select("compound", "dose", (F.col("bottom") + (F.col("top") - F.col("bottom")) / (1.0 + F.pow(F.lit(10.0), F.greatest(F.lit(-60.0), F.least(F.lit(60.0), (F.log10("ec50") - F.log10("dose")) * F.col("slope")))))).alias("fitted"))


@query("pl_dose_direction")
def pl_dose_direction(spark, sf):
    return D.dose_direction(T.doses(spark, sf), T.DOSE_FEATURES, "compound", "dose", F.col("control")).select("compound", "dose", "amplitude", "cosine_to_top")


_EFFECT = f"e AS (SELECT pert AS grp, feature, avg(value) - (SELECT avg(value) FROM ({LONG}) c WHERE c.control AND c.feature = l.feature) AS effect FROM ({LONG}) l WHERE NOT control GROUP BY pert, feature)"


def _effects(spark, sf):
    long = ST.to_long(T.cells(spark, sf), ["pert", "control"], FEATURES)
    ctl = long.where("control").groupBy("feature").agg(F.avg("value").alias("c"))
    trt = long.where("not control").groupBy(F.col("pert").alias("grp"), "feature").agg(F.avg("value").alias("m"))
    return ST.join_fit(trt, ctl, ["feature"]).select("grp", "feature", (F.col("m") - F.col("c")).alias("effect"))


@query("pl_effect_sizes", rsql("SELECT grp, feature, effect, rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(effect) DESC, feature) AS rank FROM e) WHERE rank <= 2", "effect", 4, f"{WC}, {_EFFECT}"), 4)
def pl_effect_sizes(spark, sf):
    return top_k(_effects(spark, sf), ["grp"], [F.abs("effect").desc(), F.col("feature")], 2).withColumn("rank", F.col("rank").cast("long"))


@query("pl_feature_volcano")
def pl_volcano(spark, sf):
    mw = E.mann_whitney(T.wells(spark, sf), FEATURES, "pert", F.col("control"), "id")
    return mw.select("group", "feature", (2.0 * F.col("u") / (F.col("n1") * F.col("n2")) - 1.0).alias("effect"), minus_log10("pvalue").alias("minus_log10_p"))


@query("pl_hits")
def pl_hits(spark, sf):
    ed = E.edistance(T.embedded(spark, sf), "vec_id", "v", "label", F.col("control"), 50)
    return ed.select("group", "distance", minus_log10("qvalue").alias("minus_log10_q"))


@query("pl_feature_correlation", rsql(" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM cells" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]), "r", prefix=WC))
def pl_feature_correlation(spark, sf):
    return S.correlated_pairs(T.cells(spark, sf), FEATURES)


@query("pl_feature_groups", "SELECT feature_group, channel, n FROM (VALUES ('Intensity', 'DNA', 1), ('Texture', 'ER', 1), ('RadialDistribution', 'Mito', 1), ('Correlation', 'DNA|AGP', 1), ('AreaShape', NULL, 1), ('Location', NULL, 1), (NULL, NULL, 1)) v(feature_group, channel, k), (SELECT CAST(1 AS BIGINT) AS n)")
def pl_feature_groups(spark, sf):
    from platewise.functions.wells import parse_feature_names
    from platewise.plans.queries import _FEATURE_NAMES

    return parse_feature_names(spark, _FEATURE_NAMES).groupBy("feature_group", "channel").agg(F.count(F.lit(1)).alias("n"))


@query("pl_feature_signature", rsql("SELECT grp, avg(effect) FILTER (feature = 'q') AS amount, avg(effect) FILTER (feature IN ('d', 't')) AS rate FROM e GROUP BY grp", "amount rate", prefix=f"{WC}, {_EFFECT}"))
def pl_signature(spark, sf):
    fam = spark.createDataFrame([("q", "amount"), ("d", "rate"), ("t", "rate")], "feature string, family string")
    return A.feature_signature(_effects(spark, sf), fam, "grp", "effect", levels=["amount", "rate"])


@query("pl_image_qc", f"{WW}, s AS (SELECT plate, median(p) AS m FROM wells GROUP BY plate), k AS (SELECT w.plate, any_value(m) AS m, median(abs(p - m)) AS d FROM wells w JOIN s USING (plate) GROUP BY w.plate) SELECT plate, count(*) AS images, count(*) FILTER (abs((p - m) / (k.d * 1.4826)) > 3) AS failed FROM wells JOIN k USING (plate) GROUP BY plate")
def pl_image_qc(spark, sf):
    i = Q.image_qc_mad(T.wells(spark, sf), ["p"], ["plate"], 3.0)
    return i.groupBy("plate").agg(F.count(F.lit(1)).alias("images"), F.count(F.when(F.col("qc_image_fail"), 1)).alias("failed"))


def _ap(spark, sf):
    p = P.similarity_pairs(T.embedded(spark, sf), "vec_id", "v", keep=["label"], ordered=True)
    return P.average_precision(P.map_pairs(p, ["label"], [], [], ["label"]))


@query("pl_map", digits=6)
def pl_map(spark, sf):
    e = T.embedded(spark, sf).select(F.col("vec_id").alias("i"), "label")
    s = P.map_null_pvalues(_ap(spark, sf), e, "label", 200)
    top = s.orderBy(F.desc("score"), "label").limit(5).select(F.col("label").alias("__top"))
    return s.join(top, F.col("label") == F.col("__top"), "left").select("label", "score", minus_log10("qvalue").alias("minus_log10_q"), F.col("__top").isNotNull().alias("named"))


@query("pl_metrics")
def pl_metrics(spark, sf):
    rows = spark.createDataFrame([("raw", "bio", 0.4), ("raw", "batch", 0.5), ("corrected", "bio", 0.6), ("corrected", "batch", 0.8)], "rep string, metric string, value double")
    return wide(rows, "rep", "metric", F.first("value"), ["bio", "batch"])


_NN1 = "nn AS (SELECT i, label_i AS actual, label_j AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM pairs) WHERE r = 1)"


@query("pl_moa_confusion", f"{PAIRS}, {_NN1} SELECT actual, " + ", ".join(f"count(*) FILTER (predicted = {k}) AS p{k}" for k in range(10)) + " FROM nn GROUP BY actual")
def pl_moa_confusion(spark, sf):
    p = P.similarity_pairs(T.embedded(spark, sf), "vec_id", "v", keep=["label"], ordered=True)
    calls = P.nn_moa(p, "label")
    return calls.groupBy("actual").agg(*[F.count(F.when(F.col("predicted") == k, 1)).alias(f"p{k}") for k in range(10)])


@query("pl_moa_enrichment")
def pl_moa_enrichment(spark, sf):
    p = P.similarity_pairs(T.embedded(spark, sf), "vec_id", "v", keep=["label"], ordered=True)
    m = P.moa_enrichment(p, "label", 10)
    return wide(m, "i", "moa", F.max(minus_log10("qvalue")), list(range(10)))


@query("pl_nan_matrix", rsql(f"SELECT plate, {', '.join(f'avg(({f} IS NULL)::INT) AS {f}' for f in FEATURES)} FROM cells GROUP BY plate", "q p d t", prefix=WC))
def pl_nan_matrix(spark, sf):
    c = T.cells(spark, sf)
    return shares(c.select("plate", *[F.col(f).isNull().alias(f) for f in FEATURES]), FEATURES, ["plate"])


@query("pl_outliers", rsql("SELECT plate, avg((q > 45)::INT) AS is_outlier FROM cells WHERE q IS NOT NULL GROUP BY plate", "is_outlier", prefix=WC))
def pl_outliers(spark, sf):
    s = T.cells(spark, sf).where("q is not null").withColumn("outlier_score", F.col("q"))
    return shares(Q.flag_outliers(s, "row_id", cutoff=45.0), ["is_outlier"], ["plate"])


@query("pl_plate", rsql("SELECT plate, CAST(ascii(well) - 65 AS INTEGER) AS r, CAST(substr(well, 2) AS INTEGER) - 1 AS c, median(p) AS value, count(*) AS n FROM cells GROUP BY 1, 2, 3", "value", prefix=WC))
def pl_plate(spark, sf):
    from platewise.functions.wells import well_col, well_row

    c = T.cells(spark, sf).withColumns({"r": well_row(F.col("well")), "c": well_col(F.col("well"))})
    return plate_layout(c, "plate", "r", "c", "p")


@query("pl_plate_effects", rsql("SELECT plate, 'row' AS axis, CAST(ascii(well) - 65 AS INTEGER) AS k, median(p) AS value FROM cells GROUP BY 1, 2, 3 UNION ALL SELECT plate, 'col', CAST(substr(well, 2) AS INTEGER) - 1, median(p) FROM cells GROUP BY 1, 2, 3", "value", prefix=WC))
def pl_plate_effects(spark, sf):
    from platewise.functions.wells import well_col, well_row

    c = T.cells(spark, sf)
    return c.groupBy("plate", F.lit("row").alias("axis"), well_row(F.col("well")).alias("k")).agg(F.median("p").alias("value")).unionByName(c.groupBy("plate", F.lit("col").alias("axis"), well_col(F.col("well")).alias("k")).agg(F.median("p").alias("value")))


@query("pl_qc", rsql("SELECT plate, avg((q IS NULL)::INT) AS missing, avg((d > 0.08)::INT) AS high FROM cells GROUP BY plate", "missing high", prefix=WC))
def pl_qc(spark, sf):
    c = T.cells(spark, sf).select("plate", F.col("q").isNull().alias("missing"), (F.col("d") > 0.08).alias("high"))
    return shares(c, ["missing", "high"], ["plate"])


@query("pl_replicate_correlation", rsql("SELECT label_i AS label, median(sim) AS observed FROM pairs WHERE i < j AND label_i = label_j GROUP BY label_i", "observed", prefix=PAIRS))
def pl_replicate_correlation(spark, sf):
    return P.replicate_medians(T.embedded(spark, sf), "vec_id", "v", "label").select(F.col("group").alias("label"), F.col("median").alias("observed"))


@query("pl_similarity", rsql("SELECT label_i, label_j, avg(sim) AS sim FROM pairs WHERE i < j GROUP BY label_i, label_j", "sim", prefix=PAIRS))
def pl_similarity(spark, sf):
    return P.class_similarities(T.embedded(spark, sf), "vec_id", "v", "label")


@query("pl_setting_agreement")
def pl_setting_agreement(spark, sf):
    c = T.cells(spark, sf).withColumns({"p": F.col("p") / 10000, "d": F.col("d") * 100, "t": F.col("t") * 100})
    med = c.groupBy("plate", "well").agg(F.array(*[F.median(f) for f in FEATURES]).alias("v"))
    o = med.select(F.col("plate").alias("other"), "well", F.col("v").alias("w"))
    pairs = med.join(o, "well").where("plate < other").withColumn("r", A.array_corr(F.col("v"), F.col("w")))
    return wide(pairs, "plate", "other", F.avg("r"), [f"P{k}" for k in range(2, 8)])


@query("pl_sets_heatmap", rsql('SELECT p_brand AS "group", avg(p_retailprice) FILTER (p_size % 2 = 0) AS even, avg(p_retailprice) FILTER (p_size % 2 = 1) AS odd FROM part GROUP BY p_brand', "even odd", 5), 5)
def pl_sets_heatmap(spark, sf):
    p = T.read(spark, sf, "part").select(F.col("p_brand").alias("group"), F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("source"), F.col("p_retailprice").alias("score"))
    return wide(p, "group", "source", F.avg("score"), ["even", "odd"])


@query("pl_subpopulation_hits")
def pl_subpopulation(spark, sf):
    h = N.subpopulation_hits(T.populations(spark, sf), ["value"], "cluster", "grp", F.col("control"), F.col("half"))
    return wide(h, "cluster", "group", F.first("ks"), [1, 2, 3, 4, 5])


@query("pl_cytotoxicity", rsql('SELECT pert AS "group", median(n) AS viability, median(d) AS distance FROM wells WHERE NOT control GROUP BY pert', "viability distance", prefix=WW))
def pl_cytotoxicity(spark, sf):
    w = T.wells(spark, sf).withColumn("v", F.col("n").cast("double"))
    return E.cytotoxicity(w, "pert", "v", "d", F.col("control")).drop("suspect")


@query("pl_pathway_coherence")
def pl_pathway(spark, sf):
    e = T.embedded(spark, sf)
    p = P.similarity_pairs(e, "vec_id", "v").withColumns({"g_i": F.col("i"), "g_j": F.col("j")})
    sets = e.select(F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("source"), F.col("vec_id").alias("target"))
    return P.pathway_coherence(p, sets, "g").orderBy("source")


@query("pl_replicate_saturation")
def pl_saturation(spark, sf):
    e = T.embedded(spark, sf).select("vec_id", "label", *[F.col("v")[i].alias(f"x{i}") for i in range(8)])
    return E.replicate_saturation(e, [f"x{i}" for i in range(8)], "label", "vec_id", 5)


@query("pl_transport")
def pl_transport(spark, sf):
    c = T.cells(spark, sf).withColumns({"p": F.col("p") / 10000, "d": F.col("d") * 100, "t": F.col("t") * 100})
    return E.transport(c, FEATURES, "plate", "well", F.col("control")).select("group", "agreement", "qvalue")


__all__ = ["SQL", "histogram", "minus_log10", "plate_layout", "shares", "top_k", "wide"]
