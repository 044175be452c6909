"""Queries of the library's operators, each with the SQL that says the same where SQL can."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions import wells as W
from platewise.operators import aggregate as A
from platewise.operators import bootstrap as B
from platewise.operators import dose as D
from platewise.operators import effects as E
from platewise.operators import gram as G
from platewise.operators import harmony as H
from platewise.operators import enrich as N
from platewise.operators import metrics as M
from platewise.operators import normalize as Z
from platewise.operators import nulls as NU
from platewise.operators import pairs as P
from platewise.operators import perturbation as PS
from platewise.operators import qc as Q
from platewise.operators import quantiles as QU
from platewise.operators import reference as REF
from platewise.operators import select as S
from platewise.operators import stats as ST
from platewise.operators import tiles as TI
from platewise.plans import data as T
from platewise.plans.data import CELLS, DOSES, EMBEDDED, FEATURES, GUIDES, PAIRS, POPULATIONS, WELLS
from platewise.sources import profiles as SRC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; doubles are rounded on both sides."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: T.rounded(f(spark, sf_dir), digits)
        if sql:
            SQL[name] = sql
        return f

    return add


def rsql(body: str, cols: str, digits: int = 6, prefix: str = "") -> str:
    """SQL with the named columns rounded like the query's."""
    rep = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols.split())
    return f"{prefix} SELECT * REPLACE ({rep}) FROM ({body})" if cols else f"{prefix} {body}"


WC = f"WITH cells AS ({CELLS})"
WW = f"WITH wells AS ({WELLS})"
WD = f"WITH doses AS ({DOSES})"
WG = f"WITH guides AS ({GUIDES})"
WP = f"WITH pop AS ({POPULATIONS})"
LONG = "SELECT row_id, plate, well, pert, control, supp, unnest(['q','p','d','t']) AS feature, unnest([q,p,d,t]) AS value FROM cells"


def each(template: str, names=FEATURES, sep: str = ", ") -> str:
    return sep.join(template.replace("@", f) for f in names)


# ---------------------------------------------------------------- normalisation

FIT_MAD = f"""
med AS (SELECT plate, {each("median(@) AS @_c")} FROM cells WHERE control GROUP BY plate),
fit AS (SELECT c.plate, {each("any_value(m.@_c) AS @_c")}, {each("1.4826::DOUBLE * median(abs(c.@ - m.@_c)) AS @_s")}
        FROM cells c JOIN med m USING (plate) WHERE c.control GROUP BY c.plate)
"""
NORM = "(c.@ - f.@_c) / CASE WHEN f.@_s > 1e-18 THEN f.@_s + 1e-18 END AS @"


@query("normalize_aggregate", rsql(f"SELECT plate, pert, count(*) AS Metadata_CellCount, {each('median(@) AS @')} FROM (SELECT c.plate, c.pert, {each(NORM)} FROM cells c JOIN fit f USING (plate)) GROUP BY plate, pert HAVING count(*) >= 10", "q p d t", prefix=f"{WC}, {FIT_MAD}"))
def normalize_aggregate(spark, sf):
    """Flagship: robust z against the controls of each plate, then medians of plates and treatments."""
    z = Z.normalize(T.cells(spark, sf), FEATURES, ["plate"], F.col("control"), check=False)
    return A.aggregate(z, FEATURES, ["plate", "pert"])


@query("normalize_mad_robustize", rsql(f"SELECT c.row_id, c.plate, {each(NORM)} FROM cells c JOIN fit f USING (plate)", "q p d t", prefix=f"{WC}, {FIT_MAD}"))
def normalize_mad(spark, sf):
    return Z.normalize(T.cells(spark, sf), FEATURES, ["plate"], F.col("control"), check=False).select("row_id", "plate", *FEATURES)


def _norm_sql(center: str, spread: str) -> str:
    fit = f"fit AS (SELECT plate, {each(center + ' AS @_c')}, {each(spread + ' AS @_s')} FROM cells WHERE control GROUP BY plate)"
    return rsql(f"SELECT c.row_id, {each('(c.@ - f.@_c) / CASE WHEN f.@_s > 1e-18 THEN f.@_s END AS @')} FROM cells c JOIN fit f USING (plate)", "q p d t", prefix=f"{WC}, {fit}")


for _m, _c, _s in (("standardize", "avg(@)", "stddev_pop(@)"), ("robustize", "median(@)", "(quantile_cont(@, 0.75) - quantile_cont(@, 0.25))"), ("center", "median(@)", "1.0::DOUBLE")):
    query(f"normalize_{_m}", _norm_sql(_c, _s))(lambda spark, sf, m=_m: Z.normalize(T.cells(spark, sf), FEATURES, ["plate"], F.col("control"), m, check=False).select("row_id", *FEATURES))


@query("erased_treatments", f"{WC} SELECT max(k) <= 1 AND count(DISTINCT sole) > 1 AS erased, max(k) AS max_within, count(DISTINCT sole) AS levels FROM (SELECT plate, count(DISTINCT pert) AS k, min(pert) AS sole FROM cells GROUP BY plate)")
def erased(spark, sf):
    return Z.erased_treatments(T.cells(spark, sf), ["plate"], "pert")


@query("rank_int_quantile", rsql("SELECT row_id, CASE WHEN q IS NOT NULL THEN (rank() OVER (PARTITION BY plate, q IS NULL ORDER BY q) + (count(*) OVER (PARTITION BY plate, q) - 1) / 2.0 - 0.375) / (count(*) OVER (PARTITION BY plate, q IS NULL) - 2 * 0.375 + 1) END AS quantile FROM cells", "quantile", prefix=WC))
def rank_int_quantile(spark, sf):
    return Z.rank_int_quantile(T.cells(spark, sf), "q", ["plate"]).select("row_id", "quantile")


@query("rank_int")
def rank_int(spark, sf):
    return Z.rank_int(T.cells(spark, sf), ["q"], ["plate"], "row_id").select("row_id", "q")


@query("impute_reference_median", rsql("SELECT c.row_id, coalesce(c.q, m.m) AS q FROM cells c LEFT JOIN (SELECT plate, median(q) AS m FROM cells WHERE control GROUP BY plate) m USING (plate)", "q", prefix=WC))
def impute_median(spark, sf):
    return Z.impute(T.cells(spark, sf), ["q"], ["plate"], F.col("control")).select("row_id", "q")


@query("impute_zero", f"{WC} SELECT row_id, coalesce(q, 0.0) + 0.0 AS q FROM cells")
def impute_zero(spark, sf):
    return Z.impute(T.cells(spark, sf), ["q"], method="zero").select("row_id", "q")


@query("impute_knn")
def impute_knn(spark, sf):
    return Z.impute(T.cells(spark, sf), FEATURES, ["plate"], F.col("control"), "knn", row_id="row_id").select("row_id", "q")


# ---------------------------------------------------------------- grouped statistics

_STATS = {"mean": "avg(@)", "median": "median(@)", "std": "stddev_pop(@)", "lower_median": "quantile_disc(@, 0.5)", "iqr": "quantile_cont(@, 0.75) - quantile_cont(@, 0.25)"}
for _n, _x in _STATS.items():
    query(f"grouped_{_n}", rsql(f"SELECT plate, pert, {each(_x + ' AS @')} FROM cells GROUP BY plate, pert", "q p d t", prefix=WC))(lambda spark, sf, n=_n: ST.grouped_stat(T.cells(spark, sf), ["plate", "pert"], FEATURES, n))


@query("grouped_quantile", rsql(f"SELECT plate, {each('quantile_cont(@, 0.9) AS @')} FROM cells GROUP BY plate", "q p d t", prefix=WC))
def grouped_quantile(spark, sf):
    return ST.grouped_stat(T.cells(spark, sf), ["plate"], FEATURES, "quantile", 0.9)


@query("grouped_mad", rsql(f"SELECT c.plate, {each('median(abs(c.@ - m.@)) AS @')} FROM cells c JOIN (SELECT plate, {each('median(@) AS @')} FROM cells GROUP BY plate) m USING (plate) GROUP BY c.plate", "q p d t", prefix=WC))
def grouped_mad(spark, sf):
    return ST.grouped_mad(T.cells(spark, sf), ["plate"], FEATURES)



def _bh_sql(family: str) -> str:
    k = f"{family}, " if family else ""
    step = f"SELECT *, least(1.0, pvalue * count(*) OVER (PARTITION BY {k} pvalue IS NULL) / row_number() OVER (PARTITION BY {k} pvalue IS NULL ORDER BY pvalue, guide)) AS s FROM guides"
    return rsql(f"SELECT guide, gene, pvalue, CASE WHEN pvalue IS NOT NULL THEN min(s) OVER (PARTITION BY {k} pvalue IS NULL ORDER BY pvalue, guide ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS qvalue FROM ({step})", "pvalue qvalue", 9, WG)


@query("benjamini_hochberg", _bh_sql(""), 9)
def bh(spark, sf):
    return ST.benjamini_hochberg(T.guides(spark, sf), tie=["guide"]).select("guide", "gene", "pvalue", "qvalue")


@query("benjamini_hochberg_by_group", _bh_sql("gene"), 9)
def bh_by(spark, sf):
    return ST.benjamini_hochberg(T.guides(spark, sf), by=["gene"], tie=["guide"]).select("guide", "gene", "pvalue", "qvalue")


@query("benjamini_hochberg_large", _bh_sql(""), 9)
def bh_large(spark, sf):
    return ST.benjamini_hochberg_large(T.guides(spark, sf), tie=["guide"], buckets=16).select("guide", "gene", "pvalue", "qvalue")


@query("permutation_pvalue", rsql("SELECT grp, (1.0 + count(*) FILTER (value >= 50)) / (1.0 + count(value)) AS pvalue FROM pop GROUP BY grp", "pvalue", prefix=WP))
def permutation_p(spark, sf):
    g = T.populations(spark, sf).groupBy("grp").agg(F.collect_list("value").alias("null"))
    return g.select("grp", ST.permutation_pvalue(F.lit(50.0), F.col("null")).alias("pvalue"))


# ---------------------------------------------------------------- wells, names, sources

_NAME = "CASE supp % 4 WHEN 0 THEN lower(well) WHEN 1 THEN substr(well, 1, 1) || '-' || substr(well, 2) WHEN 2 THEN well ELSE 'X0' END"


@query("normalize_well", f"{WC}, r AS (SELECT DISTINCT supp, {_NAME} AS raw FROM cells), w AS (SELECT supp, raw, CASE WHEN supp % 4 = 3 THEN NULL ELSE upper(substr(raw, 1, 1)) || lpad(regexp_extract(raw, '(\\d+)$', 1), 2, '0') END AS well FROM r) SELECT supp, raw, well, CAST(ascii(well) - 65 AS INTEGER) AS r, CAST(substr(well, 2) AS INTEGER) - 1 AS c FROM w WHERE well IS NOT NULL")
def normalize_well(spark, sf):
    raw = T.cells(spark, sf).select("supp", F.expr(_NAME.replace("lower", "lower")).alias("raw")).distinct()
    out = raw.withColumn("well", W.normalize_well(F.col("raw"))).where("well is not null")
    return out.select("supp", "raw", "well", W.well_row(F.col("well")).alias("r"), W.well_col(F.col("well")).alias("c"))


@query("well_name_roundtrip", f"{WC} SELECT DISTINCT well, well AS again FROM cells")
def well_roundtrip(spark, sf):
    w = F.col("well")
    return T.cells(spark, sf).select("well", W.well_name(W.well_row(w), W.well_col(w)).alias("again")).distinct()


@query("detect_plate_format", f"{WC} SELECT plate, CASE WHEN max(ascii(well) - 65) < 8 AND max(CAST(substr(well, 2) AS INTEGER)) <= 12 THEN 96 WHEN max(ascii(well) - 65) < 16 AND max(CAST(substr(well, 2) AS INTEGER)) <= 24 THEN 384 ELSE 1536 END AS plate_format FROM cells GROUP BY plate")
def plate_format(spark, sf):
    return W.detect_plate_format(T.cells(spark, sf), "well", ["plate"])


@query("canonical_channel", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'dna|er' WHEN 1 THEN 'agp' WHEN 2 THEN 'mito|rna' ELSE 'other' END AS channel FROM nation")
def canonical_channel(spark, sf):
    raw = F.when(F.col("n_nationkey") % 4 == 0, "DAPI|ER").when(F.col("n_nationkey") % 4 == 1, "Actin").when(F.col("n_nationkey") % 4 == 2, "MitoTracker|SYTO").otherwise("Other")
    return T.read(spark, sf, "nation").select("n_nationkey", W.canonical_channel_column(raw).alias("channel"))


_FEATURE_NAMES = ["Cells_AreaShape_Area", "Nuclei_Intensity_MeanIntensity_DNA", "Cytoplasm_Texture_Contrast_ER_3_00_256", "Cells_RadialDistribution_FracAtD_Mito_2of4", "Cells_Correlation_Correlation_DNA_AGP", "Nuclei_Location_Center_X", "emb_17"]


def _measured_names(spark, sf):
    """Feature names as a screen's files have them, one for each part: object, group and measure by its key, channel, scale and bin by its size."""
    kind, chan = F.floor(F.col("p_partkey") / 3) % 4, F.element_at(F.array(*map(F.lit, ("DNA", "ER", "Mito", "AGP"))), (F.col("p_size") % 4 + 1).cast("int"))
    obj = F.element_at(F.array(*map(F.lit, ("Cells", "Nuclei", "Cytoplasm"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    name = F.when(kind == 0, F.concat_ws("_", obj, F.lit("Intensity_MeanIntensity"), chan)).when(kind == 1, F.concat_ws("_", obj, F.lit("Texture_Contrast"), chan, (F.col("p_size") % 3 + 3).cast("string"), F.lit("00_256")))
    name = name.when(kind == 2, F.concat(obj, F.lit("_RadialDistribution_FracAtD_"), chan, F.lit("_"), (F.col("p_size") % 4 + 1).cast("string"), F.lit("of4"))).otherwise(F.concat(obj, F.lit("_AreaShape_Area")))
    return W.parse_feature_table(T.read(spark, sf, "part").select(name.alias("feature")))


#: The same names put together from their parts, so the parts are known without parsing.
_NAMES = """
WITH bits AS (SELECT DISTINCT CAST(floor(p_partkey / 3.0) AS BIGINT) % 4 AS kind, ['Cells', 'Nuclei', 'Cytoplasm'][p_partkey % 3 + 1] AS object,
                     ['DNA', 'ER', 'Mito', 'AGP'][p_size % 4 + 1] AS chan, CAST(p_size % 3 + 3 AS VARCHAR) AS sc, (p_size % 4 + 1) || 'of4' AS bin FROM part),
parts AS (SELECT DISTINCT object, CASE kind WHEN 0 THEN 'Intensity' WHEN 1 THEN 'Texture' WHEN 2 THEN 'RadialDistribution' ELSE 'AreaShape' END AS feature_group,
                 CASE kind WHEN 0 THEN 'MeanIntensity' WHEN 1 THEN 'Contrast' WHEN 2 THEN 'FracAtD' ELSE 'Area' END AS measure, CASE WHEN kind < 3 THEN chan END AS channel,
                 CASE WHEN kind = 1 THEN sc END AS scale, CASE WHEN kind = 1 THEN '00' END AS angle, CASE WHEN kind = 1 THEN '256' END AS gray_levels, CASE WHEN kind = 2 THEN bin END AS radial_bin FROM bits),
names AS (SELECT concat_ws('_', object, feature_group, measure, channel, scale, angle, gray_levels, radial_bin) AS feature, *, TRUE AS is_feature,
                 concat_ws('_', lower(object), CASE feature_group WHEN 'RadialDistribution' THEN 'radial_distribution' WHEN 'AreaShape' THEN 'area_shape' ELSE lower(feature_group) END,
                           CASE measure WHEN 'MeanIntensity' THEN 'mean_intensity' WHEN 'FracAtD' THEN 'frac_at_d' ELSE lower(measure) END, lower(channel), scale, angle, gray_levels, radial_bin) AS standard FROM parts)
"""


@query("parse_feature_names", f"{_NAMES} SELECT * EXCLUDE (standard) FROM names")
def parse_names(spark, sf):
    return _measured_names(spark, sf).drop("standard")


@query("standardize_feature_names", f"{_NAMES} SELECT feature, standard FROM names")
def standardize_names(spark, sf):
    return _measured_names(spark, sf).select("feature", "standard")


@query("get_features", f"{_NAMES} SELECT feature FROM names WHERE object = 'Cells' AND feature_group = 'AreaShape'")
def get_features(spark, sf):
    return SRC.features_where(_measured_names(spark, sf), object="Cells", feature_group="AreaShape")


@query("feature_sets", f"{_NAMES} SELECT feature_group || '|' || channel AS source, feature AS target, 1.0::DOUBLE AS weight FROM names WHERE channel IS NOT NULL")
def feature_sets(spark, sf):
    return N.feature_sets(_measured_names(spark, sf), ["feature_group", "channel"])


@query("annotate_controls", f"{WC} SELECT row_id, CASE WHEN pert = 'N' THEN 'negcon' WHEN pert = 'A' THEN 'poscon' ELSE 'treatment' END AS Metadata_Control_Type, pert IN ('N', 'A') AS Metadata_Control FROM cells")
def annotate_controls(spark, sf):
    df = T.cells(spark, sf).withColumnRenamed("pert", "Metadata_Perturbation")
    return REF.annotate_controls(df, ["N"], ["A"]).select("row_id", REF.TYPE, REF.CONTROL)


@query("stack_profiles", "SELECT c_custkey AS k, c_acctbal AS x FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def stack(spark, sf):
    a = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.lit(1).alias("only_a"))
    b = T.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"))
    return SRC.stack([a, b], "intersect")


@query("join_platemap", f"{WC}, pm AS (SELECT DISTINCT well, 'cpd' || ascii(well) AS compound FROM cells WHERE ascii(well) < 70) SELECT c.row_id, c.well AS Metadata_Well, pm.compound AS compound FROM cells c LEFT JOIN pm USING (well)")
def platemap(spark, sf):
    c = T.cells(spark, sf)
    pm = c.where(F.ascii("well") < 70).select(F.col("well").alias("Metadata_Well"), F.concat(F.lit("cpd"), F.ascii("well").cast("string")).alias("compound")).distinct()
    return SRC.join_platemap(c.select("row_id", F.col("well").alias("Metadata_Well")), pm)


@query("annotation_chain", "SELECT s_suppkey, s_nationkey, n_name, n_regionkey, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def annotation_chain(spark, sf):
    s = T.read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = T.read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    r = T.read(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return SRC.annotate(s, [(n, ["s_nationkey"]), (r, ["n_regionkey"])])


@query("annotation_drop_unmapped", "SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey < 10")
def annotation_drop(spark, sf):
    n = T.read(spark, sf, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return SRC.annotate(T.read(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), [(n, ["s_nationkey"])], "drop")


@query("unexpressed_genes", f"{WW} SELECT DISTINCT gene FROM (SELECT unnest(['GENE1', 'GENE2', 'GENE3']) AS gene, unnest([d, t, q]) AS value FROM wells WHERE id = 'P1_A01_N') WHERE value <= 0.05")
def unexpressed(spark, sf):
    w = T.wells(spark, sf).select("id", F.col("d").alias("GENE1 (11)"), F.col("t").alias("GENE2 (12)"), F.col("q").alias("GENE3 (13)"))
    return SRC.unexpressed_genes(w, "id", "P1_A01_N", 0.05)


@query("sentinels_to_null", f"{WC} SELECT row_id, CASE WHEN d <> 0 AND d <> 0.05 THEN d + 0.0 END AS d FROM cells")
def sentinels(spark, sf):
    out, _ = SRC.from_dataframe(T.cells(spark, sf).select(F.col("row_id").cast("string").alias("Metadata_id"), "d"), [0.0, 0.05])
    return out.select(F.col("Metadata_id").cast("long").alias("row_id"), "d")


@query("identity_report", f"{WC} SELECT count(*) AS n_rows, count(DISTINCT (plate, well)) AS n_distinct, count(*) FILTER (plate IS NULL OR well IS NULL) AS n_null FROM cells")
def identity_report(spark, sf):
    return SRC.identity_report(T.cells(spark, sf), ["plate", "well"])


@query("image_id", f"{WC} SELECT row_id, plate || '|' || well AS image FROM cells")
def image_id(spark, sf):
    c = T.cells(spark, sf).withColumnsRenamed({"plate": "Metadata_Plate", "well": "Metadata_Well"})
    return c.select("row_id", SRC.image_id(c).alias("image"))


@query("validate_profiles")
def validate(spark, sf):
    w = T.wells(spark, sf).withColumnsRenamed({"plate": "Metadata_Plate", "well": "Metadata_Well"})
    return SRC.validate(w, SRC.ProfileMeta("well", tuple(FEATURES)))


@query("synthetic_plate")
def synthetic(spark, sf):
    return SRC.synthetic_plate(spark)


# ---------------------------------------------------------------- files and shapes of profiles


def _folder(spark) -> str:
    """A fresh folder below spark.checkpoint.dir. Only a session of one machine may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file:{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def _named_wells(spark, sf):
    return T.wells(spark, sf).select(F.col("plate").alias("Metadata_Plate"), F.col("well").alias("Metadata_Well"), F.col("pert").alias("Metadata_Perturbation"), "control", *[F.col(f).alias(f"Cells_AreaShape_{f}") for f in FEATURES])


_NAMED = "plate AS Metadata_Plate, well AS Metadata_Well, " + each("@ AS Cells_AreaShape_@")
_NAMED_FEATURES = each("Cells_AreaShape_@", sep=" ")


@query("profiles_round_trip", rsql(f"SELECT {_NAMED} FROM wells WHERE control", _NAMED_FEATURES, prefix=WW))
def profiles_round_trip(spark, sf):
    """Written with their description and read again."""
    path, feats = _folder(spark), tuple(f"Cells_AreaShape_{f}" for f in FEATURES)
    SRC.write(_named_wells(spark, sf).where("control").drop("control", "Metadata_Perturbation"), SRC.ProfileMeta("well", feats), path)
    rows, meta = SRC.read(spark, path)
    return rows.select("Metadata_Plate", "Metadata_Well", *meta.features)


@query("read_profiles", rsql(f"SELECT {_NAMED}, pert AS Metadata_Perturbation, ascii(well) - 65 AS Metadata_Row, CAST(substr(well, 2) AS INTEGER) - 1 AS Metadata_Col FROM wells", _NAMED_FEATURES, prefix=WW))
def read_profiles(spark, sf):
    """Two files of profiles stacked into one table."""
    path, w = _folder(spark), _named_wells(spark, sf)
    for name, part in (("a", w.where("control")), ("b", w.where("not control"))):
        part.drop("control").write.csv(f"{path}/{name}.csv", header=True)
    rows, meta = SRC.read_profiles(spark, [f"{path}/a.csv", f"{path}/b.csv"])
    return rows.select("Metadata_Plate", "Metadata_Well", "Metadata_Perturbation", "Metadata_Row", "Metadata_Col", *meta.features)


@query("from_embedding", rsql("SELECT vec_id, label, len(v) AS n_features, v[1] AS first, v[64] AS last FROM e", "first last", prefix=f"WITH e AS ({EMBEDDED})"))
def from_embedding(spark, sf):
    rows, _ = SRC.from_embedding(T.embedded(spark, sf), "v", ["vec_id", "label"])
    return rows.select("vec_id", "label", F.size("features").cast("long").alias("n_features"), F.col("features")[0].alias("first"), F.col("features")[63].alias("last"))


@query("image_table", f"{WC} SELECT DISTINCT plate || '|' || well AS Metadata_ImageID, ascii(well) AS ImageQuality_Row, length(plate) AS ImageQuality_Name FROM cells")
def image_table(spark, sf):
    c = T.cells(spark, sf).withColumns({"Metadata_ImageID": F.concat_ws("|", "plate", "well"), "ImageQuality_Row": F.when(F.col("row_id") % 3 != 0, F.ascii("well")), "ImageQuality_Name": F.length("plate")})
    return SRC.image_table(c)


@query("read_export", "SELECT CAST(p_size % 10 AS INTEGER) AS ImageNumber, CAST(p_partkey AS BIGINT) AS ObjectNumber, p_retailprice + 0.0 AS Cells_AreaShape_Area, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS Nuclei_AreaShape_Area, 'P' || (p_size % 10) AS Metadata_Plate, CAST((p_size % 10) / 2.0 AS DOUBLE) AS ImageQuality_Focus FROM part")
def read_export(spark, sf):
    """A directory of an export: objects, their children and the images."""
    path, part = _folder(spark), T.read(spark, sf, "part")
    image, number = (F.col("p_size") % 10).alias("ImageNumber"), F.col("p_partkey")
    part.select(image, number.alias("ObjectNumber"), F.col("p_retailprice").alias("AreaShape_Area")).write.csv(f"{path}/Cells.csv", header=True)
    part.where("p_partkey % 4 <> 0").select(image, (number + 7).alias("ObjectNumber"), number.alias("Parent_Cells"), F.col("p_size").alias("AreaShape_Area")).write.csv(f"{path}/Nuclei.csv", header=True)
    part.select(image).distinct().select("ImageNumber", F.concat(F.lit("P"), F.col("ImageNumber").cast("string")).alias("Metadata_Plate"), (F.col("ImageNumber") / 2.0).alias("ImageQuality_Focus")).write.csv(f"{path}/Image.csv", header=True)
    out = SRC.read_export(spark, path, "Cells", ["Nuclei"])
    return out.select("ImageNumber", F.col("ObjectNumber").cast("long").alias("ObjectNumber"), F.col("Cells_AreaShape_Area").cast("double").alias("Cells_AreaShape_Area"), F.col("Nuclei_AreaShape_Area").cast("double").alias("Nuclei_AreaShape_Area"), "Metadata_Plate", F.col("ImageQuality_Focus").cast("double").alias("ImageQuality_Focus"))


@query("stamp_profiles", f"{WW} SELECT 'well' AS resolution, plate AS Metadata_Plate, well AS Metadata_Well, 'Cells_AreaShape_q,Cells_AreaShape_p,Cells_AreaShape_d,Cells_AreaShape_t' AS features, count(*) AS n_rows FROM wells GROUP BY plate, well")
def stamp_profiles(spark, sf):
    """Rows of each identity that the stamp names."""
    w = _named_wells(spark, sf)
    m = SRC.stamp(w, "well", grouped_by=["Metadata_Plate", "Metadata_Well"])
    return w.groupBy(*m.grouped_by).agg(F.count(F.lit(1)).alias("n_rows")).withColumns({"resolution": F.lit(m.resolution), "features": F.lit(",".join(m.features))})


@query("read_edges", "SELECT DISTINCT CAST(least(l, r) AS VARCHAR) AS a, CAST(greatest(l, r) AS VARCHAR) AS b FROM (SELECT 'g' || (p_partkey % 50) AS l, 'g' || (p_size % 50) AS r FROM part) WHERE l <> r")
def read_edges(spark, sf):
    path = f"{_folder(spark)}/edges.tsv"
    T.read(spark, sf, "part").select(F.concat(F.lit("g"), (F.col("p_partkey") % 50).cast("string")).alias("A"), F.concat(F.lit("g"), (F.col("p_size") % 50).cast("string")).alias("B")).write.csv(path, header=True, sep="\t")
    return SRC.read_edges(spark, path, "A", "B")


@query("read_complexes", "SELECT DISTINCT p_brand AS source, 'g' || (p_size % 40) AS target, 1.0::DOUBLE AS weight FROM part")
def read_complexes(spark, sf):
    path, part = f"{_folder(spark)}/complexes.tsv", T.read(spark, sf, "part")
    genes = F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("g"), (F.col("p_size") % 40).cast("string")))), ";")
    part.groupBy(F.col("p_brand").alias("name")).agg(genes.alias("members")).write.csv(path, header=True, sep="\t")
    return SRC.read_complexes(spark, path, "name", "members")


# ---------------------------------------------------------------- quality control


@query("large_quantiles", rsql(" UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n, quantile_cont({f}, 0.01) AS q0, quantile_cont({f}, 0.5) AS q1, quantile_cont({f}, 0.975) AS q2 FROM cells" for f in FEATURES), "q0 q1 q2", prefix=WC))
def large_quantiles(spark, sf):
    """Exact quantiles of the whole table by histograms, without a buffer of its values."""
    return QU.large_quantiles(T.cells(spark, sf), [], FEATURES, [0.01, 0.5, 0.975])


@query("large_median_mad", rsql(" UNION ALL ".join(f"SELECT '{f}' AS feature, median({f}) AS center, median(abs({f} - m)) AS spread FROM cells, (SELECT median({f}) AS m FROM cells)" for f in FEATURES), "center spread", prefix=WC))
def large_median_mad(spark, sf):
    return QU.large_median_and_mad(T.cells(spark, sf), [], FEATURES)


@query("qc_row_missing", rsql("SELECT row_id, CAST(n AS BIGINT) AS qc_n_missing, n / 4.0 AS qc_missing_fraction, n / 4.0 > 0.2 AS qc_high_nan FROM (SELECT row_id, (q IS NULL)::INT + (p IS NULL)::INT + (d IS NULL)::INT + (t IS NULL)::INT AS n FROM cells)", "qc_missing_fraction", prefix=WC))
def qc_missing(spark, sf):
    return Q.row_missing(T.cells(spark, sf), FEATURES, 0.2).select("row_id", "qc_n_missing", "qc_missing_fraction", "qc_high_nan")


_AREA = "med AS (SELECT plate, median(p) AS c FROM cells GROUP BY plate), fit AS (SELECT c.plate, any_value(m.c) AS c, median(abs(c.p - m.c)) AS s FROM cells c JOIN med m USING (plate) GROUP BY c.plate)"


@query("qc_metrics", f"{WC}, {_AREA} SELECT row_id, q IS NULL AS qc_high_nan, coalesce(q < 3 OR d * 100 < 3 OR q > 47 OR d * 100 > 7, FALSE) AS qc_border, coalesce(abs((p - c) / (s * 1.4826)) > 1.5, FALSE) AS qc_area_outlier, q IS NULL OR coalesce(q < 3 OR d * 100 < 3 OR q > 47 OR d * 100 > 7, FALSE) OR coalesce(abs((p - c) / (s * 1.4826)) > 1.5, FALSE) AS qc_fail FROM cells JOIN fit USING (plate)")
def qc_metrics(spark, sf):
    c = T.cells(spark, sf).withColumn("y", F.col("d") * 100)
    out = Q.row_missing(c, FEATURES, 0.2)
    out = out.withColumn("qc_border", F.coalesce(Q.border_flag(F.col("q"), F.col("y"), 50.0, 10.0, 3.0), F.lit(False)))
    z = ST.join_fit(out, ST.median_and_spread(out, ["plate"], ["p"]), ["plate"])
    out = z.withColumn("qc_area_outlier", Q.qc_fail([F.abs(ST.robust_z(F.col("p"), F.col("p__c"), F.col("p__s"))) > 1.5]))
    flags = ["qc_high_nan", "qc_border", "qc_area_outlier"]
    return out.select("row_id", *flags, Q.qc_fail([F.col(f) for f in flags]).alias("qc_fail"))


@query("feature_metrics", rsql(" UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) FILTER ({f} IS NULL) AS n_missing, var_pop({f}) AS variance, count(DISTINCT {f}) AS n_distinct FROM cells" for f in ("q", "d", "t")), "variance", prefix=WC))
def feature_metrics(spark, sf):
    return Q.feature_metrics(T.cells(spark, sf), ["q", "d", "t"])


@query("filter_cells", f"{WC} SELECT row_id FROM (SELECT row_id, count(*) OVER (PARTITION BY plate, well) AS n FROM cells WHERE q IS NOT NULL) WHERE n >= 350")
def filter_cells(spark, sf):
    c = T.cells(spark, sf).withColumn("qc_fail", F.col("q").isNull())
    return Q.filter_cells(c, ["plate", "well"], 350).select("row_id")


@query("filter_features", f"{WC} SELECT feature FROM (SELECT 'q' AS feature, var_pop(q) AS v FROM cells UNION ALL SELECT 'd', var_pop(d) FROM cells UNION ALL SELECT 't', var_pop(t) FROM cells) WHERE v > 0.0007 AND feature <> 'q'")
def filter_features(spark, sf):
    c = T.cells(spark, sf)
    return Q.filter_features(Q.feature_metrics(c, ["q", "d", "t"]), c.count(), 0.0007, ["q"]).select("feature")


def _image_mad_sql(threshold: float) -> str:
    med = f"med AS (SELECT plate, {each('median(@) AS @_c')} FROM wells GROUP BY plate), fit AS (SELECT w.plate, {each('any_value(m.@_c) AS @_c')}, {each('median(abs(w.@ - m.@_c)) AS @_s')} FROM wells w JOIN med m USING (plate) GROUP BY w.plate)"
    score = "greatest(" + each("coalesce(abs(CASE WHEN f.@_s * 1.4826 <= 1e-18 THEN 0.0 ELSE (w.@ - f.@_c) / (f.@_s * 1.4826::DOUBLE) END), 0.0)") + ", 0.0)"
    return rsql(f"SELECT id, {score} AS qc_image_score, {score} > {threshold} AS qc_image_fail FROM wells w JOIN fit f USING (plate)", "qc_image_score", prefix=f"{WW}, {med}")


@query("image_qc_mad", _image_mad_sql(3.0))
def image_qc_mad(spark, sf):
    return Q.image_qc_mad(T.wells(spark, sf), FEATURES, ["plate"], 3.0).select("id", "qc_image_score", "qc_image_fail")


_IMG = "s AS (SELECT plate, avg(p) AS pm, stddev_pop(p) AS ps, avg(d) AS dm, stddev_pop(d) AS ds FROM wells GROUP BY plate), z AS (SELECT w.plate, w.id, coalesce((w.p - s.pm) / nullif(s.ps, 0), 0) AS a, coalesce((w.d - s.dm) / nullif(s.ds, 0), 0) AS b FROM wells w JOIN s USING (plate)), nn AS (SELECT x.plate, x.id, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) AS d, row_number() OVER (PARTITION BY x.id ORDER BY sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2), y.id) AS r FROM z x JOIN z y ON x.plate = y.plate AND x.id <> y.id), sc AS (SELECT plate, id, avg(d) AS score FROM nn WHERE r <= 5 GROUP BY plate, id), mm AS (SELECT plate, median(score) AS m FROM sc GROUP BY plate), hh AS (SELECT sc.plate, median(mm.m - sc.score) AS h FROM sc JOIN mm USING (plate) WHERE sc.score <= mm.m GROUP BY sc.plate)"


@query("image_qc_knn", rsql("SELECT sc.plate, sc.id, sc.score AS qc_image_score, CASE WHEN h * 1.4826 > 0 THEN (score - m) / (h * 1.4826) ELSE 0 END > 3.5 AS qc_image_fail FROM sc JOIN mm USING (plate) JOIN hh USING (plate)", "qc_image_score", prefix=f"{WW}, {_IMG}"))
def image_qc_knn(spark, sf):
    return Q.image_qc_knn(T.wells(spark, sf), ["p", "d"], ["plate"], "id", 5)


@query("filter_images", f"{WC}, failed AS (SELECT id FROM ({_image_mad_sql(3.0)}) WHERE qc_image_fail) SELECT row_id FROM cells WHERE plate || '_' || well || '_' || pert NOT IN (SELECT id FROM failed)")
def filter_images(spark, sf):
    images = Q.image_qc_mad(T.wells(spark, sf), FEATURES, ["plate"], 3.0)
    return Q.filter_images(T.cells(spark, sf).withColumn("id", F.concat_ws("_", "plate", "well", "pert")), images, "id").select("row_id")


@query("well_qc", rsql(f"SELECT plate, well, max(n) AS n_cells, 1 - sum(m) / sum(n) AS missing_fraction, median(cv) FILTER (hc AND n > 1) AS control_cv, max(n) >= 50 AND 1 - sum(m) / sum(n) <= 0.1 AS well_pass FROM (SELECT plate, well, feature, count(*) AS n, count(value) AS m, bool_or(control) AS hc, abs(stddev_samp(value) / avg(value)) AS cv FROM ({LONG}) GROUP BY plate, well, feature) GROUP BY plate, well", "missing_fraction control_cv", prefix=WC))
def well_qc(spark, sf):
    return Q.well_qc(T.cells(spark, sf), ["plate", "well"], FEATURES, F.col("control"))


_MADS = f"med AS (SELECT plate, {each('median(@) AS @_c')} FROM cells GROUP BY plate), fit AS (SELECT c.plate, {each('any_value(m.@_c) AS @_c')}, {each('median(abs(c.@ - m.@_c)) AS @_s')} FROM cells c JOIN med m USING (plate) GROUP BY c.plate), sc AS (SELECT c.row_id, c.plate, greatest({each('abs((c.@ - f.@_c) / (f.@_s * 1.4826::DOUBLE))')}) AS outlier_score FROM cells c JOIN fit f USING (plate))"


@query("outliers_mad", rsql("SELECT row_id, plate, outlier_score, row_number() OVER (PARTITION BY plate ORDER BY round(outlier_score, 6) DESC, row_id) <= ceil(0.01 * count(*) OVER (PARTITION BY plate)) AS is_outlier FROM sc", "outlier_score", prefix=f"{WC}, {_MADS}"))
def outliers_mad(spark, sf):
    s = Q.mad_scores(T.cells(spark, sf), FEATURES, ["plate"]).select("row_id", "plate", F.round("outlier_score", 6).alias("outlier_score"))
    return Q.flag_outliers(s, "row_id", ["plate"])


_ECOD = "l AS (SELECT id, unnest(['q','p','d','t']) AS feature, unnest([q,p,d,t]) AS value FROM wells), f AS (SELECT id, feature, coalesce(value, avg(value) OVER (PARTITION BY feature)) AS value FROM l), g AS (SELECT id, feature, -ln(cume_dist() OVER (PARTITION BY feature ORDER BY value)) AS l, -ln(cume_dist() OVER (PARTITION BY feature ORDER BY value DESC)) AS r FROM f)"


@query("outliers_ecod", rsql("SELECT id, sum(greatest(l, r)) AS outlier_score FROM g GROUP BY id", "outlier_score", prefix=f"{WW}, {_ECOD}"))
def outliers_ecod(spark, sf):
    return Q.ecod_scores(T.wells(spark, sf), FEATURES, "id")


_NN = f"WITH e AS ({EMBEDDED}), nn AS (SELECT * FROM (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE r <= 20)"


@query("outliers_lof", rsql("SELECT nn.i AS id, avg(o.lrd) / any_value(s.lrd) AS outlier_score FROM nn JOIN lrd o ON nn.j = o.i JOIN lrd s ON nn.i = s.i GROUP BY nn.i", "outlier_score", prefix=f"{_NN}, kd AS (SELECT i, max(d) AS kd FROM nn GROUP BY i), lrd AS (SELECT nn.i, 1.0 / (avg(greatest(nn.d, kd.kd)) + 1e-10) AS lrd FROM nn JOIN kd ON nn.j = kd.i GROUP BY nn.i)"))
def outliers_lof(spark, sf):
    return Q.lof_scores(T.embedded(spark, sf), "vec_id", "v", 20)


@query("outliers_isolation_forest")
def outliers_iforest(spark, sf):
    s = Q.isolation_scores(T.cells(spark, sf).select("row_id", *FEATURES), FEATURES, "row_id", 50)
    return Q.flag_outliers(s, "row_id")


@query("downsample", "SELECT event_id AS row_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 20")
def downsample(spark, sf):
    return Q.downsample(T.populations(spark, sf), ["user"], ["row_id"], 20).select("row_id")


@query("downsample_stratified", 'WITH a AS (SELECT event_id, user_id, event_type, greatest(1, round(20 * (count(*) OVER (PARTITION BY user_id, event_type)) / (count(*) OVER (PARTITION BY user_id)))) AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS r FROM a WHERE s <= k OR n <= 20) SELECT event_id AS row_id FROM b WHERE r <= 20')
def downsample_stratified(spark, sf):
    return Q.downsample(T.populations(spark, sf), ["user"], ["row_id"], 20, ["cluster"]).select("row_id")


# ---------------------------------------------------------------- feature selection


@query("variance_threshold", rsql(" UNION ALL ".join(f"SELECT '{f}' AS feature, var_pop({f}) AS variance, var_pop({f}) > 0.0007 AS keep FROM cells" for f in ("q", "d", "t")), "variance", prefix=WC))
def variance_threshold(spark, sf):
    return S.variance_threshold(T.cells(spark, sf), ["q", "d", "t"], 0.0007)


@query("frequency_threshold", rsql(f"SELECT feature, coalesce(max(n) FILTER (r = 2), 0) / max(n) FILTER (r = 1) AS ratio, count(*) / (SELECT count(*) FROM cells)::DOUBLE AS unique_ratio, NOT (coalesce(max(n) FILTER (r = 2), 0) / max(n) FILTER (r = 1) < 0.05 OR count(*) / (SELECT count(*) FROM cells)::DOUBLE < 0.01) AS keep FROM (SELECT feature, value, count(*) AS n, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS r FROM ({LONG}) WHERE value IS NOT NULL GROUP BY feature, value) GROUP BY feature", "ratio unique_ratio", prefix=WC))
def frequency_threshold(spark, sf):
    return S.frequency_threshold(T.cells(spark, sf), FEATURES, "row_id")


@query("drop_na_columns", rsql(" UNION ALL ".join(f"SELECT '{f}' AS feature, avg(({f} IS NULL)::INT) AS missing, avg(({f} IS NULL)::INT) <= 0.05 AS keep FROM cells" for f in FEATURES), "missing", prefix=WC))
def drop_na(spark, sf):
    return S.drop_na_columns(T.cells(spark, sf), FEATURES)


@query("blocklist", "SELECT feature FROM (VALUES ('Cells_AreaShape_Area'), ('Nuclei_Intensity_MeanIntensity_DNA'), ('Cytoplasm_Texture_Contrast_ER_3_00_256'), ('Cells_RadialDistribution_FracAtD_Mito_2of4'), ('Nuclei_Location_Center_X'), ('emb_17')) v(feature)")
def blocklist(spark, sf):
    """Names on the list go, under any object."""
    kept = S.without_blocklisted(_FEATURE_NAMES, ["Nuclei_Correlation_Correlation_DNA_AGP"])
    return spark.createDataFrame([(f,) for f in kept], "feature string")


@query("drop_outliers", rsql(" UNION ALL ".join(f"SELECT '{f}' AS feature, max(abs({f})) AS largest, max(abs({f})) <= 500 AS keep FROM cells" for f in FEATURES), "largest", prefix=WC))
def drop_outliers(spark, sf):
    return S.drop_outliers(T.cells(spark, sf), FEATURES)


@query("noise_removal", rsql(" UNION ALL ".join(f"SELECT '{f}' AS feature, avg(s) AS noise, avg(s) <= 0.8 AS keep FROM (SELECT plate, pert, stddev_pop({f}) AS s FROM cells GROUP BY plate, pert)" for f in ("q", "d", "t")), "noise", prefix=WC))
def noise_removal(spark, sf):
    return S.noise_removal(T.cells(spark, sf), ["q", "d", "t"], ["plate", "pert"])


_PAIRS6 = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query("correlated_pairs", rsql(" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM cells" for a, b in _PAIRS6), "r", prefix=WC))
def correlated_pairs(spark, sf):
    return S.correlated_pairs(T.cells(spark, sf), FEATURES)


@query("pairwise_correlations", rsql(" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM cells" for a, b in _PAIRS6), "r", prefix=WC))
def pairwise_correlations(spark, sf):
    """All pairs of features with the rows they have in common, in one scan."""
    return G.pairwise_correlations(T.cells(spark, sf), FEATURES)


@query("correlated_pairs_spearman", rsql(" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM ranks" for a, b in _PAIRS6), "r", prefix=f"{WW}, ranks AS (SELECT {each('CASE WHEN @ IS NOT NULL THEN rank() OVER (PARTITION BY @ IS NULL ORDER BY @) + (count(*) OVER (PARTITION BY @) - 1) / 2.0 END AS @')} FROM wells)"))
def spearman_pairs(spark, sf):
    return S.correlated_pairs(T.wells(spark, sf), FEATURES, "spearman")


_CT = f"pr AS ({' UNION ALL '.join(f'SELECT {chr(39)}{a}{chr(39)} AS a, {chr(39)}{b}{chr(39)} AS b, corr({a}, {b}) AS r FROM cells' for a, b in _PAIRS6)}), o AS (SELECT unnest(['q','p','d','t']) AS feature, unnest([0, 1, 2, 3]) AS place), tot AS (SELECT o.feature, o.place, 1.0 + sum(abs(coalesce(r, 0))) AS total FROM o JOIN pr ON o.feature IN (pr.a, pr.b) GROUP BY o.feature, o.place), gone AS (SELECT DISTINCT CASE WHEN ta.total > tb.total OR (ta.total = tb.total AND ta.place > tb.place) THEN a ELSE b END AS feature FROM pr JOIN tot ta ON ta.feature = a JOIN tot tb ON tb.feature = b WHERE r > 0.5)"


@query("correlation_threshold", rsql("SELECT feature, total, feature NOT IN (SELECT feature FROM gone) AS keep FROM tot", "total", prefix=f"{WC}, {_CT}"))
def correlation_threshold(spark, sf):
    return S.correlation_threshold(T.cells(spark, sf), FEATURES, 0.5)


@query("feature_select")
def feature_select(spark, sf):
    return S.feature_select(T.cells(spark, sf), FEATURES, "row_id", ["drop_na_columns", "variance_threshold", "correlation_threshold", "drop_outliers"], corr_threshold=0.5)


@query("correlation_iterative")
def correlation_iterative(spark, sf):
    pairs = [tuple(r) for r in S.correlated_pairs(T.cells(spark, sf), FEATURES).collect()]
    return spark.createDataFrame([(f,) for f in S.correlation_iterative(pairs, FEATURES, 0.5)], "feature string")


@query("correlation_window")
def correlation_window(spark, sf):
    return spark.createDataFrame([(f,) for f in S.correlation_window(T.cells(spark, sf), FEATURES, 0.5, 3, 1)], "feature string")


@query("decorrelate")
def decorrelate(spark, sf):
    c = T.cells(spark, sf).withColumn("copy", F.col("d") * 2 + 1)
    return spark.createDataFrame([(f,) for f in S.decorrelate(c, ["d", "t", "copy", "p"], 0.9)], "feature string")


@query("decorr_threshold_sweep")
def decorr_sweep(spark, sf):
    return S.decorr_threshold_sweep(T.cells(spark, sf), FEATURES, [0.5, 0.9, 0.99], {"n": lambda k: float(len(k))})


@query("subset_features", f"{WC} SELECT row_id, q, d, t FROM cells")
def subset_features(spark, sf):
    sel = spark.createDataFrame([("q", 0, True), ("p", 1, False), ("d", 2, True), ("t", 3, True)], "feature string, place int, selected boolean")
    return S.subset_features(T.cells(spark, sf), sel, ["row_id"])


_ICC = f"e AS (SELECT feature, pert, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM ({LONG}) WHERE value IS NOT NULL AND feature <> 'p' GROUP BY feature, pert), s AS (SELECT feature, count(*) AS g, sum(n) AS nn, sum(n * n) AS n2, sum(n * v) AS w, sum(n * m) AS s1, sum(n * m * m) AS s2 FROM e GROUP BY feature), b AS (SELECT feature, (s2 - s1 * s1 / nn) / (g - 1) AS msb, w / (nn - g) AS msw, (nn - n2 / nn) / (g - 1) AS k0 FROM s)"


@query("feature_reproducibility", rsql("SELECT feature, greatest(-1, least(1, (msb - msw) / (msb + (k0 - 1) * msw))) AS icc FROM b", "icc", 5, f"{WC}, {_ICC}"), 5)
def icc(spark, sf):
    return S.icc(T.cells(spark, sf), ["q", "d", "t"], ["pert"])


_KW = f"l AS (SELECT feature, plate, value FROM ({LONG}) WHERE value IS NOT NULL), r AS (SELECT feature, plate, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature, value) AS t FROM l), tie AS (SELECT feature, sum(CAST(t AS DOUBLE) * t - 1) AS t, count(*)::DOUBLE AS n FROM r GROUP BY feature), g AS (SELECT feature, plate, sum(r) AS s, count(*) AS k FROM r GROUP BY feature, plate), x AS (SELECT feature, sum(s * s / k) AS ss, count(*) - 1 AS df FROM g GROUP BY feature)"


@query("feature_batch_sensitivity", rsql("SELECT x.feature, (12.0 / (n * (n + 1)) * ss - 3.0 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, df FROM x JOIN tie USING (feature)", "h", 3, f"{WC}, {_KW}"), 3)
def kruskal(spark, sf):
    return S.kruskal(T.cells(spark, sf), FEATURES, "plate", p_values=False)


@query("feature_batch_sensitivity_pvalues", digits=4)
def kruskal_p(spark, sf):
    return S.kruskal(T.cells(spark, sf), FEATURES, "plate")


_XI = f"l AS (SELECT id, pert, unnest(['q','p','d','t']) AS feature, unnest([q,p,d,t]) AS value FROM wells), r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r, row_number() OVER (PARTITION BY feature ORDER BY pert, id) AS o, count(*) OVER (PARTITION BY feature) AS n FROM l WHERE value IS NOT NULL), s AS (SELECT feature, n, coalesce(least(r, lead(r) OVER (PARTITION BY feature ORDER BY o)), r) AS s FROM r)"


@query("feature_select_chatterjee", rsql("SELECT feature, max(n) AS n, -2.0 + 6.0 * sum(s) / ((max(n) + 1.0) * (max(n) + 0.5)) AS xi FROM s GROUP BY feature", "xi", prefix=f"{WW}, {_XI}"))
def chatterjee(spark, sf):
    return S.grouped_xi(T.wells(spark, sf), "pert", FEATURES, "id")


# ---------------------------------------------------------------- aggregation


@query("aggregate_wells", rsql(f"SELECT plate, well, count(*) AS Metadata_CellCount, count(DISTINCT supp) AS Metadata_SiteCount, {each('median(@) AS @')} FROM cells GROUP BY plate, well HAVING count(*) >= 10", "q p d t", prefix=WC))
def aggregate_wells(spark, sf):
    return A.aggregate(T.cells(spark, sf), FEATURES, ["plate", "well"], site=["supp"])


@query("consensus_median", rsql(f"SELECT well, pert, count(*) AS Metadata_ReplicateCount, {each('median(@) AS @')} FROM wells GROUP BY well, pert HAVING count(*) >= 2", "q p d t", prefix=WW))
def consensus_median(spark, sf):
    return A.consensus_median(T.wells(spark, sf), FEATURES, ["well", "pert"])


_MZ = "w AS (SELECT well || pert AS g, plate AS o, [q, p / 10000, d * 100, t * 100] AS v FROM wells), a AS (SELECT g, o, unnest(v) AS x, unnest([1, 2, 3, 4]) AS k FROM w), pr AS (SELECT x.g, x.o, y.o AS o2, corr(x.x, y.x) AS r FROM a x JOIN a y ON x.g = y.g AND x.k = y.k AND x.o <> y.o GROUP BY x.g, x.o, y.o), raw AS (SELECT g, o, avg(greatest(0, coalesce(r, 0))) AS raw FROM pr GROUP BY g, o), wt AS (SELECT w.g, w.o, w.v, greatest(0.01, coalesce(raw, 1)) AS raw FROM w LEFT JOIN raw USING (g, o)), wn AS (SELECT *, round(raw / sum(raw) OVER (PARTITION BY g), 4) AS weight FROM wt)"


@query("consensus_modz", rsql("SELECT g, count(*) AS Metadata_ReplicateCount, sum(weight * v[1]) AS q, sum(weight * v[2]) AS p, sum(weight * v[3]) AS d, sum(weight * v[4]) AS t FROM wn GROUP BY g HAVING count(*) >= 2", "q p d t", prefix=f"{WW}, {_MZ}"))
def consensus_modz(spark, sf):
    w = T.wells(spark, sf).select(F.concat("well", "pert").alias("g"), F.col("plate").alias("o"), "q", (F.col("p") / 10000).alias("p"), (F.col("d") * 100).alias("d"), (F.col("t") * 100).alias("t"))
    return A.consensus_modz(w, FEATURES, "g", "o", method="pearson")


@query("viability", rsql("SELECT id, n / (SELECT median(n) FROM wells w2 WHERE w2.control AND w2.plate = w.plate) AS viability FROM wells w", "viability", prefix=WW))
def viability(spark, sf):
    return A.viability(T.wells(spark, sf), "n", F.col("control"), ["plate"]).select("id", "viability")


_COMP = 'c AS (SELECT "user" AS usr, control, cluster, count(*) AS n FROM pop GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT "user" AS usr, control FROM pop), (SELECT DISTINCT cluster FROM pop)), f AS (SELECT g.usr, g.control, g.cluster, coalesce(c.n, 0) AS n FROM g LEFT JOIN c USING (usr, control, cluster))'


@query("cluster_composition", rsql("SELECT usr, cluster, n, n / sum(n) OVER (PARTITION BY usr) AS fraction FROM f", "fraction", prefix=f"{WP}, {_COMP}"))
def cluster_composition(spark, sf):
    return A.cluster_composition(T.populations(spark, sf), "cluster", ["user"]).select(F.col("user").alias("usr"), "cluster", "n", "fraction")


@query("cluster_composition_test", rsql("SELECT usr, sum((n - e) ** 2 / e) AS chi2, count(*) - 1 AS dof FROM (SELECT f.usr, f.n, sum(f.n) OVER (PARTITION BY f.usr) * s.share AS e FROM f JOIN (SELECT cluster, sum(n) / (SELECT sum(n) FROM f WHERE control) AS share FROM f WHERE control GROUP BY cluster) s USING (cluster)) GROUP BY usr", "chi2", prefix=f"{WP}, {_COMP}"))
def composition_chi2(spark, sf):
    comp = A.cluster_composition(T.populations(spark, sf), "cluster", ["user", "control"])
    return A.composition_test(comp, "cluster", ["user", "control"], F.col("control"), p_values=False).select(F.col("user").alias("usr"), "chi2", "dof")


@query("cluster_composition_pvalues")
def composition_p(spark, sf):
    comp = A.cluster_composition(T.populations(spark, sf), "cluster", ["user", "control"])
    return A.composition_test(comp, "cluster", ["user", "control"], F.col("control"))


_EFF = f"e AS (SELECT pert AS grp, feature, avg(value) AS effect FROM ({LONG}) WHERE feature <> 'p' GROUP BY pert, feature)"


@query("feature_signature", rsql("SELECT grp, avg(effect) FILTER (feature = 'q') AS amount, avg(effect) FILTER (feature <> 'q') AS rate FROM e GROUP BY grp", "amount rate", prefix=f"{WC}, {_EFF}"))
def feature_signature(spark, sf):
    eff = ST.to_long(T.cells(spark, sf), ["pert"], ["q", "d", "t"]).groupBy(F.col("pert").alias("grp"), "feature").agg(F.avg("value").alias("effect"))
    fam = spark.createDataFrame([("q", "amount"), ("d", "rate"), ("t", "rate")], "feature string, family string")
    return A.feature_signature(eff, fam, "grp", "effect", levels=["amount", "rate"])


# ---------------------------------------------------------------- pairs and retrieval


def _pairs(spark, sf, ordered=True, metric="cosine", **cut):
    return P.similarity_pairs(T.embedded(spark, sf), "vec_id", "v", metric, ["label", "batch", "control"], ordered=ordered, **cut)


@query("similarity_top", rsql("SELECT i, j, sim FROM (SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM pairs) WHERE r <= 5", "sim", prefix=PAIRS))
def similarity_top(spark, sf):
    return _pairs(spark, sf, k=5).select("i", "j", "sim")


@query("nearest_rows", rsql("SELECT id, o_id, r, d FROM (SELECT a.vec_id AS id, b.vec_id AS o_id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE r <= 8", "d", prefix=f"WITH e AS ({EMBEDDED})"))
def nearest_rows(spark, sf):
    """The eight nearest rows of every row, by cells around pivots."""
    return TI.nearest_neighbours(T.embedded(spark, sf), "vec_id", "v", 8).select("id", "o_id", F.col("r").cast("long").alias("r"), "d")


@query("similarity_pearson", rsql(f"WITH e AS ({EMBEDDED}), c AS (SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS v FROM e), u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS n FROM c) SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.v, b.v) / (a.n * b.n) AS sim FROM u a JOIN u b ON a.vec_id < b.vec_id", "sim"))
def similarity_pearson(spark, sf):
    return P.similarity_pairs(T.embedded(spark, sf), "vec_id", "v", "pearson").select("i", "j", "sim")


@query("replicate_similarity", rsql('SELECT label_i AS "group", median(sim) AS median_sim, count(*) AS n_pairs FROM pairs WHERE i < j AND label_i = label_j GROUP BY label_i', "median_sim", prefix=PAIRS))
def replicate_similarity(spark, sf):
    return P.replicate_medians(T.embedded(spark, sf), "vec_id", "v", "label").select("group", F.col("median").alias("median_sim"), F.col("n").alias("n_pairs"))


@query("percent_replicating")
def percent_replicating(spark, sf):
    return P.replicating_rows(T.embedded(spark, sf), "vec_id", "v", "label", 200)


@query("grit", rsql('SELECT label AS "group", avg(g) AS grit, count(*) AS n FROM (SELECT p.i, p.label_i AS label, avg((p.sim - c.m) / c.s) AS g FROM pairs p JOIN (SELECT i, avg(sim) AS m, stddev_samp(sim) AS s FROM pairs WHERE control_j GROUP BY i HAVING count(*) >= 2) c USING (i) WHERE p.label_i = p.label_j AND NOT p.control_i AND c.s > 0 GROUP BY p.i, p.label_i) GROUP BY label', "grit", 5, PAIRS), 5)
def grit(spark, sf):
    return P.grit_rows(T.embedded(spark, sf), "vec_id", "v", "label", "control")


_NN1 = "nn AS (SELECT i, label_i AS actual, label_j AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM pairs{w}) WHERE r = 1)"


@query("nn_moa_confusion", f"{PAIRS}, {_NN1.format(w=' WHERE batch_i <> batch_j')} SELECT actual, predicted, count(*) AS n FROM nn GROUP BY actual, predicted")
def nn_moa(spark, sf):
    return P.confusion(P.nearest_mechanism(T.embedded(spark, sf), "vec_id", "v", "label", "nsc", compound="batch"))


@query("nn_moa_accuracy", rsql("SELECT avg((actual = predicted)::INT) AS accuracy, count(*) AS n_classified, (SELECT count(*) FROM e) - count(*) AS n_excluded FROM nn", "accuracy", prefix=f"{PAIRS}, {_NN1.format(w='')}"))
def nn_accuracy(spark, sf):
    return P.accuracy(P.nearest_mechanism(T.embedded(spark, sf), "vec_id", "v", "label"), T.embedded(spark, sf).count())


@query("moa_enrichment_votes", f"{PAIRS}, nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM pairs) WHERE r <= 10), sz AS (SELECT label AS moa, count(*) AS size FROM e GROUP BY label) SELECT i, label_j AS moa, count(*) AS votes, any_value(sz.size) - (label_i = label_j)::INT AS marked, (SELECT count(*) FROM e) - 1 AS n_other FROM nn JOIN sz ON sz.moa = label_j GROUP BY i, label_i, label_j")
def moa_votes(spark, sf):
    return P.moa_enrichment(_pairs(spark, sf), "label", 10, p_values=False)


@query("moa_enrichment")
def moa_enrichment(spark, sf):
    return P.moa_enrichment(_pairs(spark, sf), "label", 10)


_DENS = "SELECT row_id, x, y, fld FROM (SELECT p_partkey AS row_id, p_partkey % 97 * 1.0 AS x, p_partkey % 89 * 1.0 AS y, p_brand AS fld FROM part)"


@query("neighbors_local_density", rsql("SELECT pts.row_id, k / (pi() * nullif(d2, 0)) AS density FROM pts LEFT JOIN (SELECT i, max(r) AS k, max(d2) AS d2 FROM (SELECT a.row_id AS i, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2, row_number() OVER (PARTITION BY a.row_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.row_id) AS r FROM pts a JOIN pts b ON a.fld = b.fld AND a.row_id <> b.row_id) WHERE r <= 15 GROUP BY i) n ON n.i = pts.row_id", "density", prefix=f"WITH pts AS ({_DENS})"))
def local_density(spark, sf):
    pts = T.read(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") % 97 * 1.0).cast("double").alias("x"), (F.col("p_partkey") % 89 * 1.0).cast("double").alias("y"), F.col("p_brand").alias("fld"))
    return P.local_density(pts, "row_id", "x", "y", ["fld"])


_NET = "edges AS (SELECT DISTINCT least(l_partkey % 500, l_suppkey) AS ga, greatest(l_partkey % 500, l_suppkey) AS gb FROM lineitem WHERE l_partkey % 500 <> l_suppkey), nodes AS (SELECT ga AS g FROM edges UNION SELECT gb FROM edges), pp AS (SELECT * FROM pairs WHERE i < j AND i IN (SELECT g FROM nodes) AND j IN (SELECT g FROM nodes)), cut AS (SELECT quantile_cont(sim, 0.95) AS cut FROM pp), m AS (SELECT sim >= cut AS top, ga IS NOT NULL AS known FROM pp LEFT JOIN edges ON ga = least(i, j) AND gb = greatest(i, j), cut)"


@query("network_enrichment", rsql("SELECT *, (top_known + 0.5) * (rest_other + 0.5) / ((top_other + 0.5) * (rest_known + 0.5)) AS odds_ratio FROM (SELECT count(*) FILTER (top AND known) AS top_known, count(*) FILTER (top AND NOT known) AS top_other, count(*) FILTER (NOT top AND known) AS rest_known, count(*) FILTER (NOT top AND NOT known) AS rest_other FROM m)", "odds_ratio", prefix=f"{PAIRS}, {_NET}"))
def network(spark, sf):
    li = T.read(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("a"), F.col("l_suppkey").alias("b"))
    return P.network_rows(T.embedded(spark, sf).withColumn("gene", F.col("vec_id")), "vec_id", "v", "gene", li, p_values=False)


@query("known_relationships", rsql("SELECT count(*) AS n_related, avg((low <= 0.05 OR high >= 0.95)::INT) AS recall FROM (SELECT i, j, label_i, label_j, cume_dist() OVER (ORDER BY sim) AS low, (rank() OVER (ORDER BY sim) - 1) / (count(*) OVER ()) AS high FROM pairs WHERE i < j) WHERE label_i = label_j", "recall", prefix=PAIRS))
def known_relationships(spark, sf):
    return P.known_relationships_rows(T.embedded(spark, sf), "vec_id", "v", "label")


@query("pathway_coherence", rsql("SELECT 's' || (label_i % 3) AS source, avg(sim) AS coherence, (SELECT count(*) FROM e WHERE label % 3 = any_value(label_i) % 3) AS n_genes FROM pairs WHERE i < j AND label_i % 3 = label_j % 3 GROUP BY label_i % 3", "coherence", prefix=PAIRS))
def pathway_coherence(spark, sf):
    e = T.embedded(spark, sf)
    sets = e.select(F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("source"), F.col("vec_id").alias("target"))
    p = _pairs(spark, sf, ordered=False).withColumns({"g_i": F.col("i"), "g_j": F.col("j")})
    return P.pathway_coherence(p, sets, "g")


_AP = "r AS (SELECT i, positive, row_number() OVER w AS rank, sum(positive::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM rp WINDOW w AS (PARTITION BY i ORDER BY sim DESC, positive DESC, j)), ap AS (SELECT i, avg(hits / rank) FILTER (positive) AS ap, CAST(sum(positive::INT) AS BIGINT) AS n_pos, count(*) AS n_total FROM r GROUP BY i HAVING sum(positive::INT) > 0 AND count(*) > sum(positive::INT)), h AS (SELECT ap.*, (SELECT sum(1.0::DOUBLE / k) FROM range(1, ap.n_total + 1) t(k)) AS hh FROM ap), mu AS (SELECT *, ((n_pos - 1) / (n_total - 1) * (n_total - hh) + hh) / n_total AS mu FROM h), nap AS (SELECT i, ap, n_pos, n_total, greatest(-1, least(1, (ap - mu) / (1 - mu))) AS nap FROM mu)"


def _map_sql(pos: str, neg: str, rows: str = "TRUE") -> str:
    return rsql("SELECT e.label, avg(ap) AS score, avg(nap) AS mean_normalized_average_precision, count(*) AS n FROM nap JOIN e ON e.vec_id = i GROUP BY e.label", "score mean_normalized_average_precision", prefix=f"{PAIRS}, rp AS (SELECT i, j, sim, ({pos}) AS positive FROM pairs WHERE (({pos}) OR ({neg})) AND {rows}), {_AP}")


def _map(spark, sf, **rules):
    e = T.embedded(spark, sf)
    ap = P.average_precision_rows(e.withColumn("treated", ~F.col("control")), "vec_id", "v", **rules)
    return P.map_scores(ap, e.select(F.col("vec_id").alias("i"), "label"), "label")


@query("map_activity", _map_sql("label_i = label_j", "batch_i = batch_j AND control_j", "NOT control_i"))
def map_activity(spark, sf):
    """The negatives of a treated row are the controls of its batch."""
    return _map(spark, sf, pos_sameby=["label"], neg_sameby=["batch"], asked="treated", reference="control")


@query("map_consistency", _map_sql("label_i = label_j", "label_i <> label_j AND batch_i = batch_j"))
def map_consistency(spark, sf):
    return _map(spark, sf, pos_sameby=["label"], neg_sameby=["batch"], neg_diffby=["label"])


@query("map_replicability", _map_sql("label_i = label_j", "label_i <> label_j"))
def map_replicability(spark, sf):
    return _map(spark, sf, pos_sameby=["label"], neg_diffby=["label"])


@query("map_cross_batch", _map_sql("label_i = label_j AND batch_i <> batch_j", "label_i <> label_j AND batch_i <> batch_j"))
def map_cross_batch(spark, sf):
    return _map(spark, sf, pos_sameby=["label"], pos_diffby=["batch"], neg_diffby=["label", "batch"])


@query("map_multilabel", _map_sql("label_i = label_j OR label_i % 4 = label_j % 4", "NOT (label_i = label_j OR label_i % 4 = label_j % 4)"))
def map_multilabel(spark, sf):
    e = T.embedded(spark, sf).withColumn("tags", F.array(F.concat(F.lit("a"), F.col("label").cast("string")), F.concat(F.lit("b"), (F.col("label") % 4).cast("string"))))
    ap = P.average_precision_rows(e, "vec_id", "v", label_sets="tags")
    return P.map_scores(ap, e.select(F.col("vec_id").alias("i"), "label"), "label")


@query("map_joint_pvalues")
def map_joint(spark, sf):
    """Consistency within batches, against draws of all of a label's members together."""
    e = T.embedded(spark, sf)
    p = P.map_pairs(_pairs(spark, sf, rules=[(["label"], []), (["batch"], ["label"])]), ["label"], [], ["batch"], ["label"])
    return NU.joint_null_pvalues(P.average_precision(p), e.select(F.col("vec_id").alias("i"), "label"), "label", p.where("positive"), 512)


@query("map_rule_permutation_pvalues")
def map_rule_permutation(spark, sf):
    """The same scores against labels that are dealt anew within batches."""
    e = T.embedded(spark, sf)
    return NU.permutation_null_rows(e, "vec_id", "v", "label", neg_sameby=["batch"], n_permutations=50)


@query("map_permutation_pvalues")
def map_permutation(spark, sf):
    return P.map_permutation_rows(T.embedded(spark, sf), "vec_id", "v", "label", 20)


@query("map_pvalues")
def map_p(spark, sf):
    e = T.embedded(spark, sf)
    ap = P.average_precision_rows(e, "vec_id", "v", pos_sameby=["label"], neg_sameby=["batch"], neg_diffby=["label"])
    return P.map_null_pvalues(ap, e.select(F.col("vec_id").alias("i"), "label"), "label", 500)


# ---------------------------------------------------------------- effects and hits

_CD = " UNION ALL ".join(f'SELECT t.pert AS "group", \'{f}\' AS feature, (t.m - c.m) / nullif(sqrt(((t.n - 1) * t.v + (c.n - 1) * c.v) / (t.n + c.n - 2)), 0) AS effect FROM (SELECT pert, count(*) AS n, avg({f}) AS m, var_samp({f}) AS v FROM cells WHERE NOT control GROUP BY pert) t, (SELECT count(*) AS n, avg({f}) AS m, var_samp({f}) AS v FROM cells WHERE control) c' for f in FEATURES)


@query("effect_size_cohens_d", rsql(_CD, "effect", prefix=WC))
def cohens_d(spark, sf):
    return E.cohens_d(T.cells(spark, sf), FEATURES, "pert", F.col("control"))


@query("effect_size_robust_z", rsql(f'SELECT t.pert AS "group", t.feature, (t.m - c.m) / nullif(c.s * 1.4826::DOUBLE, 0) AS effect FROM (SELECT pert, feature, median(value) AS m FROM ({LONG}) WHERE NOT control GROUP BY pert, feature) t JOIN (SELECT l.feature, any_value(m.m) AS m, median(abs(l.value - m.m)) AS s FROM ({LONG}) l JOIN (SELECT feature, median(value) AS m FROM ({LONG}) WHERE control GROUP BY feature) m USING (feature) WHERE l.control GROUP BY l.feature) c USING (feature)', "effect", prefix=WC))
def robust_effect(spark, sf):
    return E.robust_effect(T.cells(spark, sf), FEATURES, "pert", F.col("control"))


_MW = "l AS (SELECT pert, control, unnest(['q','p','d','t']) AS feature, unnest([q,p,d,t]) AS value FROM wells), g AS (SELECT DISTINCT pert AS grp FROM wells WHERE NOT control), b AS (SELECT grp, feature, value, control FROM l, g WHERE value IS NOT NULL AND (control OR pert = grp)), r AS (SELECT *, rank() OVER (PARTITION BY grp, feature ORDER BY value) + (count(*) OVER (PARTITION BY grp, feature, value) - 1) / 2.0 AS r FROM b)"


@query("mann_whitney_u", rsql('SELECT grp AS "group", feature, sum(r) FILTER (NOT control) - count(*) FILTER (NOT control) * (count(*) FILTER (NOT control) + 1) / 2.0 AS u, count(*) FILTER (NOT control) AS n1, count(*) FILTER (control) AS n2 FROM r GROUP BY grp, feature', "u", prefix=f"{WW}, {_MW}"))
def mann_whitney_u(spark, sf):
    return E.mann_whitney(T.wells(spark, sf), FEATURES, "pert", F.col("control"), "id", p_values=False)


def _trios(spark, sf):
    """customer as groups of three treated rows without ties, the other two thirds being controls."""
    c = T.read(spark, sf, "customer")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.floor(F.col("c_custkey") / 9)).alias("trio"), (F.col("c_custkey") % 3 != 0).alias("control"), (F.col("c_acctbal") + F.col("c_custkey") / 1e7).alias("value"))


#: -log10 p of U among all ways to place three treated rows among the controls, counted one by one.
_TRIOS = """
WITH c AS (SELECT c_custkey, c_acctbal + c_custkey / 1e7::DOUBLE AS value FROM customer),
ctl AS (SELECT value FROM c WHERE c_custkey % 3 <> 0), n AS (SELECT count(*) AS n2 FROM ctl),
own AS (SELECT CAST(floor(c_custkey / 9.0) AS BIGINT) AS grp, value FROM c WHERE c_custkey % 3 = 0),
u AS (SELECT grp, sum((SELECT count(*) FROM ctl WHERE ctl.value < own.value)) AS u FROM own GROUP BY grp HAVING count(*) = 3),
low AS (SELECT grp, u, n2, CAST(least(u, 3 * n2 - u) AS BIGINT) AS lo FROM u, n),
ways AS (SELECT grp, u, n2, sum((SELECT sum(greatest(0, least(n2, lo - i - j) - j + 1)) FROM range(i, CAST(floor((lo - i) / 2) AS BIGINT) + 1) b(j) WHERE j <= n2)) AS w
         FROM low, range(0, n2 + 1) a(i) WHERE 3 * i <= lo GROUP BY grp, u, n2)
SELECT grp AS "group", CAST(u AS DOUBLE) AS u, CAST(n2 AS BIGINT) AS n2,
       round(-log10(least(1.0::DOUBLE, 2 * w / ((n2 + 3.0::DOUBLE) * (n2 + 2) * (n2 + 1) / 6))), 6) + 0.0 AS neg_log10_p FROM ways
"""


@query("mann_whitney_exact", _TRIOS)
def mann_whitney_exact(spark, sf):
    """Exact p-values of small groups against many controls."""
    out = E.mann_whitney(_trios(spark, sf), ["value"], "trio", F.col("control"), "c_custkey")
    return out.where("n1 = 3").select("group", "u", "n2", (F.round(-F.log10("pvalue"), 6) + 0.0).alias("neg_log10_p"))


@query("mann_whitney_pvalues")
def mann_whitney_p(spark, sf):
    return E.mann_whitney(T.wells(spark, sf), FEATURES, "pert", F.col("control"), "id")


_CUM = "x AS (SELECT grp, feature, value, sum((NOT control)::INT) AS ia, sum(control::INT) AS ib FROM b GROUP BY grp, feature, value), cc AS (SELECT grp, feature, value, sum(ia) OVER w AS na, sum(ib) OVER w AS nb, lead(value) OVER (PARTITION BY grp, feature ORDER BY value) - value AS step, sum(ia) OVER (PARTITION BY grp, feature) AS ta, sum(ib) OVER (PARTITION BY grp, feature) AS tb FROM x WINDOW w AS (PARTITION BY grp, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query("wasserstein_features", rsql('SELECT grp AS "group", feature, coalesce(sum(abs(na / ta - nb / tb) * step), 0) AS distance FROM cc GROUP BY grp, feature', "distance", 5, f"{WW}, {_MW}, {_CUM}"), 5)
def wasserstein(spark, sf):
    return E.wasserstein(T.wells(spark, sf), FEATURES, "pert", F.col("control"))


@query("ks_statistic", rsql("SELECT grp, max(abs(na / ta - nb / tb)) AS ks FROM cc WHERE feature = 'p' GROUP BY grp", "ks", prefix=f"{WW}, {_MW}, {_CUM}"))
def ks(spark, sf):
    w = T.wells(spark, sf)
    groups = w.where("not control").select(F.col("pert").alias("grp")).distinct()
    a = w.where("not control").select(F.col("pert").alias("grp"), F.col("p").alias("value"))
    b = w.where("control").select(F.col("p").alias("value")).crossJoin(F.broadcast(groups)).select("grp", "value")
    return E.ks_statistic(a, b, "value", ["grp"])


_EN = f"WITH e AS ({EMBEDDED}), m AS (SELECT a.label AS group_a, b.label AS group_b, avg(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS m FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.label <= b.label GROUP BY a.label, b.label)"


@query("energy_distance", rsql("SELECT m.group_a, m.group_b, 2 * m.m - x.m - y.m AS distance FROM m JOIN m x ON x.group_a = m.group_a AND x.group_b = m.group_a JOIN m y ON y.group_a = m.group_b AND y.group_b = m.group_b WHERE m.group_a < m.group_b", "distance", prefix=_EN))
def energy(spark, sf):
    return E.energy_distance(T.embedded(spark, sf), "vec_id", "v", "label")


@query("edistance_pvalues")
def edistance(spark, sf):
    return E.edistance(T.embedded(spark, sf), "vec_id", "v", "label", F.col("control"), 100)


_HIT = ["a", "b", "c"]


def _emb_wide(spark, sf, k=3):
    e = T.embedded(spark, sf)
    return e.select("vec_id", "label", "batch", "control", *[F.col("v")[i].alias(n) for i, n in enumerate("abcdefgh"[:k])])


@query("hit_calling_mahalanobis")
def hits(spark, sf):
    return E.hit_calling(_emb_wide(spark, sf, 6), list("abcdef"), "label", F.col("control"), "vec_id", n_permutations=200)


@query("hit_calling_replicates")
def hits_replicates(spark, sf):
    return E.hit_calling(_emb_wide(spark, sf, 6), list("abcdef"), "label", F.col("control"), "vec_id", n_permutations=200, replicate="batch")


@query("hit_calling_robust")
def hits_robust(spark, sf):
    """Distances in the covariance of the controls' concentrated half."""
    return E.hit_calling(_emb_wide(spark, sf, 6), list("abcdef"), "label", F.col("control"), "vec_id", n_permutations=200, covariance="robust")


@query("hit_calling_pseudogenes")
def hits_pseudogenes(spark, sf):
    return E.hit_calling(_emb_wide(spark, sf, 6), list("abcdef"), "label", F.col("control"), "vec_id", n_permutations=200, replicate="batch", null="pseudogenes", n_pseudogenes=20)


@query("hit_calling_ks")
def hits_ks(spark, sf):
    return E.hit_calling(_emb_wide(spark, sf, 6), list("abcdef"), "label", F.col("control"), "vec_id", "ks", 200)


@query("hellinger_mp_value")
def hellinger(spark, sf):
    return E.hellinger(_emb_wide(spark, sf), _HIT, "label", F.col("control"))


@query("differential_features")
def differential(spark, sf):
    return E.differential(_emb_wide(spark, sf, 8), list("abcdefgh"), "label", F.col("control"), "batch")


_GA = "l AS (SELECT id, control, unnest(['q','p','d','t']) AS feature, unnest([q,p,d,t]) AS value FROM wells), md AS (SELECT feature, median(value) AS m FROM l WHERE control GROUP BY feature), sd AS (SELECT l.feature, any_value(md.m) AS m, median(abs(l.value - md.m)) * 1.4826::DOUBLE AS s FROM l JOIN md USING (feature) WHERE control GROUP BY l.feature), a AS (SELECT id, control, sqrt(avg(((value - m) / s) ** 2)) AS activity FROM l JOIN sd USING (feature) WHERE s > 1e-9 AND value IS NOT NULL GROUP BY id, control)"


@query("guide_activity", rsql("SELECT id, activity, CASE WHEN NOT control THEN ((SELECT count(*) FROM a r WHERE r.control AND r.activity >= a.activity) + 1.0) / ((SELECT count(*) FROM a WHERE control) + 1.0) END AS pvalue FROM a", "activity pvalue", prefix=f"{WW}, {_GA}"))
def guide_activity(spark, sf):
    return E.guide_activity(T.wells(spark, sf), FEATURES, F.col("control"), "id")


_FDR = "s AS (SELECT guide, gene, control, z FROM guides), k AS (SELECT guide, z, (SELECT count(*) FROM s c WHERE c.control AND c.z >= s.z) AS cge, (SELECT count(*) FROM s c WHERE NOT c.control AND c.z >= s.z) AS tge, (SELECT count(*) FROM s WHERE control) AS nc, (SELECT count(*) FROM s WHERE NOT control) AS nt FROM s WHERE NOT control), f AS (SELECT *, (cge + 1.0) / (nc + 1.0) AS pvalue, (cge / nc) / (tge / nt) AS fdr FROM k), m AS (SELECT *, min(fdr) OVER (ORDER BY z RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mono FROM f)"


@query("empirical_fdr", rsql("SELECT guide, z, pvalue, least(1.0, greatest(mono, pvalue)) AS qvalue, pvalue <= 0.05 AS is_hit FROM m", "z pvalue qvalue", prefix=f"{WG}, {_FDR}"))
def empirical_fdr(spark, sf):
    return E.empirical_fdr(T.guides(spark, sf), "z", F.col("control"), "guide", 0.05)


@query("combine_fisher", rsql("SELECT gene, count(pvalue) AS n, -2.0 * sum(ln(greatest(1e-12, least(1 - 1e-12, pvalue)))) AS statistic FROM guides GROUP BY gene", "statistic", prefix=WG))
def combine_fisher(spark, sf):
    return E.combine(T.guides(spark, sf), "pvalue", ["gene"], "fisher", p_values=False)


@query("combine_order", rsql("SELECT gene, n, pvalue AS statistic FROM (SELECT gene, pvalue, row_number() OVER (PARTITION BY gene ORDER BY pvalue NULLS LAST) AS r, count(pvalue) OVER (PARTITION BY gene) AS n FROM guides) WHERE r = floor(n / 2) + 1 AND n > 0", "statistic", prefix=WG))
def combine_order(spark, sf):
    return E.combine(T.guides(spark, sf), "pvalue", ["gene"], "order", p_values=False)


@query("combine_stouffer")
def combine_stouffer(spark, sf):
    return E.combine(T.guides(spark, sf), "pvalue", ["gene"], "stouffer")


@query("aggregate_guides")
def aggregate_guides(spark, sf):
    return E.aggregate_guides(T.guides(spark, sf), "pvalue", "gene", F.col("control"), "guide", n_null=1000)


_BOOT = "med AS (SELECT supp AS guide, count(*) AS n, quantile_disc(d, 0.5) AS med FROM cells WHERE NOT control GROUP BY supp)"


def _guide_bootstrap(spark, sf, feature):
    c = T.cells(spark, sf).withColumn("gene", F.col("supp") % 8)
    return E.bootstrap_medians(c.withColumn("supp", F.when(F.col("control"), -F.col("supp")).otherwise(F.col("supp"))), feature, "supp", "gene", F.col("control"))


@query("bootstrap_lower_medians", rsql("SELECT guide, n, med FROM med", "med", prefix=f"{WC}, {_BOOT}"))
def bootstrap_medians_only(spark, sf):
    c = T.cells(spark, sf).withColumn("gene", F.col("supp") % 8)
    return E.guide_medians(c, "d", "supp", "gene", F.col("control")).select(F.col("supp").alias("guide"), "n", F.col("median").alias("med"))


def _bootstrap(spark, sf, features, **kind):
    """Genes of several suppliers as guides; the control cells of a supplier are a control guide."""
    c = T.cells(spark, sf).withColumns({"gene": F.col("supp") % 8, "arm": F.col("moa")})
    return B.bootstrap(c, features, "gene", "supp", F.col("control"), **kind)


_BG = f"""
{WC}, l AS (SELECT supp, control, unnest(['d','q']) AS feature, unnest([d,q]) AS value FROM cells),
own AS (SELECT supp, feature, count(value) AS n, quantile_disc(value, 0.5) AS x FROM l WHERE NOT control AND value IS NOT NULL GROUP BY supp, feature),
cnt AS (SELECT o.supp, o.feature, o.n, CAST(floor((o.n - 1) / 2) AS BIGINT) AS need, c.supp AS ctl, count(*) AS m,
               count(*) FILTER (c.value <= o.x) / count(*) AS fle, count(*) FILTER (c.value < o.x) / count(*) AS flt
        FROM own o JOIN l c ON c.feature = o.feature AND c.control AND c.value IS NOT NULL GROUP BY o.supp, o.feature, o.n, c.supp),
tails AS (SELECT *, {", ".join(f"CASE WHEN {f} <= 0 THEN 1.0 WHEN {f} >= 1 THEN 0.0 ELSE list_sum(list_transform(range(0, need + 1), lambda c: exp(lgamma(n + 1) - lgamma(c + 1) - lgamma(n - c + 1) + c * ln({f}) + (n - c) * ln(1 - {f})))) END AS {o}" for f, o in (("fle", "gt"), ("flt", "ge")))} FROM cnt),
up AS (SELECT supp, feature, n, sum(m * (gt + ge) / 2) / sum(m) AS up FROM tails GROUP BY supp, feature, n)
"""


@query("bootstrap_guides", rsql("SELECT supp, feature, n AS n_measured, 2 * least(up, 1 - up) AS pvalue FROM up", "pvalue", prefix=_BG))
def bootstrap_guides(spark, sf):
    """Every guide against the exact null of resampling control guides."""
    c = T.cells(spark, sf).withColumn("gene", F.col("supp") % 8)
    n = ST.to_long(c.where("not control"), ["supp"], ["d", "q"]).groupBy("supp", "feature").agg(F.count(F.lit(1)).alias("n_measured"))
    return _bootstrap(spark, sf, ["d", "q"])[1].join(n, ["supp", "feature"]).select("supp", "feature", "n_measured", "pvalue")


@query("bootstrap_genes_stouffer")
def bootstrap_genes_stouffer(spark, sf):
    return _bootstrap(spark, sf, ["d", "q"])[0]


@query("bootstrap_genes_order")
def bootstrap_genes_order(spark, sf):
    return _bootstrap(spark, sf, ["d", "q"], method="order", scope="within_group", condition="arm")[0]


@query("bootstrap_genes_fisher")
def bootstrap_genes_fisher(spark, sf):
    return _bootstrap(spark, sf, ["d", "q"], method="fisher", scope="reference_group", condition="arm", reference_condition="O")[0]


@query("bootstrap_genes_median")
def bootstrap_genes_median(spark, sf):
    return _bootstrap(spark, sf, ["d", "q"], method="median")[0]


@query("bootstrap_features")
def bootstrap_features(spark, sf):
    return E.bootstrap_genes(_guide_bootstrap(spark, sf, "p"), "gene")


@query("guide_qc_flags", rsql("SELECT guide, gene, coalesce(pvalue >= 0.3 AND s - sg >= 1 AND (s - sg) * 2 >= k - 1, FALSE) AS inactive, cells < 10 AS thin FROM (SELECT *, coalesce((pvalue < 0.3)::INT, 0) AS sg, count(*) OVER (PARTITION BY gene) AS k, sum(coalesce((pvalue < 0.3)::INT, 0)) OVER (PARTITION BY gene) AS s FROM guides)", "", prefix=WG))
def guide_qc(spark, sf):
    return E.guide_qc(T.guides(spark, sf), "gene", "guide", "pvalue", "z", "cells", 0.3).select("guide", "gene", "inactive", "thin")


@query("guide_qc_summary", rsql("SELECT gene, n_guides, n_significant, q, df, CASE WHEN q > 0 THEN greatest(0, (q - df) / q) ELSE 0 END AS i2, n_guides = 1 AS single_guide FROM (SELECT gene, count(*) AS n_guides, count(*) FILTER (pvalue < 0.05) AS n_significant, sum(z * z) - sum(sqrt(cells) * z) ** 2 / sum(cells) AS q, count(*) - 1 AS df FROM guides GROUP BY gene)", "q i2", prefix=WG))
def guide_summary(spark, sf):
    return E.guide_summary(T.guides(spark, sf), "gene", "pvalue", "z", "cells", p_values=False)


@query("cytotoxicity", rsql('SELECT pert || well AS "group", median(n) AS viability, median(d) AS distance, median(n) < 60 AND median(d) > (SELECT median(d) FROM wells WHERE control) AS suspect FROM wells WHERE NOT control GROUP BY pert, well', "viability distance", prefix=WW))
def cytotoxicity(spark, sf):
    w = T.wells(spark, sf).withColumns({"g": F.concat("pert", "well"), "v": F.col("n").cast("double")})
    return E.cytotoxicity(w, "g", "v", "d", F.col("control"), 60)


_TR = "c AS (SELECT plate, median(q) AS q, median(p) / 10000 AS p, median(d) * 100 AS d, median(t) * 100 AS t FROM cells WHERE control GROUP BY plate), x AS (SELECT plate, well AS g, median(q) AS q, median(p) / 10000 AS p, median(d) * 100 AS d, median(t) * 100 AS t FROM cells WHERE NOT control GROUP BY plate, well), e AS (SELECT plate, g, unnest([x.q - c.q, x.p - c.p, x.d - c.d, x.t - c.t]) AS v, unnest([1, 2, 3, 4]) AS k FROM x JOIN c USING (plate)), nm AS (SELECT plate, g, sqrt(sum(v * v)) AS nm FROM e GROUP BY plate, g), pr AS (SELECT a.g, a.plate AS s1, b.plate AS s2, corr(a.v, b.v) AS r FROM e a JOIN e b ON a.g = b.g AND a.k = b.k AND a.plate < b.plate GROUP BY a.g, a.plate, b.plate)"


@query("transport_agreement", rsql('SELECT pr.g AS "group", sum(least(x.nm, y.nm) * r) / sum(least(x.nm, y.nm)) AS agreement, count(*) AS n_pairs FROM pr JOIN nm x ON x.plate = s1 AND x.g = pr.g JOIN nm y ON y.plate = s2 AND y.g = pr.g WHERE r IS NOT NULL GROUP BY pr.g HAVING count(*) >= 3', "agreement", 5, f"{WC}, {_TR}"), 5)
def transport(spark, sf):
    c = T.cells(spark, sf).withColumns({"p": F.col("p") / 10000, "d": F.col("d") * 100, "t": F.col("t") * 100})
    return E.transport(c, FEATURES, "plate", "well", F.col("control"), p_values=False)


@query("transport_pvalues")
def transport_p(spark, sf):
    c = T.cells(spark, sf).withColumns({"p": F.col("p") / 10000, "d": F.col("d") * 100, "t": F.col("t") * 100})
    return E.transport(c, FEATURES, "plate", "well", F.col("control"))


@query("roc_auc", rsql("SELECT plate, (sum(r) FILTER (control) - count(*) FILTER (control) * (count(*) FILTER (control) + 1) / 2.0) / (count(*) FILTER (control) * count(*) FILTER (NOT control)) AS auc FROM (SELECT plate, control, rank() OVER (PARTITION BY plate ORDER BY p) + (count(*) OVER (PARTITION BY plate, p) - 1) / 2.0 AS r FROM cells) GROUP BY plate", "auc", prefix=WC))
def roc_auc(spark, sf):
    return E.roc_auc(T.cells(spark, sf), "p", F.col("control"), ["plate"])


@query("perturbation_score")
def perturbation_score(spark, sf):
    return PS.perturbation_score(_emb_wide(spark, sf, 8), list("abcdefgh"), "label", F.col("control"), "vec_id", 6, min_cells=20, replicate="batch")[0]


@query("replicate_saturation")
def saturation(spark, sf):
    return E.replicate_saturation(_emb_wide(spark, sf, 8), list("abcdefgh"), "label", "vec_id", 8)


# ---------------------------------------------------------------- dose response

_DU = "ok AS (SELECT compound FROM doses WHERE dose > 0 GROUP BY compound HAVING count(DISTINCT dose) >= {n})"


@query("dose_spearman", rsql("SELECT compound, count(*) AS n, corr(a, b) AS rho FROM (SELECT compound, rank() OVER (PARTITION BY compound ORDER BY dose) + (count(*) OVER (PARTITION BY compound, dose) - 1) / 2.0 AS a, rank() OVER (PARTITION BY compound ORDER BY f2) + (count(*) OVER (PARTITION BY compound, f2) - 1) / 2.0 AS b FROM doses WHERE dose > 0 AND compound IN (SELECT compound FROM ok)) GROUP BY compound", "rho", prefix=f"{WD}, {_DU.format(n=2)}"))
def dose_spearman(spark, sf):
    return D.spearman(T.doses(spark, sf), "compound", "dose", "f2", p_values=False)


@query("dose_response")
def dose_response(spark, sf):
    return D.dose_response(T.doses(spark, sf), "compound", "dose", "f2")


@query("dose_hitcall")
def dose_hitcall(spark, sf):
    return D.hit_call(T.doses(spark, sf), "compound", "dose", "f2", 3.0)


_DZ = "l AS (SELECT row_id, compound, dose, control, half, unnest(['f1','f2','f3']) AS feature, unnest([f1,f2,f3]) AS value FROM doses), md AS (SELECT feature, median(value) AS m FROM l WHERE control GROUP BY feature), sc AS (SELECT l.feature, any_value(md.m) AS m, median(abs(l.value - md.m)) * 1.4826::DOUBLE AS s FROM l JOIN md USING (feature) WHERE l.control GROUP BY l.feature), z AS (SELECT l.*, (value - m) / s AS z FROM l JOIN sc USING (feature) WHERE s > 1e-18 AND NOT control AND dose > 0 AND compound IN (SELECT compound FROM ok)), dm AS (SELECT compound, feature, dose, median(z) AS z FROM z GROUP BY compound, feature, dose)"
_DF = "cr AS (SELECT compound, feature, log10(dose) AS x, z, abs(z) AS b, lag(abs(z)) OVER w AS a, lag(log10(dose)) OVER w AS px, rank() OVER (PARTITION BY compound, feature ORDER BY dose) + (count(*) OVER (PARTITION BY compound, feature, dose) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY compound, feature ORDER BY z) + (count(*) OVER (PARTITION BY compound, feature, z) - 1) / 2.0 AS rz FROM dm WINDOW w AS (PARTITION BY compound, feature ORDER BY dose))"


@query("dose_features", rsql("SELECT compound, feature, 10 ** min(CASE WHEN b >= 0.5 AND a IS NULL THEN x WHEN b >= 0.5 AND a < 0.5 THEN px + (0.5 - a) / (b - a) * (x - px) END) AS bmd, max(b) AS max_z, corr(rx, rz) AS rho, count(*) AS n_doses FROM cr GROUP BY compound, feature", "bmd max_z rho", prefix=f"{WD}, {_DU.format(n=4)}, {_DZ}, {_DF}"))
def dose_features(spark, sf):
    return D.dose_features(T.doses(spark, sf), T.DOSE_FEATURES, "compound", "dose", F.col("control"), 0.5, p_values=False).drop("direction")


@query("dose_features_pvalues")
def dose_features_p(spark, sf):
    return D.dose_features(T.doses(spark, sf), T.DOSE_FEATURES, "compound", "dose", F.col("control"), 0.5)


_DD = "v AS (SELECT compound, dose, list(z ORDER BY feature) AS v FROM dm GROUP BY compound, dose), w AS (SELECT *, last_value(v) OVER (PARTITION BY compound ORDER BY dose ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top, lag(v) OVER (PARTITION BY compound ORDER BY dose) AS low FROM v)"


@query("dose_direction", rsql("SELECT compound, dose, sqrt(list_dot_product(v, v)) / sqrt(len(v)) AS amplitude, CASE WHEN low IS NULL THEN sqrt(list_dot_product(v, v)) ELSE list_distance(v, low) END / sqrt(len(v)) AS step, list_dot_product(v, top) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(top, top)), 0) AS cosine_to_top FROM w", "amplitude step cosine_to_top", prefix=f"{WD}, {_DU.format(n=2)}, {_DZ}, {_DD}"))
def dose_direction(spark, sf):
    return D.dose_direction(T.doses(spark, sf), T.DOSE_FEATURES, "compound", "dose", F.col("control"))


@query("dose_phases")
def dose_phases(spark, sf):
    d = T.doses(spark, sf)
    direction = D.dose_direction(d, T.DOSE_FEATURES, "compound", "dose", F.col("control"), F.col("half"))
    return D.label_phases(direction, D.null_amplitude(d, T.DOSE_FEATURES, F.col("control"), "row_id", 8, 50))


_TJ = "md AS (SELECT compound, feature, log10(dose) AS x, median(value) AS y FROM (SELECT compound, dose, unnest(['f1','f2','f3']) AS feature, unnest([f1,f2,f3]) AS value FROM doses WHERE dose > 0 AND compound IN (SELECT compound FROM ok)) GROUP BY compound, feature, dose), sp AS (SELECT *, min(x) OVER p AS lo, max(x) OVER p AS hi, count(*) OVER p AS n_doses FROM md WINDOW p AS (PARTITION BY compound, feature)), sg AS (SELECT *, (x - lo) / (hi - lo) AS u, lead((x - lo) / (hi - lo)) OVER w AS u2, lead(y) OVER w AS y2 FROM sp WHERE hi > lo WINDOW w AS (PARTITION BY compound, feature ORDER BY x)), spots AS (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS position)"


@query("dose_trajectory", rsql("SELECT compound, feature, n_doses, 10 ** lo AS window_low, 10 ** hi AS window_high, position, y + (position - u) / (u2 - u) * (y2 - y) AS value FROM sg, spots WHERE u2 IS NOT NULL AND position >= u AND (position < u2 OR (position = 1.0 AND u2 = 1.0))", "window_low window_high position value", prefix=f"{WD}, {_DU.format(n=2)}, {_TJ}"))
def dose_trajectory(spark, sf):
    return D.dose_trajectory(T.doses(spark, sf), T.DOSE_FEATURES, "compound", "dose")


# ---------------------------------------------------------------- enrichment and populations


def _gene_long(spark, sf):
    """Rows: regions of customers; features: nations of suppliers; values: sums of balances."""
    c = T.read(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("feature"), F.col("o_orderpriority").alias("row"), (F.col("o_totalprice") / 1000.0).alias("value"))
    return c.groupBy("row", F.concat(F.lit("g"), F.col("feature").cast("string")).alias("feature")).agg(F.round(F.avg("value"), 6).alias("value"))


_GL = "l AS (SELECT o_orderpriority AS \"row\", 'g' || (o_custkey % 40) AS feature, round(avg(o_totalprice / 1000.0), 6) AS value FROM orders GROUP BY o_orderpriority, o_custkey % 40), net AS (SELECT 's' || (k % 5) AS source, 'g' || k AS target, 1.0 + k % 3 AS weight FROM range(40) t(k))"


def _net(spark):
    k = F.col("id")
    return spark.range(40).select(F.concat(F.lit("s"), (k % 5).cast("string")).alias("source"), F.concat(F.lit("g"), k.cast("string")).alias("target"), (1.0 + k % 3).cast("double").alias("weight"))


_ULM = "tt AS (SELECT \"row\", count(*) AS n, sum(value) AS sy, sum(value * value) AS syy FROM l GROUP BY \"row\"), st AS (SELECT source, sum(weight) AS sx, sum(weight * weight) AS sxx FROM net GROUP BY source), h AS (SELECT \"row\", source, sum(weight * value) AS sxy FROM l JOIN net ON target = feature GROUP BY \"row\", source), rr AS (SELECT \"row\", source, n, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS r FROM h JOIN st USING (source) JOIN tt USING (\"row\"))"


@query("enrich_ulm", rsql('SELECT "row", source, r * sqrt((n - 2) / (1 - r * r)) AS score FROM rr', "score", 5, f"WITH {_GL}, {_ULM}"), 5)
def enrich_ulm(spark, sf):
    return N.ulm(_gene_long(spark, sf), _net(spark), "row", p_values=False)


@query("enrich_ulm_padj", digits=5)
def enrich_ulm_p(spark, sf):
    return N.ulm(_gene_long(spark, sf), _net(spark), "row")


@query("enrich_zscore", rsql('SELECT l."row", source, (avg(value) - any_value(m)) * sqrt(count(*)) / any_value(s) AS score FROM l JOIN net ON target = feature JOIN (SELECT "row", avg(value) AS m, stddev_samp(value) AS s FROM l GROUP BY "row") x ON x."row" = l."row" GROUP BY l."row", source', "score", prefix=f"WITH {_GL}"))
def enrich_zscore(spark, sf):
    return N.zscore(_gene_long(spark, sf), _net(spark), "row")


_TOP = 'rk AS (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY value DESC, feature) AS r, count(*) OVER (PARTITION BY "row") AS n, greatest(1, round(count(*) OVER (PARTITION BY "row") * 0.2))::INT AS top FROM l)'


@query("enrich_ora", f'WITH {_GL}, {_TOP} SELECT "row", source, count(*) FILTER (r <= top) AS overlap, count(*) AS size, max(top) AS top, max(n) AS n FROM rk JOIN net ON target = feature GROUP BY "row", source')
def enrich_ora(spark, sf):
    return N.ora_rows(_gene_long(spark, sf), _net(spark), "row", 0.2, p_values=False)


@query("enrich_aucell", rsql('SELECT "row", source, sum(CASE WHEN r <= top THEN top - r + 1 ELSE 0 END) / (least(count(*), max(top)) * max(top) - least(count(*), max(top)) * (least(count(*), max(top)) - 1) / 2.0) AS score FROM rk JOIN net ON target = feature GROUP BY "row", source', "score", prefix=f"WITH {_GL}, {_TOP}"))
def enrich_aucell(spark, sf):
    return N.aucell(_gene_long(spark, sf), _net(spark), "row", 0.2)


_GSEA = 'hh AS (SELECT rk."row", source, r, n, abs(value) AS w, count(*) OVER p AS k, sum(abs(value)) OVER p AS tw, sum(abs(value)) OVER q AS cw, count(*) OVER q AS i FROM rk JOIN net ON target = feature WINDOW p AS (PARTITION BY rk."row", source), q AS (PARTITION BY rk."row", source ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), ee AS (SELECT "row", source, max(cw / tw - (r - i) / (n - k)) AS hi, min((cw - w) / tw - (r - i) / (n - k)) AS lo FROM hh GROUP BY "row", source)'


@query("enrich_gsea", rsql('SELECT "row", source, CASE WHEN hi >= -lo THEN hi ELSE lo END AS score FROM ee', "score", prefix=f"WITH {_GL}, {_TOP}, {_GSEA}"))
def enrich_gsea(spark, sf):
    return N.gsea(_gene_long(spark, sf), _net(spark), "row")


for _n in ("viper", "gsva"):
    query(f"enrich_{_n}")(lambda spark, sf, f=getattr(N, _n): f(_gene_long(spark, sf), _net(spark), "row"))


@query("enrich_mlm")
def enrich_mlm(spark, sf):
    wide = _gene_long(spark, sf).groupBy("row").pivot("feature", [f"g{i}" for i in range(40)]).agg(F.first("value"))
    return N.mlm(wide, [f"g{i}" for i in range(40)], _net(spark), "row")


@query("enrich_consensus", rsql('SELECT "row", source, avg(z) AS score FROM (SELECT "row", source, (score - avg(score) OVER w) / stddev_pop(score) OVER w AS z FROM (SELECT l."row", source, (avg(value) - any_value(m)) * sqrt(count(*)) / any_value(s) AS score FROM l JOIN net ON target = feature JOIN (SELECT "row", avg(value) AS m, stddev_samp(value) AS s FROM l GROUP BY "row") x ON x."row" = l."row" GROUP BY l."row", source) WINDOW w AS (PARTITION BY "row")) GROUP BY "row", source', "score", prefix=f"WITH {_GL}"))
def enrich_consensus(spark, sf):
    return N.consensus([N.zscore(_gene_long(spark, sf), _net(spark), "row")], "row")


@query("enrich_permutation_padj")
def enrich_permutation(spark, sf):
    return N.permutation_padj(_gene_long(spark, sf), _net(spark), "row", 20)


_ORA = "mem AS (SELECT DISTINCT p_brand AS grp, 'g' || (p_size % 40) AS gene FROM part WHERE p_size % 3 = 0), uni AS (SELECT DISTINCT 'g' || (p_size % 40) AS gene FROM part), net AS (SELECT 's' || (k % 5) AS source, 'g' || k AS gene FROM range(40) t(k)), st AS (SELECT * FROM net WHERE gene IN (SELECT gene FROM uni)), sz AS (SELECT source, count(*) AS size FROM st GROUP BY source HAVING count(*) >= 3), gz AS (SELECT grp, count(*) AS n_group FROM mem GROUP BY grp), ov AS (SELECT grp, source, count(*) AS overlap FROM mem JOIN st USING (gene) GROUP BY grp, source), n AS (SELECT count(*) AS n FROM uni)"


@query("ora_counts", rsql('SELECT grp AS "group", source, overlap, size, n_group, n, ln((overlap + 0.5) * (n - n_group - size + overlap + 0.5) / ((n_group - overlap + 0.5) * (size - overlap + 0.5))) AS odds_ratio FROM ov JOIN sz USING (source) JOIN gz USING (grp), n WHERE n_group < n', "odds_ratio", prefix=f"WITH {_ORA}"))
def ora_counts(spark, sf):
    p = T.read(spark, sf, "part").withColumn("gene", F.concat(F.lit("g"), (F.col("p_size") % 40).cast("string")))
    return N.ora(p.where("p_size % 3 = 0").select(F.col("p_brand").alias("group"), "gene"), _net(spark), p.select("gene"), 3, p_values=False)


@query("ora")
def ora(spark, sf):
    p = T.read(spark, sf, "part").withColumn("gene", F.concat(F.lit("g"), (F.col("p_size") % 40).cast("string")))
    return N.ora(p.where("p_size % 3 = 0").select(F.col("p_brand").alias("group"), "gene"), _net(spark), p.select("gene"), 3)


@query("enrich_hits")
def enrich_hits(spark, sf):
    p = T.read(spark, sf, "part").withColumn("gene", F.concat(F.lit("g"), (F.col("p_size") % 40).cast("string")))
    return N.enrich_hits(p, _net(spark), "gene", F.col("p_size") % 3 == 0, tmin=3)


_RF = f"l AS (SELECT pert, feature, value FROM ({LONG}) WHERE value IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature, value) AS tt FROM l), tie AS (SELECT feature, count(*)::DOUBLE AS n, sum(CAST(tt AS DOUBLE) * tt - 1) AS tie FROM r GROUP BY feature), g AS (SELECT pert, feature, sum(r) AS s, count(*)::DOUBLE AS k FROM r GROUP BY pert, feature)"


@query("rank_features", rsql('SELECT pert AS "group", g.feature, (s - k * (n + 1) / 2.0) / sqrt(k * (n - k) / 12.0 * ((n + 1) - tie / (n * (n - 1)))) AS score FROM g JOIN tie USING (feature)', "score", prefix=f"{WC}, {_RF}"))
def rank_features(spark, sf):
    return N.rank_features(ST.to_long(T.cells(spark, sf), ["pert"], FEATURES).select("pert", "feature", "value"), "pert")


@query("rank_sets", rsql('SELECT p_brand AS "group", p_type AS source, avg(p_retailprice) - (any_value(ts) - sum(p_retailprice)) / nullif(any_value(tn) - count(*), 0) AS score FROM part JOIN (SELECT p_type AS t, sum(p_retailprice) AS ts, count(*) AS tn FROM part GROUP BY p_type) x ON x.t = p_type GROUP BY p_brand, p_type', "score", 5), 5)
def rank_sets(spark, sf):
    s = T.read(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_type").alias("source"), F.col("p_retailprice").alias("score"))
    return N.rank_sets(s, "grp")


_CS = "ct AS (SELECT block, cluster, count(*) / sum(count(*)) OVER (PARTITION BY block) AS cs FROM pop WHERE control GROUP BY block, cluster), tr AS (SELECT grp, block, cluster, count(*) AS n FROM pop WHERE NOT control GROUP BY grp, block, cluster), fu AS (SELECT u.grp, u.block, c.cluster, coalesce(tr.n, 0) AS n FROM (SELECT DISTINCT grp, block FROM tr) u CROSS JOIN (SELECT DISTINCT cluster FROM pop) c LEFT JOIN tr ON tr.grp = u.grp AND tr.block = u.block AND tr.cluster = c.cluster), sh AS (SELECT fu.grp, fu.cluster, fu.n / sum(fu.n) OVER (PARTITION BY fu.grp, fu.block) - coalesce(ct.cs, 0) AS d FROM fu LEFT JOIN ct ON ct.block = fu.block AND ct.cluster = fu.cluster), sf AS (SELECT grp, cluster, avg(d) AS shift FROM sh GROUP BY grp, cluster)"


@query("composition_shift", rsql('SELECT grp AS "group", cluster, shift, 0.5 * sum(abs(shift)) OVER (PARTITION BY grp) AS distance FROM sf', "shift distance", prefix=f"{WP}, {_CS}"))
def composition_shift(spark, sf):
    return N.composition_shift(T.populations(spark, sf), "cluster", "grp", F.col("control"), "block")


@query("composition_shift_pvalues")
def composition_shift_p(spark, sf):
    return N.composition_shift_pvalues(T.populations(spark, sf), "cluster", "grp", F.col("control"), "user", 99)


_SP = 'rf AS (SELECT cluster, avg(value) AS m FROM pop WHERE control AND half GROUP BY cluster HAVING count(*) >= 2), fr AS (SELECT p.cluster, grp, control, abs(value - m) AS value FROM pop p JOIN rf USING (cluster) WHERE NOT (control AND half)), b AS (SELECT f.cluster, g.grp, f.value, f.control FROM fr f JOIN (SELECT DISTINCT cluster, grp FROM fr WHERE NOT control) g ON g.cluster = f.cluster WHERE f.control OR f.grp = g.grp), x AS (SELECT cluster, grp, value, sum((NOT control)::INT) AS ia, sum(control::INT) AS ib FROM b GROUP BY cluster, grp, value), cc AS (SELECT cluster, grp, sum(ia) OVER w AS na, sum(ib) OVER w AS nb, sum(ia) OVER p AS ta, sum(ib) OVER p AS tb FROM x WINDOW w AS (PARTITION BY cluster, grp ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY cluster, grp))'


@query("subpopulation_hits", rsql('SELECT cluster, grp AS "group", max(abs(na / ta - nb / tb)) AS ks, CAST(max(ta) AS BIGINT) AS n, CAST(max(tb) AS BIGINT) AS m FROM cc WHERE ta > 0 AND tb > 0 GROUP BY cluster, grp', "ks", prefix=f"{WP}, {_SP}"))
def subpopulation_hits(spark, sf):
    return N.subpopulation_hits(T.populations(spark, sf), ["value"], "cluster", "grp", F.col("control"), F.col("half")).drop("pvalue", "qvalue")


@query("dna_content")
def dna_content(spark, sf):
    return N.dna_content(T.cells(spark, sf), "p", ["plate"]).select("row_id", "dna_content")


@query("dna_state", f"{WC} SELECT row_id, CASE WHEN log2(q / 25) < log2(1.25) THEN '2N' WHEN log2(q / 25) < log2(1.75) THEN 'S' WHEN q IS NOT NULL THEN '4N' END AS dna_state FROM cells")
def dna_state(spark, sf):
    return T.cells(spark, sf).select("row_id", N.dna_state(F.log2(F.col("q") / 25)).alias("dna_state"))


@query("cell_cycle")
def cell_cycle(spark, sf):
    c = T.cells(spark, sf).withColumn("content", F.log2(F.col("q") / 15))
    out = N.project_cell_cycle(c, "content", N.fit_cell_cycle(c, "content", F.col("control")))
    return N.phase_order(out, "phase", "p").select("row_id", "phase", "cycle_position", "phase_order")


# ---------------------------------------------------------------- correction and linear maps


def _batch():
    from platewise.operators import batch

    return batch


_RO = f"fit AS (SELECT plate, avg(t) AS a, min(t) AS lo, max(t) AS hi, count(t) AS n, {each('regr_slope(@, t) AS @_b', ['q', 'p', 'd'])} FROM cells WHERE control GROUP BY plate)"


@query("regress_out", rsql(f"SELECT row_id, {each('CASE WHEN n >= 3 AND @_b IS NOT NULL AND NOT isnan(@_b) THEN c.@ - @_b * (greatest(lo, least(hi, t)) - a) ELSE c.@ END AS @', ['q', 'p', 'd'])} FROM cells c JOIN fit USING (plate)", "q p d", prefix=f"{WC}, {_RO}"))
def regress_out(spark, sf):
    return _batch().regress_out_one(T.cells(spark, sf), ["q", "p", "d"], "t", ["plate"], F.col("control")).select("row_id", "q", "p", "d")


@query("regress_out_several", digits=5)
def regress_out_several(spark, sf):
    return _batch().regress_out(T.cells(spark, sf), ["p", "d"], ["t", "moa"], ["plate"]).select("row_id", "p", "d")


@query("correct_chromosome_arm", rsql("SELECT c.row_id, c.p - coalesce(m.m, 0) AS p FROM cells c LEFT JOIN (SELECT well, avg(p) AS m FROM cells WHERE part % 3 = 0 GROUP BY well HAVING count(DISTINCT part) > 20) m USING (well)", "p", 5, WC), 5)
def chromosome_arm(spark, sf):
    c = T.cells(spark, sf)
    un = c.where("part % 3 = 0").select(F.col("part").alias("gene"))
    return _batch().correct_chromosome_arm(c, ["p"], "well", "part", un).select("row_id", "p")


@query("correct_plate_position")
def plate_position(spark, sf):
    c = W.fill_well_grid(T.cells(spark, sf), "well")
    return _batch().correct_plate_position(c, ["p", "d"], "plate", "Metadata_Row", "Metadata_Col", F.col("control")).select("row_id", "p", "d")


@query("detect_plate_position")
def detect_position(spark, sf):
    c = W.fill_well_grid(T.cells(spark, sf), "well")
    return _batch().detect_plate_position(c, ["p", "d"], "plate", "Metadata_Row", "Metadata_Col", F.col("control"))


@query("sphere_whitened_covariance", "SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cov FROM (SELECT unnest(['a','b','c']) AS a), (SELECT unnest(['a','b','c']) AS b)", 4)
def sphere(spark, sf):
    """The controls' covariance after sphering is the identity."""
    z = _batch().sphere(_emb_wide(spark, sf), _HIT, F.col("control"), epsilon=1e-9).where("control")
    cov = z.agg(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.covar_samp(x, y).alias("cov")) for x in _HIT for y in _HIT]).alias("m"))
    return cov.select(F.explode("m").alias("m")).select("m.*")


@query("sphere_epsilon")
def sphere_epsilon(spark, sf):
    e = _emb_wide(spark, sf, 4)
    return _batch().select_epsilon(e, list("abcd"), F.col("control"), "label", "vec_id", [1e-6, 1e-2, 1.0])


@query("tvn")
def tvn(spark, sf):
    return _batch().tvn(_emb_wide(spark, sf, 4), list("abcd"), "batch", F.col("control"))


@query("pca_variances")
def pca(spark, sf):
    scores, _, _ = _batch().pca(_emb_wide(spark, sf, 8), list("abcdefgh"), 3)
    return scores


@query("harmony")
def harmony(spark, sf):
    return H.harmony(_emb_wide(spark, sf, 4), list("abcd"), "batch", 4, 3, blocks=3, max_iter_cluster=4)


# ---------------------------------------------------------------- metrics and clustering

_R2 = "l AS (SELECT plate, unnest(['q','d','t']) AS feature, unnest([q,d,t]) AS value FROM cells), e AS (SELECT feature, plate, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM l WHERE value IS NOT NULL GROUP BY feature, plate), s AS (SELECT feature, sum(n) AS nn, sum(n * v) AS w, sum(n * m) AS s1, sum(n * m * m) AS s2 FROM e GROUP BY feature), r AS (SELECT feature, (s2 - s1 * s1 / nn) / (s2 - s1 * s1 / nn + w) AS r2, (s2 - s1 * s1 / nn + w) / (nn - 1) AS variance FROM s)"


@query("pc_regression", rsql("SELECT 'plate' AS key, sum(r2 * variance) / sum(variance) AS score FROM r", "score", 7, f"{WC}, {_R2}"), 7)
def pc_regression(spark, sf):
    return M.pc_regression(T.cells(spark, sf), ["q", "d", "t"], "plate")


@query("batch_variance_explained", rsql("SELECT 'plate' AS key, sum(r2 * variance) / sum(variance) AS score FROM r UNION ALL SELECT 'supp', (SELECT sum(c * c * v) / sum(v) FROM (SELECT corr(q, supp) AS c, var_samp(q) AS v FROM cells UNION ALL SELECT corr(d, supp), var_samp(d) FROM cells UNION ALL SELECT corr(t, supp), var_samp(t) FROM cells))", "score", 7, f"{WC}, {_R2}"), 7)
def batch_variance(spark, sf):
    return M.batch_variance_explained(T.cells(spark, sf), ["q", "d", "t"], ["plate", "supp"])


@query("variance_carried")
def variance_carried(spark, sf):
    return M.variance_carried(_emb_wide(spark, sf, 8), list("abcd"), list("efgh"), "vec_id")


_DP = f"WITH e AS ({EMBEDDED}), pr AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, b.batch AS bj, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)"


@query("silhouette", rsql("SELECT avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)) AS score FROM (SELECT i, max(m) FILTER (li = lj) AS a, min(m) FILTER (li <> lj) AS b FROM (SELECT i, li, lj, avg(d) AS m FROM pr GROUP BY i, li, lj) GROUP BY i)", "score", prefix=_DP))
def silhouette(spark, sf):
    return M.silhouette_rows(T.embedded(spark, sf), "vec_id", "v", "label")


@query("lisi", rsql("SELECT median(x) AS score FROM (SELECT i, 1.0 / sum((n / 30.0) ** 2) AS x FROM (SELECT i, bj, count(*) AS n FROM (SELECT i, bj, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM pr) WHERE r <= 30 GROUP BY i, bj) GROUP BY i)", "score", prefix=_DP))
def lisi(spark, sf):
    return M.lisi_rows(T.embedded(spark, sf), "vec_id", "v", "batch")


@query("evaluate_integration")
def evaluate(spark, sf):
    e = T.embedded(spark, sf)
    bio, bat = M.silhouette_rows(e, "vec_id", "v", "label").first()[0], M.lisi_rows(e, "vec_id", "v", "batch").first()[0]
    ap = P.average_precision_rows(e, "vec_id", "v", pos_sameby=["label"], neg_diffby=["label"])
    out = M.evaluate_integration({"silhouette_label": (bio + 1) / 2}, {"lisi_batch": (bat - 1) / 4}, ap.agg(F.avg("ap")).first()[0])
    return spark.createDataFrame(sorted((k, float(v)) for k, v in out.items()), "metric string, value double")


@query("diagnose_testing")
def diagnose(spark, sf):
    def call(rows, ref):
        return E.mann_whitney(rows, ["a", "b"], "__pseudo", ref, "vec_id")

    return M.diagnose_testing(_emb_wide(spark, sf), call, F.lit(True), "vec_id", 2)


@query("cluster_hierarchical")
def cluster(spark, sf):
    w = A.consensus_median(T.wells(spark, sf), FEATURES, ["well", "pert"]).withColumn("id", F.concat("well", "pert"))
    out, _ = M.cluster(w, "id", FEATURES)
    return out


@query("cluster_communities")
def communities(spark, sf):
    near = _pairs(spark, sf, k=10)
    return M.communities(near.select(F.col("i").alias("a"), F.col("j").alias("b"), F.greatest(F.lit(0.0), "sim").alias("weight")))


@query("phate")
def phate(spark, sf):
    w = A.consensus_median(T.wells(spark, sf), FEATURES, ["well", "pert"]).withColumn("id", F.concat("well", "pert"))
    return M.phate(w, "id", FEATURES)
