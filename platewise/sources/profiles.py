"""Readers, writers, joins of annotations, schema checks and the synthetic plate."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions.wells import fill_well_grid, normalize_well, parse_feature_name, well_name

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
PREFIXES = ("Metadata_", "Image_Metadata_", "metadata_")
REQUIRED = {"object": ("Metadata_ImageID", "Metadata_ObjectType", "Metadata_ObjectNumber"), "well": ("Metadata_Plate", "Metadata_Well"), "aggregate": ()}
RESOLUTIONS = ("object", "well", "aggregate")
KINDS = ("measurement", "embedding", "derived")


@dataclass(frozen=True)
class ProfileMeta:
    """What a table of profiles is: declared, not inferred."""

    resolution: str
    features: tuple[str, ...]
    feature_kind: str = "measurement"
    grouped_by: tuple[str, ...] = ()
    object_type: str | None = None
    perturbation: str | None = None
    parameters: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.resolution not in RESOLUTIONS or self.feature_kind not in KINDS:
            raise ValueError("unknown resolution or feature kind")


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(metadata, features): metadata prefixes and non-numeric columns, then numeric columns that are measurements."""
    meta, feats = [], []
    for name, kind in df.dtypes:
        if name.startswith(PREFIXES) or not kind.startswith(NUMERIC):
            meta.append(name)
        elif parse_feature_name(name).is_feature:
            feats.append(name)
    return meta, feats


def stack(tables: Sequence[DataFrame], on_mismatch: str = "raise") -> DataFrame:
    """Union of tables: differing columns raise, or the common ones stay in the order of the first."""
    tables = [t for t in tables if t.columns]
    first = tables[0].columns
    common = [c for c in first if all(c in t.columns for t in tables)]
    if on_mismatch == "raise" and any(set(t.columns) != set(first) for t in tables):
        raise ValueError("tables have different columns")
    out = tables[0].select(common)
    for t in tables[1:]:
        out = out.unionByName(t.select(common))
    return out


def from_dataframe(df: DataFrame, sentinels: Sequence[float] = (), well: str = "Metadata_Well") -> tuple[DataFrame, ProfileMeta]:
    """Clean names, sentinel values to NULL, wells normalised with their grid position."""
    for p in PREFIXES[1:]:
        df = df.withColumnsRenamed({c: "Metadata_" + c[len(p) :] for c in df.columns if c.startswith(p)})
    meta, feats = split_columns(df)
    cols = {}
    for f in feats:
        v = F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
        cols[f] = F.when(~v.isin(*sentinels), v) if sentinels else v
    out = df.withColumns(cols)
    if well in out.columns:
        out = fill_well_grid(out.withColumn(well, F.coalesce(normalize_well(F.col(well)), well)), well)
        meta = [c for c in out.columns if c not in feats]
    out = out.select(*meta, *feats)
    resolution = "object" if set(REQUIRED["object"]) <= set(meta) else "well" if set(REQUIRED["well"]) <= set(meta) else "aggregate"
    return out, ProfileMeta(resolution, tuple(feats))


def read_profiles(spark: SparkSession, paths: Sequence[str], on_column_mismatch: str = "raise", path_columns: dict[str, str] | None = None, platemap: DataFrame | None = None, sentinels: Sequence[float] = ()) -> tuple[DataFrame, ProfileMeta]:
    """CSV, TSV or Parquet files and directories, stacked; path_columns maps a column to a pattern over the file's path."""
    tables = []
    for p in paths:
        low = p.lower()
        t = spark.read.csv(p, header=True, inferSchema=True, sep="\t" if low.endswith(".tsv") else ",") if low.endswith((".csv", ".tsv", ".csv.gz")) else spark.read.parquet(p)
        for name, pattern in (path_columns or {}).items():
            t = t.withColumn(name, F.regexp_extract(F.input_file_name(), pattern, 1))
        tables.append(t)
    out = stack(tables, on_column_mismatch)
    if platemap is not None:
        out = join_platemap(out, platemap)
    return from_dataframe(out, sentinels)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if bad is not None:
        raise ValueError(f"key {[bad[k] for k in keys]} has {bad['n']} rows")


def many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", check: bool = True) -> DataFrame:
    """Left join of annotations; duplicate keys on the right raise. Keys are compared as text."""
    if check:
        assert_unique(right, on)
    r = right.select(*[F.col(k).cast("string").alias(f"__{k}") for k in on], *[c for c in right.columns if c not in on and c not in left.columns])
    cond = None
    for k in on:
        c = left[k].cast("string") == r[f"__{k}"]
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__{k}" for k in on])


def join_platemap(df: DataFrame, platemap: DataFrame) -> DataFrame:
    """By well, and by plate where both have it."""
    on = ["Metadata_Well"] + (["Metadata_Plate"] if "Metadata_Plate" in df.columns and "Metadata_Plate" in platemap.columns else [])
    return many_to_one(df, platemap, on)


def annotate(df: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]], on_unmapped: str = "warn") -> DataFrame:
    """Chain of many-to-one joins; `drop` keeps mapped rows only, `error` refuses others."""
    for t, on in tables:
        new = [c for c in t.columns if c not in on and c not in df.columns]
        df = many_to_one(df, t, on, "inner" if on_unmapped == "drop" else "left")
        if on_unmapped == "error" and new and not df.where(F.col(new[0]).isNull()).isEmpty():
            raise ValueError(f"rows without a match on {list(on)}")
    return df


def unexpressed_genes(expression: DataFrame, model: str, cell_line: str, tpm_cutoff: float = 0.5) -> DataFrame:
    """(gene): columns of one model's row at or below the cutoff; a trailing ` (id)` is cut off."""
    row = expression.where(F.col(model) == cell_line)
    if row.isEmpty():
        raise ValueError(f"no model {cell_line}")
    genes = [c for c in expression.columns if c != model]
    long = row.select(*[F.col(f"`{g}`").cast("double").alias(g) for g in genes]).unpivot([], [f"`{g}`" for g in genes], "gene", "value")
    return long.where(F.col("value") <= tpm_cutoff).select(F.regexp_replace("gene", r" \(.*\)$", "").alias("gene")).distinct()


def read_export(spark: SparkSession, path: str, primary: str = "Cells", objects: Sequence[str] = ("Nuclei", "Cytoplasm"), strict: bool = True) -> DataFrame:
    """Objects of an export directory joined to the primary by Parent links on either side, then to the image table."""
    def table(name: str) -> DataFrame:
        t = spark.read.csv(f"{path}/{name}.csv", header=True, inferSchema=True)
        keep = [c for c in t.columns if c in ("ImageNumber", "ObjectNumber") or c.startswith("Parent_")]
        return t.select(*keep, *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in t.columns if c not in keep])

    out = table(primary)
    for name in objects:
        child = table(name)
        link = f"Parent_{primary}"
        if link in child.columns:
            child = child.select("ImageNumber", F.col(link).alias("ObjectNumber"), *[c for c in child.columns if c.startswith(f"{name}_")])
            on = ["ImageNumber", "ObjectNumber"]
        else:
            child = child.select("ImageNumber", F.col("ObjectNumber").alias(f"Parent_{name}"), *[c for c in child.columns if c.startswith(f"{name}_")])
            on = ["ImageNumber", f"Parent_{name}"]
        if strict:
            assert_unique(child, on)
        out = out.join(child, on, "left")
    image = spark.read.csv(f"{path}/Image.csv", header=True, inferSchema=True)
    return out.join(image.select("ImageNumber", *[c for c in image.columns if c.startswith(("Metadata_", "ImageQuality_"))]), "ImageNumber", "left")


def image_table(df: DataFrame, image_id: str = "Metadata_ImageID", prefix: str = "ImageQuality_") -> DataFrame:
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.groupBy(image_id).agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def image_id(df: DataFrame, parts: Sequence[str] = ("Metadata_Source", "Metadata_Plate", "Metadata_Well", "Metadata_Site", "Metadata_ImageNumber")) -> Column:
    """Parts that exist joined by a bar; NULL if one is missing."""
    have = [p for p in parts if p in df.columns]
    ok = F.lit(True)
    for p in have:
        ok = ok & F.col(p).isNotNull()
    return F.when(ok, F.concat_ws("|", *[F.col(p).cast("string") for p in have]))


def from_embedding(df: DataFrame, vector: str, metadata: Sequence[str], resolution: str = "aggregate") -> tuple[DataFrame, ProfileMeta]:
    """Embeddings stay one packed column."""
    return df.select(*metadata, F.transform(vector, lambda x: x.cast("double")).alias("features")), ProfileMeta(resolution, ("features",), "embedding")


def write(df: DataFrame, meta: ProfileMeta, path: str) -> None:
    """Parquet with the descriptors beside it; errors of `validate` are refused first.

    Everything is written beside the path first and moved there when it is whole, so a write that fails leaves the old data
    as they were, and profiles can be read from the path that they are written to.
    """
    bad = validate(df, meta).where("level = 'error'").first()
    if bad is not None:
        raise ValueError(bad["message"])
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(f"{beside}.new/rows")
    spark.createDataFrame([(json.dumps(asdict(meta)),)], "meta string").coalesce(1).write.text(f"{beside}.new/meta")
    at, new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{beside}.new", f"{beside}.old"))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    had = files.exists(at)
    if had and not files.rename(at, old):
        raise OSError(f"{path} cannot be moved aside")
    if not files.rename(new, at):
        if had:
            files.rename(old, at)
        raise OSError(f"{beside}.new cannot be moved to {path}")
    if had:
        files.delete(old, True)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, ProfileMeta]:
    m = json.loads(spark.read.text(f"{path}/meta").first()[0])
    m["features"], m["grouped_by"] = tuple(m["features"]), tuple(m["grouped_by"])
    return spark.read.parquet(f"{path}/rows"), ProfileMeta(**m)


def validate(df: DataFrame, meta: ProfileMeta) -> DataFrame:
    """(level, message): missing required columns, NULL or repeated identities, missing and infinite features."""
    out = []
    need = meta.grouped_by or REQUIRED[meta.resolution]
    missing = [c for c in need if c not in df.columns]
    out += [("error", f"column {c} is missing") for c in missing]
    out += [("error", f"feature {f} is missing") for f in meta.features if f not in df.columns]
    have = [c for c in need if c in df.columns]
    if have and not missing:
        n = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*have).alias("d"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in have]).first()
        out += [("error", f"column {c} has NULL") for c in have if n[c]]
        if n["d"] < n["n"]:
            out.append(("error" if meta.resolution != "object" else "warning", "identity columns are not unique"))
    if "Metadata_Control" in df.columns and dict(df.dtypes)["Metadata_Control"] != "boolean":
        out.append(("error", "Metadata_Control is not boolean"))
    return df.sparkSession.createDataFrame(out, "level string, message string")


def identity_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(n_rows, n_distinct, n_null) of identity columns, in one aggregation."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*keys).alias("n_distinct"), F.count(F.when(null, 1)).alias("n_null"))


def to_dataframe(df: DataFrame, meta: ProfileMeta, metadata: Sequence[str] | None = None) -> DataFrame:
    return df.select(*(metadata or [c for c in df.columns if c.startswith("Metadata_")]), *meta.features)


def features_where(features: DataFrame, object: str | None = None, feature_group: str | None = None, channel: str | None = None) -> DataFrame:
    """Names of the features that match all given parts."""
    out = features
    for name, v in (("object", object), ("feature_group", feature_group), ("channel", channel)):
        if v is not None:
            out = out.where(F.col(name) == v)
    return out.select("feature")


def synthetic_plate(spark: SparkSession, n_plates: int = 2, n_wells: int = 24, n_cells: int = 15, n_features: int = 20, n_perturbations: int = 6, effect: float = 1.0, plate_effect: float = 0.5, missing: float = 0.0, seed: int = 0) -> DataFrame:
    """Cells with known truth: every fourth well is DMSO, plates are shifted, feature 0 of a treatment moves by `effect`."""
    n = n_plates * n_wells * n_cells
    i = F.col("id")
    well = F.floor(i / n_cells) % n_wells
    plate = F.floor(i / (n_cells * n_wells))
    pert = F.when(well % 4 == 0, "DMSO").otherwise(F.concat(F.lit("trt"), (well % n_perturbations).cast("string")))
    base = spark.range(n).select(
        i.alias("row_id"), F.concat(F.lit("P"), plate.cast("string")).alias("Metadata_Plate"), well_name(F.floor(well / 12).cast("int"), (well % 12).cast("int")).alias("Metadata_Well"),
        pert.alias("Metadata_Perturbation"), (well % 4 == 0).alias("Metadata_Control"), plate.alias("__p"),
    )
    cols = {}
    for k in range(n_features):
        v = F.randn(seed * 1000 + k) + F.col("__p") * plate_effect
        if k == 0:
            v = v + F.when(F.col("Metadata_Control"), 0.0).otherwise(effect)
        cols[f"Cells_AreaShape_F{k}"] = F.when(F.rand(seed * 1000 + 500 + k) >= missing, v) if missing else v
    return base.withColumns(cols).drop("__p")


def stamp(df: DataFrame, resolution: str, feature_kind: str = "measurement", features: Sequence[str] | None = None, object_type: str | None = None, grouped_by: Sequence[str] = (), perturbation: str | None = None) -> ProfileMeta:
    """Declare what a table is; columns that are named must exist, features default to the numeric measurements."""
    feats = tuple(features if features is not None else split_columns(df)[1])
    named = [*feats, *grouped_by, *([perturbation] if perturbation else [])]
    missing = [c for c in named if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    return ProfileMeta(resolution, feats, feature_kind, tuple(grouped_by), object_type, perturbation)


def read_edges(spark: SparkSession, path: str, left: str, right: str, sep: str = "\t") -> DataFrame:
    """(a, b) of an interaction file: undirected, without loops and repeats."""
    t = spark.read.csv(path, header=True, sep=sep).select(F.col(left).alias("l"), F.col(right).alias("r")).where("l is not null and r is not null and l <> r")
    return t.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct()


def read_complexes(spark: SparkSession, path: str, name: str, members: str, sep: str = "\t", within: str = ";") -> DataFrame:
    """(source, target, weight) of a file of complexes with their members in one column."""
    t = spark.read.csv(path, header=True, sep=sep).select(F.col(name).alias("source"), F.explode(F.split(members, within)).alias("target"))
    return t.select("source", F.trim("target").alias("target"), F.lit(1.0).alias("weight")).where("target <> ''").distinct()
