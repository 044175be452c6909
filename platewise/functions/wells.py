"""Well names, plate grids and feature names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Plate formats: wells, rows, columns.
FORMATS = ((96, 8, 12), (384, 16, 24), (1536, 32, 48))


def normalize_well(well: Column) -> Column:
    """`a1`, `A-01`, `A 1`, `A/1` to A01; NULL if it is no well (column 0 is none)."""
    w = F.trim(well)
    pattern = r"^([A-Za-z]{1,2})[\s_/-]?(\d{1,2})$"
    col = F.regexp_extract(w, pattern, 2)
    return F.when(w.rlike(pattern) & (F.try_to_number(col, F.lit("99")) > 0), F.concat(F.upper(F.regexp_extract(w, pattern, 1)), F.lpad(col, 2, "0")))


def well_row(well: Column) -> Column:
    """0-based row of a normalised well; AA is 26."""
    letters = F.regexp_extract(well, "^([A-Z]+)", 1)
    last = F.ascii(F.substring(letters, -1, 1)) - 65
    return F.when(F.length(letters) == 2, (F.ascii(letters) - 64) * 26 + last).when(F.length(letters) == 1, last)


def well_col(well: Column) -> Column:
    return F.regexp_extract(well, r"(\d+)$", 1).cast("int") - 1


def row_label(row: Column) -> Column:
    return F.when(row < 26, F.char(row + 65)).otherwise(F.concat(F.char(F.floor(row / 26).cast("int") + 64), F.char(row % 26 + 65)))


def well_name(row: Column, col: Column) -> Column:
    return F.concat(row_label(row), F.lpad((col + 1).cast("string"), 2, "0"))


def fill_well_grid(df: DataFrame, well: str = "Metadata_Well") -> DataFrame:
    return df.withColumns({"Metadata_Row": well_row(F.col(well)), "Metadata_Col": well_col(F.col(well))})


def detect_plate_format(df: DataFrame, well: str = "Metadata_Well", by: Sequence[str] = ()) -> DataFrame:
    """(by…, plate_format): the smallest format that fits; NULL if none does."""
    top = df.groupBy(*by).agg(F.max(well_row(F.col(well))).alias("r"), F.max(well_col(F.col(well))).alias("c"))
    size = F.lit(None).cast("int")
    for n, rows, cols in reversed(FORMATS):
        size = F.when((F.col("r") < rows) & (F.col("c") < cols), n).otherwise(size)
    return top.select(*by, size.alias("plate_format"))


# ---------------------------------------------------------------- feature names

#: Channel names that mean the same.
CHANNEL_ALIASES = {"hoechst": "dna", "dapi": "dna", "nuclei": "dna", "er": "er", "rna": "rna", "syto": "rna", "agp": "agp", "actin": "agp", "mito": "mito", "mitotracker": "mito"}
OBJECTS = ("Cells", "Nuclei", "Cytoplasm", "Image")
GROUPS = ("AreaShape", "Correlation", "Granularity", "Intensity", "Location", "Neighbors", "Number", "Parent", "Children", "RadialDistribution", "Texture", "ObjectSkeleton", "ImageQuality", "Count")
#: Groups that hold no measurement.
NOT_FEATURES = ("Location", "Number", "Parent", "Children")


def canonical_channel(name: str | None) -> str | None:
    if name is None:
        return None
    return "|".join(CHANNEL_ALIASES.get(p.lower(), p.lower()) for p in name.split("|"))


def canonical_channel_column(name: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for kv in CHANNEL_ALIASES.items() for x in kv])
    return F.array_join(F.transform(F.split(F.lower(name), r"\|"), lambda p: F.coalesce(aliases[p], p)), "|")


@dataclass(frozen=True)
class FeatureName:
    feature: str
    object: str | None
    feature_group: str | None
    measure: str | None
    channel: str | None
    scale: str | None
    angle: str | None
    gray_levels: str | None
    radial_bin: str | None
    is_feature: bool


def parse_feature_name(name: str, channels: Sequence[str] = ()) -> FeatureName:
    """Object_Group_Measure_Channel… by the export grammar; names outside it are features without parts."""
    parts = name.split("_")
    known = {c.lower() for c in channels} | set(CHANNEL_ALIASES) | set(CHANNEL_ALIASES.values())
    obj = parts[0] if parts[0] in OBJECTS else None
    group = parts[1] if obj and len(parts) > 1 and parts[1] in GROUPS else None
    if group is None:
        return FeatureName(name, obj, None, None, None, None, None, None, None, True)
    rest = parts[2:]
    measure = rest.pop(0) if rest else None
    found = []
    while rest and rest[0].lower() in known:
        found.append(rest.pop(0))
    bin_ = None
    if group == "RadialDistribution":
        m = re.search(r"(\d+)of(\d+)$", name)
        bin_ = m[0] if m else None
    nums = [p for p in rest if p.isdigit()]
    scale, angle, gray = (nums + [None] * 3)[:3] if group in ("Texture", "Granularity") else (None, None, None)
    return FeatureName(name, obj, group, measure, "|".join(found) or None, scale, angle, gray, bin_, group not in NOT_FEATURES)


_PARSED = "feature string, object string, feature_group string, measure string, channel string, scale string, angle string, gray_levels string, radial_bin string, is_feature boolean"


def parse_feature_names(spark, names: Sequence[str], channels: Sequence[str] = ()) -> DataFrame:
    rows = [parse_feature_name(n, channels) for n in names]
    return spark.createDataFrame([tuple(vars(r).values()) for r in rows], _PARSED)


def parse_feature_table(names: DataFrame, channels: Sequence[str] = ()) -> DataFrame:
    """The parts of every distinct name of a column `feature`, and its `standard` name, parsed in batches where the names are."""
    columns = [c.split()[0] for c in _PARSED.split(", ")]

    def run(frames):
        for df in frames:
            parsed = [parse_feature_name(n, channels) for n in df["feature"]]
            yield pd.DataFrame([tuple(vars(r).values()) for r in parsed], columns=columns).assign(standard=[standardize_name(r) for r in parsed])

    return names.select("feature").where("feature is not null").distinct().mapInPandas(run, f"{_PARSED}, standard string")


def standardize_name(parsed: FeatureName) -> str:
    """object-free snake form: group, measure, channels, numbers."""
    parts = [parsed.object, parsed.feature_group, parsed.measure, canonical_channel(parsed.channel), parsed.scale, parsed.angle, parsed.gray_levels, parsed.radial_bin]
    return "_".join(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", p).lower() for p in parts if p) if parsed.feature_group else parsed.feature


def standardize_feature_names(df: DataFrame, features: Sequence[str], channels: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({f: standardize_name(parse_feature_name(f, channels)) for f in features})
