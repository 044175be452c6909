"""Controls: annotation of control classes and resolution of `reference=` to a predicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE, CONTROL = "Metadata_Control_Type", "Metadata_Control"
CLASSES = ("negcon", "poscon", "treatment", "empty")
#: Columns that may name the treatment, the first present is used.
PERTURBATION_KEYS = ("Metadata_Perturbation", "Metadata_Compound", "Metadata_Treatment", "Metadata_BroadSample")


def find_perturbation_key(df: DataFrame) -> str:
    for k in PERTURBATION_KEYS:
        if k in df.columns:
            return k
    raise ValueError(f"none of {PERTURBATION_KEYS} is a column")


def annotate_controls(df: DataFrame, negcon: Sequence[str] = ("DMSO",), poscon: Sequence[str] = (), key: str | None = None) -> DataFrame:
    """Control class of each row by its treatment.

    Listed treatments get their class; a row that was negcon and is not listed becomes treatment; other upstream
    classes stay; the rest is treatment. Metadata_Control is true for all but treatments.
    """
    key = key or find_perturbation_key(df)
    old = F.col(TYPE) if TYPE in df.columns else F.lit(None).cast("string")
    kind = F.when(F.col(key).isin(*negcon), "negcon")
    if poscon:
        kind = kind.when(F.col(key).isin(*poscon), "poscon")
    kind = kind.when(old == "negcon", "treatment").otherwise(F.coalesce(old, F.lit("treatment")))
    return df.withColumn(TYPE, kind).withColumn(CONTROL, F.col(TYPE) != "treatment")


def resolve(df: DataFrame, reference: str | Column | None) -> Column:
    """Predicate of the reference rows: all, a control class, or a boolean column (others are refused)."""
    if reference is None:
        return F.lit(True)
    if isinstance(reference, Column):
        return reference
    if reference in ("negcon", "poscon"):
        if TYPE not in df.columns:
            raise ValueError(f"{TYPE} is missing; annotate the controls first")
        return F.col(TYPE) == reference
    if dict(df.dtypes).get(reference) != "boolean":
        raise TypeError(f"reference column {reference} is not boolean")
    return F.col(reference)


def check_reference(df: DataFrame, reference: Column, by: Sequence[str], least: int = 1) -> None:
    """Every group must hold reference rows; a missing control class is an error."""
    bad = df.groupBy(*by).agg(F.count(F.when(reference, 1)).alias("n"), F.count(F.when(reference.isNull(), 1)).alias("missing")).where(f"n < {least} or missing > 0")
    first = bad.first()
    if first is not None:
        raise ValueError(f"group {[first[k] for k in by]} has {first['n']} reference rows and {first['missing']} rows without a class")
