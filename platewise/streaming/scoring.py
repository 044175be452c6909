"""Row-local operators on streams: frozen fits joined as static tables, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.normalize import apply_fit


def normalize_stream(stream: DataFrame, fitted: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Robust z of arriving rows by a table of `normalize.fit`: a stream-static join, without state."""
    return apply_fit(stream, fitted, features, by)


def composition_stream(stream: DataFrame, ts: str, cluster: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of clusters in tumbling windows; rows later than the watermark are dropped, as Spark does."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), cluster).agg(F.count(F.lit(1)).alias("n"))


def flag_stream(stream: DataFrame, features: Sequence[str], limit: float) -> DataFrame:
    """qc_fail: a missing feature, or one beyond the limit in absolute value."""
    bad = F.lit(False)
    for f in features:
        bad = bad | F.col(f).isNull() | (F.abs(f) > limit)
    return stream.withColumn("qc_fail", bad)
