"""Cutting a plan where several steps read what an expensive one made."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder that spark.checkpoint.dir names, so that lost executors lose nothing.

    Only a session of one machine may go without that setting; it gets a temporary folder.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file:{tempfile.mkdtemp(prefix='spark-')}"
        context.setCheckpointDir(base)
    return df.checkpoint()
