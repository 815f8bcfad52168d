"""Cutting lineage in loops, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it has none, a temporary folder is set."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    found = sc.getConf().get("spark.checkpoint.dir") or (now.get() if now.isDefined() else None)
    if not found:
        import tempfile

        found = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
