"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; a temporary folder only in a local session where that is unset; elsewhere executors wouldn't see it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lodestrata.scratch", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("lodestrata.scratch", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what comes after reads files, which survive a lost executor."""
    path = f"{scratch_path(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
