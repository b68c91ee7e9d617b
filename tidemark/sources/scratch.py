"""Intermediate tables: in folders under spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the JVM ends; in local mode without the setting, in an own folder."""
    context = spark.sparkContext
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tidemark-"))
    path = f"{base.rstrip('/')}/tidemark-scratch/{context.applicationId}/{uuid.uuid4().hex}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: what is read more than once is made once."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
