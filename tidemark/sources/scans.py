"""Readers of run folders: CSV tables, JSON lines, report documents, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches the path or pattern, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def csv_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV file or folder with a header; empty if there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def json_lines(spark: SparkSession, path: str, schema: StructType, keep: Column | None = None) -> DataFrame:
    """JSON lines with the schema's keys only; blank and broken lines are dropped. keep: rows to keep."""
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_r"))
    found = parsed.where(F.col("_r._bad").isNull()).select("_r.*").drop("_bad")
    return found if keep is None else found.where(keep)


def head(spark: SparkSession, path: str, schema: StructType, most: int) -> DataFrame:
    """The first rows of a JSON lines file."""
    return json_lines(spark, path, schema).limit(most)


def document(spark: SparkSession, path: str, schema: StructType, defaults: dict[str, object]) -> DataFrame:
    """One JSON document a file; defaults fill what is missing."""
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in schema.names))


def catalog(spark: SparkSession, pattern: str, schema: StructType, mode: str | None = None, most: int | None = None) -> DataFrame:
    """Reports of all run folders, the newest first; run_id is the folder's name."""
    found = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("run_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    if mode is not None:
        found = found.where(F.col("mode") == mode)
    ordered = found.orderBy(F.desc("run_id"))
    return ordered if most is None else ordered.limit(most)


def same_signature(runs: DataFrame, report: DataFrame, signature: list[str], knobs: list[str], rows: str) -> DataFrame:
    """Summary rows of all runs whose signature is the report's, each with the run's knobs."""
    wanted = report.select(F.struct(*signature).alias("_sig")).distinct()
    alike = runs.withColumn("_sig", F.struct(*signature)).join(F.broadcast(wanted), "_sig", "left_semi")
    return alike.select("run_id", *knobs, F.explode(rows).alias("_r")).select("run_id", *knobs, "_r.*")


def with_path_parts(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """df with the groups of a pattern over the path of each row's file."""
    return df.withColumns({n: F.regexp_extract(F.input_file_name(), pattern, k) for k, n in enumerate(names, 1)})
