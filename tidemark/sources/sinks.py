"""Writers of run folders: CSV tables, JSON lines, Parquet, manifests, logs, retention."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def padded(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with these columns in this order; missing ones are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """CSV with a header; single: one file, for tables that one task can hold."""
    out = padded(df, columns)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def finite_only(df: DataFrame) -> DataFrame:
    """df with NaN and infinities as null."""
    bad = {c for c, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if c in bad else F.col(c) for c in df.columns))


def write_json_lines(df: DataFrame, path: str) -> None:
    finite_only(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def config_hash(config: dict) -> str:
    """sha256 of the config as JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_document(spark: SparkSession, doc: dict, path: str) -> None:
    """One JSON document with its hash, through Spark's file systems."""
    text = json.dumps(doc | {"config_hash": config_hash(doc)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def list_text(column: str, digits: int | None = None) -> Column:
    """[a, b, c] of an array."""
    item = f"cast(round(x, {digits}) as string)" if digits is not None else "cast(x as string)"
    return F.concat(F.lit("["), F.expr(f"array_join(transform({column}, x -> {item}), ', ')"), F.lit("]"))


def retained(runs: DataFrame, most: int, by: str = "mode", newest: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """The newest `most` runs of each mode, and those that go."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(newest)))
    numbered = runs.withColumn("_k", k)
    return numbered.where(F.col("_k") <= most).drop("_k"), numbered.where(F.col("_k") > most).drop("_k")


class History:
    """A bounded log of runs, the newest first, in a Parquet table."""

    def __init__(self, spark: SparkSession, path: str, most: int = 50, note_length: int = 300):
        self.spark, self.path, self.most, self.note_length = spark, path, most, note_length

    def entries(self) -> DataFrame:
        from tidemark.sources.scans import exists

        schema = "position long, run_id string, note string, body string"
        if not exists(self.spark, f"{self.path}/*.parquet"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).orderBy(F.desc("position"))

    def _write(self, rows: list) -> None:
        # at most `most` rows: the log is bounded
        self.spark.createDataFrame([tuple(r) for r in rows], "position long, run_id string, note string, body string").coalesce(1).write.mode("overwrite").parquet(self.path)

    def add(self, run_id: str, body: dict, note: str = "") -> str:
        """Adds a run; a taken id gets a suffix. The id."""
        rows = self.entries().collect()
        taken, name, k = {r["run_id"] for r in rows}, run_id, 2
        while name in taken:
            name, k = f"{run_id}_{k}", k + 1
        top = max((r["position"] for r in rows), default=0) + 1
        self._write([(top, name, note.strip()[: self.note_length], json.dumps(body, sort_keys=True)), *rows][: self.most])
        return name

    def annotate(self, run_id: str, note: str) -> bool:
        rows = self.entries().collect()
        self._write([(r["position"], r["run_id"], note.strip()[: self.note_length] if r["run_id"] == run_id else r["note"], r["body"]) for r in rows])
        return any(r["run_id"] == run_id for r in rows)

    def clear(self) -> None:
        self._write([])
