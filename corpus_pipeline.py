"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents:

1. quality rules: documents that the rules reject go.
2. MinHash near-dedup: of each group of near-duplicates (five words, similarity 0.8 or more) the document with the smallest id
   stays; of rows that share an id one stays. Documents without an id stay.
3. benchmark decontamination: documents with a twentieth of their words or more inside benchmark windows go.
4. secret scans: the values of live-looking secrets are replaced by a mark, n_chars follows; all documents stay.
5. best-fit packing: the pieces of all documents with their sequence and offset.

A null text counts as empty: the quality rules reject it. Very long texts go through whole. Of documents that tie, one
stays: the smallest id, then the smallest hash of the text. An empty table gives an empty result. Columns besides those
of documents are carried along by the stages and never read. What a stage wrote on its way is deleted when its output
stands, the output when the next one's does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, entry, minhash, packing, quality, secret_scan
from tidemark.llm.shared import Written, small

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    gone = Written(minhash.near_duplicates(docs, size=5, part=80, whole=100).where("not kept").select(F.col("doc_id").alias("id")).distinct()).df
    kept = rows.join(small(gone, gone.count(), 16), "id", "left_anti")
    # rows that share an id are one document: the one with the smallest hash stays, of equal ones any
    shared = Written(kept.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")).df
    shared = small(shared, shared.count(), 16)
    single = kept.join(shared, "id", "left_anti")
    several = kept.join(shared, "id", "left_semi").groupBy("id").agg(F.min_by("row", "h").alias("row"))
    return single.select("row.*").union(several.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, entry.read(spark, sf_dir, "benchmark"), width=13, part=20)
    gone = Written(found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()).df
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    return rows.join(small(gone, gone.count(), 24), same, "left_anti").select("row.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(docs)
    text = F.when(F.expr("exists(spans, x -> x.live)"), secret_scan.redacted("row.text", "spans")).otherwise(F.col("row.text"))
    fresh = found.select("row", text.alias("_text"), F.expr("exists(spans, x -> x.live)").alias("_changed"))
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_changed"), F.length("_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return fresh.select(*(new[c].alias(c) if c in new else F.col(f"row.{c}") for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, entry.tokenizer_path(), size=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Sketch thresholds, connected components and tokenizers are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = entry.read(spark, sf_dir, "documents")
    before, last = list(Written.kept), None
    for _, stage in STAGES[:-1]:
        last = Written(stage(spark, docs, sf_dir))
        Written.drop_all(before, last)
        docs = last.df
    return STAGES[-1][1](spark, docs, sf_dir)
