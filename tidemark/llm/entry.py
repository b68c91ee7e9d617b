"""The queries of the text operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, minhash, oracles, packing, quality, resharding, secret_scan, token_counts, toxicity, url_filter
from .shared import held_out

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out("doc_id")))
    found = docs.select("doc_id", held_out("doc_id").alias("held_out"), langid.predict(docs, model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), size=4, part=80, whole=100)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.labelled(docs.where(~held_out("doc_id")), labels))
    found = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxicity.score(docs, model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(read(spark, sf_dir, "documents"), ["doc_id"])
    kinds = list(secret_scan.PATTERNS)
    count = lambda k: F.expr(f"size(filter(spans, x -> x.kind = {kinds.index(k)}))").cast("long").alias(f"n_{k}")
    base = secret_scan.joined_spans(f"x.kind < {len(secret_scan.BASE)}")
    return found.select("row.doc_id", *map(count, secret_scan.BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.joined_spans("true").alias("spans"), F.expr("size(filter(spans, x -> x.live))").cast("long").alias("n_live"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), width=13, part=20).drop("h")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), size=2048, end_id=0)


#: The layout that op10 finds: 12 shards by the hash of the source, so of very unequal sizes.
OLD_SHARDS = 12


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")) % OLD_SHARDS
    found = resharding.reshard(read(spark, sf_dir, "documents"), old, 8, ["doc_id"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": oracles.QUALITY, "op8_decontamination": oracles.DECONTAMINATION}
