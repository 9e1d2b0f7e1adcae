"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_trie, fingerprints, hard_negatives, line_dedup, near_dedup, packing, quality, secret_scan, sharding, toxicity, url_filter, warc
from .common import documents
from .oracle import ORACLE_SQL  # noqa: F401


def vocabulary() -> str:
    """The public vocabulary file, which the installed package of tokenizers carries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), vocabulary(), capacity=2048, end_id=0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.resolved(warc.captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    headers = [F.try_element_at("merged_headers", F.lit(h)).alias(c) for h, c in (("date", "merged_date"), ("content-type", "merged_type"), ("server", "merged_server"), ("cache-control", "merged_cache"), ("expires", "merged_expires"))]
    return rows.select("record_id", "canonical", "outcome", "resolved_id", "resolved_digest", *headers)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.NearDedup(k=2).labelled(documents(spark, sf_dir))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.coded(documents(spark, sf_dir), vocabulary())


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scanned(documents(spark, sf_dir)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.trained(url_filter.labelled_urls(spark))
    return url_filter.judged_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.trained(documents(spark, sf_dir), labels, learn=~toxicity.held_out())
    return toxicity.scored(documents(spark, sf_dir), model, threshold=0.3)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, known = conversation_trie.spliced(conversation_trie.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return conversation_trie.trie(rows, known).drop("digest", "parent")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved))
    return hard_negatives.mined(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, window=(50, 95))


QUERIES = {"op4_line_dedup": op4_line_dedup, "op8_warc_revisits": op8_warc_revisits, "op5_minhash_near_dedup": op5_minhash_near_dedup, "op2_fingerprints": op2_fingerprints, "op10_secret_scans": op10_secret_scans, "op1_best_fit_packing": op1_best_fit_packing, "op6_bpe": op6_bpe, "op3_quality_rules": op3_quality_rules, "op7_sharding": op7_sharding, "op9_url_filters": op9_url_filters, "op11_toxicity": op11_toxicity, "op12_conversation_trie": op12_conversation_trie, "op13_hard_negatives": op13_hard_negatives}
