"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's documents. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import line_dedup, near_dedup, packing, quality, secret_scan
from rallyframe.llm.common import documents, stored
from rallyframe.llm.queries import vocabulary


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the changed text."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.kept_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one; the documents all stay."""
    return _measured(line_dedup.deduplicated(docs), docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return near_dedup.NearDedup(k=5, percent=80).kept_documents(docs).select(docs.columns)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; the documents all stay."""
    return _measured(secret_scan.redacted(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences with their places in sequences of 2048 tokens."""
    return packing.packed_documents(docs, vocabulary(), capacity=2048, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", minhash_near_dedup),
    ("secret scans", scan_secrets),
    ("best-fit packing", pack),
]

#: Packing places pieces by a greedy process that SQL can't express; the tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
