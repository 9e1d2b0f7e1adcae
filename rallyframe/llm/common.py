"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, `[\x20\x09-\x0D]`, as a Java regex class.
SPACE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; only where that is unset and the
    master is local (tests) a temporary folder takes its place."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='rallyframe-')}"
    if not known.isDefined():
        context.setCheckpointDir(path)
    return path


def _written_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/rallyframe/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: this cuts the lineage, a lost executor doesn't take it
    along, and columns stay prunable. What an application wrote stays until `discard_stored`."""
    spark = df.sparkSession
    path = f"{_written_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_stored(spark: SparkSession) -> None:
    """Delete all tables that this application stored. Results that read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_written_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str | Column = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else. Meant for short strings."""
    return F.translate(column, UPPER, UPPER.lower())


def rows_in(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
