"""A session with the settings that the library is meant for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution splits skewed joins and coalesces small partitions; times are UTC."""
    builder = SparkSession.builder.appName("rallyframe")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Compute a table once, into the folder that the cluster names in spark.checkpoint.dir, and cut its lineage.

    Only where that setting is absent and the master is local, as in tests, a temporary folder takes its place.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='rallyframe-')}")
    return df.checkpoint()
