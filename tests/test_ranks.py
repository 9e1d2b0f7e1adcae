"""Cells of counted values are found once, however often the plan reads them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.operators import ranks


def test_cells_are_found_once(spark):
    """Approximate quantiles depend on the order of arrival, so two evaluations in one plan may give two sets of cells."""
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("v"))
    counted = ranks.counted_values(rows, ["k"], "v", 16)
    assert "approx" not in counted._jdf.queryExecution().optimizedPlan().toString()
    for k, mine in {r.k: r.vs for r in rows.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("vs")).collect()}.items():
        got = {r.v: (r["__first"], r["__n"], r["__size"]) for r in counted.where(F.col("k") == k).collect()}
        assert got == {v: (mine.index(v), mine.count(v), len(mine)) for v in set(mine)}
