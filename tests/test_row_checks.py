"""Tables of a tracking job are checked by one count of names."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rallyframe.operators import jobs


def test_rows_are_checked_against_candidates_in_one_pass(spark):
    """Candidates were counted by name twice. Repeated, unknown and null names count as they did."""
    found = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "a"), ("x", "b"), ("y", None), ("y", None)], "clip_id string, candidate_id string")
    totals = spark.createDataFrame([("x", 4), ("y", 2)], "clip_id string, t long").select("clip_id", F.struct(F.col("t").alias("total_candidates")).alias("summary"))
    points = spark.createDataFrame([("x", 1, 1, "a"), ("x", 1, 2, "q"), ("x", 1, 3, "q"), ("y", 2, 1, None)], "clip_id string, track_id long, point_index long, candidate_id string")
    sizes = spark.createDataFrame([("x", 1, 3), ("y", 2, 1)], "clip_id string, track_id long, point_count long")
    out = jobs.row_problems(found, totals, points, sizes)
    assert sorted(tuple(r) for r in out.collect()) == [("candidates", "repeated", 3), ("tracks", "unknown candidate", 3)]
    named = [l for l in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if re.search(r"Aggregate \[clip_id#\d+, candidate_id#\d+\]", l)]
    assert len(named) == 1
