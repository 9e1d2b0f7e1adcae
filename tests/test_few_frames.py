"""Samples rank only the frames that hold a chosen row, and choose the same rows as a plain numbering."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rallyframe.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    out = spark.range(9000).select(F.when(F.col("id") % 11 == 0, "b").when(F.col("id") < 40, "c").otherwise("a").alias("clip"), F.expr("cast(if(id % 1000 = 7, null, (id * 37) % 9000 div 5 * 9 - 500) as int)").alias("frame"), (F.col("id") * 7919 % 9001).alias("rank"))
    return out.withColumn("flag", F.col("frame") % 17 == 0)


def test_samples_equal_a_plain_numbering(rows):
    w = Window.partitionBy("clip")
    plain = rows.select("*", (F.row_number().over(w.orderBy("frame", "rank")) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    wanted = {r.clip: {r.n - 1 if j == 31 else j * (r.n - 1) // 31 for j in range(32)} for r in plain.select("clip", "n").distinct().collect()}
    got = sorted((r.clip, r["index"], r["rank"]) for r in sampling.even_sample(rows, 32, "clip", ("frame", "rank")).collect())
    assert got == sorted((r.clip, r.i, r["rank"]) for r in plain.collect() if r.n <= 32 or r.i in wanted[r.clip])


def test_strata_equal_a_plain_choice(rows):
    kept = {}
    for r in rows.collect():
        kept.setdefault((r.clip, bool(r.flag)), []).append((r.frame is not None, r.frame, r["rank"]))
    want = []
    for clip in ("a", "b"):
        few = min(8, len(kept.get((clip, True), ())))
        for flag, k in ((True, few), (False, 32 - few)):
            some = sorted(kept.get((clip, flag), ()), key=lambda v: (v[0], v[1] or 0, v[2]))
            n = len(some)
            at = range(n) if n <= k else [n // 2] if k == 1 else {round(j * (n - 1) / (k - 1)) for j in range(k)}
            want += [(clip, *some[i][1:]) for i in at] if k else []
    got = [(r.clip, r.frame, r["rank"]) for r in sampling.stratified_sample(rows, "flag", "clip", ("frame", "rank"), least=100).collect()]
    assert len(got) == 64 and sorted(got, key=str) == sorted(want, key=str)


def test_only_chosen_frames_are_sorted(rows):
    """All rows used to be numbered before a few were taken."""
    for out in (sampling.even_sample(rows, 5, "clip", ("frame", "rank")), sampling.stratified_sample(rows, "flag", "clip", ("frame", "rank"), least=100)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall("windowspecdefinition", plan)) == 1 and plan.index("Window [") < plan.index("Join LeftSemi")
