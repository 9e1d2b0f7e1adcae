"""Selections hold no group in one task, and folds multiply no rows before they are chosen."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rallyframe.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    clip = F.concat(F.lit("c"), F.col("id") % 4)
    return spark.range(6000).select(clip.alias("clip_id"), F.floor(F.col("id") / 12).alias("frame"), (F.floor(F.col("id") / 4) % 3 + 1).alias("rank"), F.col("id").cast("string").alias("candidate_id"), F.pmod(F.xxhash64("id"), F.lit(6)).alias("h")).repartition(5).cache()


def plain_plan(rows, holdout, same_frame, missing_times, invisible_times):
    """The selection of one fold, row by row."""
    rows = [r for r in rows if r["clip_id"] != holdout and r["category"] != "ignore"]
    key = lambda r: (r["clip_id"], r["frame"], r["rank"], r["candidate_id"])
    rows.sort(key=key)
    has = {(r["clip_id"], r["frame"]) for r in rows if r["category"] == "positive"}
    place, seen = {}, {}
    for r in rows:
        k = (r["clip_id"], r["frame"], r["category"])
        place[key(r)] = seen[k] = seen.get(k, 0) + 1
    of = lambda c: [r for r in rows if r["category"] == c]
    turns = lambda c, n: sorted(of(c), key=lambda r: (place[key(r)], *key(r)))[:n]
    p = len(of("positive"))
    chosen = of("positive") + of("hard_negative") + [r for r in of("same_frame") if (r["clip_id"], r["frame"]) in has and place[key(r)] <= same_frame] + turns("visible_missing", missing_times * p) + turns("invisible", invisible_times * p)
    return [(holdout, i, r["candidate_id"], r["category"]) for i, r in enumerate(chosen)]


@pytest.mark.parametrize("times", [(2, 1), (0, 3), (1, 0)])
def test_folds_equal_the_plain_plan(rows, times):
    names = ["positive", "hard_negative", "same_frame", "visible_missing", "invisible", "ignore"]
    rare = rows.where((F.col("h") > 0) | (F.col("frame") % 5 == 0))
    frame = rare.withColumn("category", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("h") + 1).cast("int"))).drop("h")
    holdouts = ["c0", "c3", "absent"]
    got = sorted((r.holdout_clip, r.sample_order, r.candidate_id, r.category) for r in sampling.fold_plan(frame, holdouts, 2, *times).collect())
    local = [r.asDict() for r in frame.collect()]
    assert got == sorted(x for h in holdouts for x in plain_plan(local, h, 2, *times))


def test_numbers_over_text_parts_pass_no_single_task(spark, rows):
    out = sampling.numbered(rows.withColumn("span", F.floor(F.col("frame") / 50)), ("clip_id", "span", "frame", "rank", "candidate_id"), "n", ("clip_id", "span"))
    want = rows.withColumn("n", F.row_number().over(Window.orderBy("clip_id", "frame", "rank", "candidate_id")) - 1)
    assert out.select("candidate_id", "n").exceptAll(want.select("candidate_id", "n")).isEmpty()
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert sampling.numbered(rows.limit(0), ("clip_id", "frame"), "n", ("clip_id",)).count() == 0


@pytest.mark.parametrize("make", [lambda r: sampling.even_sample(r, 7, "clip_id", ("frame", "rank", "candidate_id")), lambda r: sampling.stratified_sample(r.withColumn("flag", F.col("h") == 0), "flag", "clip_id", ("frame", "rank", "candidate_id"))])
def test_samples_hold_no_group(rows, make):
    out = make(rows)
    windows = re.findall(r"windowspecdefinition\(([^)]*)", out._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all("__part" in w or "__sum" not in w and "__thousand" in w for w in windows)


def test_round_robin_reads_its_input_once(rows):
    out = sampling.round_robin(rows, 3000)
    assert out.count() == 3000 and "InMemoryTableScan" not in out._jdf.queryExecution().executedPlan().toString()


def test_digests_of_large_numbers(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 10**13), ("a", 3 * 10**15), ("b", 2)], "k string, n long").withColumn("d", F.sha2(F.col("n").cast("string"), 256))
    assert sampling.tree_digest(rows, "k", "n", "d").count() == 2
