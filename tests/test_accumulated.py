"""Evaluation states: merged parts equal the whole, in any order, within the stated error."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.operators import accumulated, evaluation

KEYS = ["match_id"]


@pytest.fixture(scope="module")
def rows(spark):
    n = 12_000
    h = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(10_000)) / 10_000.0
    error = F.when(h("null") > 0.05, h("e") * h("f") * 120)
    return spark.range(n).select("id", (F.col("id") % 3).alias("match_id"), (F.col("id") % 7).alias("day"), (h("v") > 0.2).alias("visible"), h("c").alias("conf"), error.alias("error"), (h("l") / 3).alias("loss")).cache()


def state(rows):
    return accumulated.accumulated(rows, KEYS, F.col("conf") > 0.3, F.col("error"), F.col("conf"), F.col("loss"))


def test_merged_parts_equal_the_whole(spark, rows, tmp_path):
    for day in range(7):
        state(rows.where(F.col("day") == day)).write.parquet(f"{tmp_path}/day={day}")
    parts = [spark.read.parquet(f"{tmp_path}/day={d}") for d in range(7)]
    whole = accumulated.finalized(state(rows), KEYS).toPandas().set_index("match_id")
    one = accumulated.merged(KEYS, *parts)
    two = accumulated.merged(KEYS, accumulated.merged(KEYS, *parts[4:]), parts[2], accumulated.merged(KEYS, parts[3], parts[0]), parts[1])
    table = rows.toPandas()
    for got in (one, two):
        got = accumulated.finalized(got, KEYS).toPandas().set_index("match_id")
        exact = [c for c in whole if "median" not in c and "p90" not in c]
        assert got.loc[whole.index, exact].equals(whole[exact])
        for match, t in table.groupby("match_id"):
            seen = t[t.visible & t.error.notna()]
            for name, q, values in (("raw_median_error", 0.5, seen.error), ("valid_median_error", 0.5, seen.error[seen.conf > 0.3]), ("valid_p90_error", 0.9, seen.error[seen.conf > 0.3]), ("median_confidence", 0.5, t.conf)):
                assert abs((values <= got.loc[match, name]).mean() - q) <= accumulated.rank_error(800) + 1 / len(values)
    assert accumulated.rank_error(200) == pytest.approx(0.0133, abs=1e-4)


def test_counts_against_plain_ones(rows):
    t = rows.toPandas()
    for r in accumulated.finalized(state(rows), KEYS).collect():
        m = t[t.match_id == r.match_id]
        hit, valid = m.visible & (m.error <= 20), m.conf > 0.3
        assert (r.samples, r.visible, r.valid_invisible, r.raw_hits, r.valid_hits) == (len(m), m.visible.sum(), (valid & ~m.visible).sum(), hit.sum(), (hit & valid).sum())
        assert r.mean_loss == pytest.approx(m.loss.mean()) and r.mean_error == pytest.approx(m.error[m.visible].mean()) and r.fp_rate == pytest.approx((valid & ~m.visible).sum() / (~m.visible).sum())


def test_empty_groups(spark, rows):
    none = rows.where("not visible").withColumn("error", F.lit(None).cast("double")).withColumn("loss", F.lit(None).cast("double"))
    r = accumulated.finalized(state(none), KEYS).first()
    assert r.recall is None and r.raw_median_error is None and r.mean_loss is None and r.median_confidence is not None
    assert state(rows.limit(0)).count() == 0


def predictions(rows):
    side = lambda c: [F.lit(5.0).alias(f"{c}_x"), F.lit(5.0).alias(f"{c}_y")]
    return rows.select("day", "visible", F.when(F.col("match_id") == 0, None).otherwise("50").alias("fps_nominal"), "match_id", F.col("conf").alias("global_conf"), F.col("loss").alias("local_conf"), F.round("error", 1).alias("global_error"), (F.round("error", 1) / 2).alias("refined_error"), *side("global"), *side("refined"))


def test_exact_cells_merge_to_the_whole(rows):
    p = predictions(rows)
    order = ["stage", "grouping", "value"]
    whole = evaluation.grouped_stage_metrics(p).toPandas().sort_values(order, ignore_index=True)
    parts = [evaluation.error_cells(p.where(F.col("day") == d)) for d in (3, 0, 6, 1, 2, 5, 4)]
    got = evaluation.metrics_of_cells(evaluation.merged_cells(evaluation.merged_cells(*parts[:3]), *parts[3:])).toPandas().sort_values(order, ignore_index=True)
    assert got[whole.columns].equals(whole)
    t = p.toPandas()
    every = whole[(whole.stage == "global") & (whole.grouping == "all")].iloc[0]
    errors = t.global_error[t.visible & t.global_error.notna()]
    assert every.raw_median_error == pytest.approx(np.percentile(errors, 50)) and every.valid_p90_error == pytest.approx(np.percentile(errors[t.global_conf >= 0.15], 90))


def test_the_predictions_are_read_once(rows):
    plan = evaluation.grouped_stage_metrics(predictions(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and len(re.findall("LogicalRDD", plan)) <= 12
