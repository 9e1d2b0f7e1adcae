"""Blocks of many clips are searched together: few calls, and the paths of each clip alone."""

from __future__ import annotations

import numpy as np
import pandas as pd

from rallyframe.operators import tracklets

CONFIG = tracklets.TrackConfig(max_jump_per_frame=90.0, prediction_error_limit=120.0, max_acceleration=120.0, max_turn_degrees=170.0, min_points=3)


def clips(many: int, frames: int) -> pd.DataFrame:
    rng = np.random.default_rng(4)
    rows = [(f"c{c}", f, k + 1, f"{f}.{k}", float(rng.integers(300)), float(rng.integers(200)), float(rng.random())) for c in range(many) for f in range(frames) for k in range(3)]
    return pd.DataFrame(rows, columns=["clip_id", "frame", "rank", "candidate_id", "x", "y", "score"])


def test_many_short_clips_give_the_paths_of_each_alone(spark):
    pdf = clips(12, 150)
    keys = ["clip_id", "seed_frame", "seed_rank", "path", "score", "candidate_ids", "errors"]
    got = sorted(tuple(r) for r in tracklets.hypotheses(spark.createDataFrame(pdf).repartition(7), CONFIG).select(*keys).collect())
    alone = [tuple(r) for c in ("c0", "c5", "c11") for r in tracklets.hypotheses(spark.createDataFrame(pdf[pdf["clip_id"] == c]), CONFIG).select(*keys).collect()]
    assert alone and sorted(alone) == [r for r in got if r[0] in ("c0", "c5", "c11")]
    other = sorted(tuple(r) for r in tracklets.hypotheses(spark.createDataFrame(pdf), CONFIG, block=200).select(*keys).collect())
    assert got == other


def test_blocks_share_a_call(spark):
    """Short clips used to cost a call of the search each."""
    calls = spark.createDataFrame(clips(40, 50))
    plan = tracklets.hypotheses(calls, CONFIG)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan


def test_tables_end_where_a_block_ends():
    pdf = pd.DataFrame({"clip_id": ["a"] * 7 + ["b"] * 2 + ["c"], "__part": [0, 0, 1, 1, 1, 1, 1, 1, 2, 2], "n": range(10)})
    for size in range(1, 11):
        out = list(tracklets._whole_blocks(iter([pdf.iloc[i : i + size] for i in range(0, 10, size)])))
        assert [n for part in out for n in part["n"]] == list(range(10))
        held = [(c, p) for part in out for c, p in set(zip(part["clip_id"], part["__part"], strict=True))]
        assert len(held) == len(set(held)) == 5


def test_means_equal_those_of_sums():
    table = np.random.default_rng(1).random((50, 9)) * 10.0 ** np.random.default_rng(2).integers(-9, 9, (50, 9))
    assert tracklets._means(table).tolist() == [sum(r) / 9 for r in table.tolist()]
    assert tracklets._means(np.zeros((2, 0))).tolist() == [0.0, 0.0]
