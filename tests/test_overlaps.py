"""Pairs of overlapping sets are counted where they are found, in many tasks."""

from __future__ import annotations

import random

import pytest

from rallyframe.operators import tracks


def wanted(rows, least):
    sets: dict = {}
    for g, s, x in rows:
        sets.setdefault((g, s), set()).add(x)
    return {(g, s, t, len(a & b), round(len(a & b) / min(len(a), len(b)), 6)) for (g, s), a in sets.items() for (h, t), b in sets.items() if g == h and s < t and round(len(a & b) / min(len(a), len(b)), 6) >= least}


@pytest.mark.parametrize(("kind", "step"), [("long", 1), ("long", 16), ("string", 1)])
@pytest.mark.parametrize("dealt", [2, 1024])
def test_items_that_share_a_bit(spark, monkeypatch, kind, step, dealt):
    monkeypatch.setattr(tracks, "DEALT", dealt)
    rng = random.Random(step)
    rows = [(i % 2, i, step * rng.choice(range(30))) for i in range(80) for _ in range(rng.randrange(1, 14))]
    frame = spark.createDataFrame(rows, "g long, s long, x long").selectExpr("g", "s", f"cast(x as {kind}) as x")
    for least in (0.65, 1.0):
        assert {tuple(r) for r in tracks.overlaps(frame, "s", "x", "g", least).collect()} == wanted(rows, least)


def test_the_pairs_of_a_common_item_are_dealt(spark, monkeypatch):
    """One group with one common item: its pairs come out of many tasks and pass no shuffle."""
    monkeypatch.setattr(tracks, "DEALT", 50)
    rows = spark.createDataFrame([(0, s, 7) for s in range(400)], "g long, s long, x long")
    out = tracks.overlaps(rows, "s", "x", "g")
    sizes = out.select("a", "b").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(sizes) == 400 * 399 // 2 and sum(s > 0 for s in sizes) > 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
