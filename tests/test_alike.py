"""Equal sets travel in one row: what is shuffled grows with the sets, not with their square."""

from __future__ import annotations

import random

import pytest

from rallyframe.operators import tracks


def written(spark, make) -> tuple[int, int]:
    """Rows of the table that is made, and rows that all stages up to it write to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total() -> int:
        sc.listenerBus().waitUntilEmpty()
        store = sc.statusStore()
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    return make().count(), total() - before


def shuffled(spark, copies: int) -> tuple[int, int]:
    rng = random.Random(1)
    shapes = [rng.sample(range(20), rng.randrange(1, 6)) for _ in range(40)]
    rows = [(0, 40 * c + i, x) for c in range(copies) for i, shape in enumerate(shapes) for x in shape]
    return written(spark, lambda: tracks.overlaps(spark.createDataFrame(rows, "g long, s long, x long"), "s", "x", "g"))


def test_shuffled_rows_grow_with_the_sets(spark, monkeypatch):
    """Every row used to be copied for each DEALT sets of an item."""
    monkeypatch.setattr(tracks, "DEALT", 50)
    few, many = shuffled(spark, 8), shuffled(spark, 32)
    assert many[0] > 12 * few[0] and many[1] < 5 * few[1]


@pytest.mark.parametrize(("alike", "kind"), [(1, "long"), (3, "long"), (128, "string")])
def test_sets_that_are_equal(spark, monkeypatch, alike, kind):
    monkeypatch.setattr(tracks, "ALIKE", alike)
    rng = random.Random(alike)
    sets = {(i % 2, i): {rng.randrange(6) for _ in range(rng.randrange(1, 4))} for i in range(120)}
    rows = [(g, s, x) for (g, s), items in sets.items() for x in items for _ in range(2)]
    frame = spark.createDataFrame(rows, "g long, s long, x long").selectExpr("g", f"cast(s as {kind}) as s", "x")
    shared = {(g, str(s), str(t)): len(a & b) / min(len(a), len(b)) for (g, s), a in sets.items() for (h, t), b in sets.items() if g == h and s < t}
    got = [(r.g, *sorted((str(r.a), str(r.b)), key=int), r.overlap) for r in tracks.overlaps(frame, "s", "x", "g").collect()]
    assert sorted(got) == sorted((*k, round(v, 6)) for k, v in shared.items() if round(v, 6) >= 0.65)
    assert all(r.a < r.b for r in tracks.overlaps(frame, "s", "x", "g").collect())
