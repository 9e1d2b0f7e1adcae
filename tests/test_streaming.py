"""Streams equal tables: three-frame buffers, late frames, trails, restarts from a checkpoint."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from rallyframe.operators import pixels, tracks
from rallyframe.streaming import ordered

POINT = "track_id long, frame long, x double, y double"
FRAME = "clip_id string, frame long, gray array<int>"


def shuffled(rows: list[tuple], slack: int, rng: random.Random) -> list[tuple]:
    """No row comes after one that is more than `slack` frames further on."""
    return [r for _, r in sorted((r[1] + rng.uniform(0, slack), r) for r in rows)]


def run(spark, make, parts: list[list[tuple]], schema: str, folder, name: str) -> list[tuple]:
    """Feed parts one after the other, each in a query of its own that goes on from the same checkpoint."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{name}/in/part={i}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}/in/*")
        query = make(stream).writeStream.format("parquet").option("path", f"{folder}/{name}/out").option("checkpointLocation", f"{folder}/{name}/ck").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return rows_of(spark.read.parquet(f"{folder}/{name}/out"))


def rows_of(df) -> list[tuple]:
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def points():
    rng, rows = random.Random(4), []
    for t in (1, 2, 3):
        frame, x, y = 0, 100.0, 100.0
        for _ in range(60):
            frame += rng.choice([1, 1, 1, 2, 3, 9])
            x, y = x + rng.uniform(-40, 40) + rng.choice([0, 0, 0, 0, 400]), y + rng.uniform(-40, 40)
            rows.append((t, frame, x, y))
    return rows


@pytest.mark.parametrize("slack", [0, 6])
def test_trails_of_a_stream_with_restarts(spark, tmp_path, points, slack):
    rng = random.Random(slack)
    each = {t: shuffled([p for p in points if p[0] == t], slack, rng) for t in (1, 2, 3)}
    parts = [[r for t in each for r in each[t][20 * i : 20 * i + 20]] for i in range(3)] + [[(t, None, None, None) for t in each]]
    got = run(spark, lambda s: ordered.live_trails(s, tracks.trail_age(4.0), slack=slack), parts, POINT, tmp_path, "trails")
    want = rows_of(tracks.smoothed_trails(spark.createDataFrame(points, POINT), tracks.trail_age(4.0)))
    assert tracks.trail_age(4.0) == 10 and tracks.trail_age(30.0) == 40 and len(want) == 180
    assert got == want


def test_the_batch_trail_against_a_plain_loop(spark, points):
    got = {(r.track_id, r.frame): [(p.frame, p.x, p.y) for p in r.trail] for r in tracks.smoothed_trails(spark.createDataFrame(points, POINT), 10, size=16).collect()}
    last, trail = {}, []
    for t, f, x, y in sorted(points):
        p = last.get(t)
        fresh = p is None or f - p[0] > 4 or ((x - p[1]) ** 2 + (y - p[2]) ** 2) ** 0.5 > 230.4
        s = (x, y) if fresh else (0.72 * x + 0.28 * p[3], 0.72 * y + 0.28 * p[4])
        trail = [(f, *s)] if fresh else [q for q in trail if f - q[0] <= 10] + [(f, *s)]
        last[t] = (f, x, y, *s)
        assert [q[0] for q in trail] == [q[0] for q in got[t, f]]
        assert all(abs(a - b) < 2e-6 for q, r in zip(trail, got[t, f], strict=True) for a, b in zip(q, r, strict=True))


@pytest.mark.parametrize("slack", [0, 4])
def test_three_frames_of_a_stream_with_restarts(spark, tmp_path, slack):
    rng = random.Random(7)
    rows = [(c, 2 * f, [rng.randrange(256) for _ in range(12)]) for c in ("a", "b") for f in range(20)] + [("short", 0, [1]), ("short", 1, [2])]
    each = {c: shuffled([r for r in rows if r[0] == c], slack, rng) for c in ("a", "b", "short")}
    parts = [[r for c in each for r in each[c][9 * i : 9 * i + 9]] for i in range(3)] + [[(c, None, None) for c in each]]
    got = run(spark, lambda s: pixels.motion_of(ordered.live_triples(s, slack=slack)), parts, FRAME, tmp_path, "motion")
    assert got == rows_of(pixels.motion_means(spark.createDataFrame(rows, FRAME))) and len(got) == 36


def test_what_waits_comes_out_when_a_key_falls_idle(spark, tmp_path, points):
    mine = [p for p in points if p[0] == 1]
    spark.createDataFrame(mine, POINT).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(POINT).parquet(f"{tmp_path}/in")
    query = ordered.live_sessions(stream, slack=50, idle_ms=500).writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    until = time.time() + 60
    while time.time() < until and spark.table("idle").count() < len(mine):
        time.sleep(1)
    query.stop()
    assert rows_of(spark.table("idle")) == rows_of(tracks.smoothed(spark.createDataFrame(mine, POINT)))


def test_frames_that_come_too_late_are_left_out(spark, tmp_path):
    parts = [[(1, f, float(f), 0.0) for f in (1, 2, 9, 3)], [(1, 2, 0.0, 0.0), (1, 4, 4.0, 0.0), (1, 8, 8.0, 0.0), (1, None, None, None)]]
    got = run(spark, lambda s: ordered.live_sessions(s, slack=5).select("frame", F.lit(0)), parts, POINT, tmp_path, "late")
    assert got == [repr((f, 0)) for f in (1, 2, 3, 4, 8, 9)]
