"""Scans by span equal plain windows over whole keys, and no task holds a key."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rallyframe.operators import scan, tracks


@pytest.fixture(scope="module")
def points(spark):
    """Three tracks: a long one with gaps and jumps, one that skips whole spans, one of a single point."""
    at = spark.range(4000).select(F.col("id"), F.xxhash64("id").alias("h"))
    frame = F.when(F.col("id") < 2500, F.col("id") + F.floor(F.col("id") / 97) * 9).otherwise(F.col("id") * 150)
    far = F.when(F.col("id") % 211 == 0, 900.0).otherwise(0.0)
    rows = at.select(F.when(F.col("id") < 2500, "a").when(F.col("id") < 3999, "b").otherwise("c").alias("track_id"), frame.alias("frame"), (F.pmod("h", F.lit(1000)) / 7 + far).alias("x"), (F.pmod(F.shiftright("h", 20), F.lit(1000)) / 9).alias("y"))
    return rows.withColumn("v", F.when(F.col("frame") % 13 != 0, F.col("x"))).repartition(6).cache()


def rows_of(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [7, 64, 4096])
def test_previous_rows(points, size):
    w = Window.partitionBy("track_id").orderBy("frame")
    got = scan.with_previous(points, "track_id", ("frame", "x"), size=size).select("track_id", "frame", "__one.frame", "__one.x", "__two.frame", "__two.x")
    want = points.select("track_id", "frame", *[F.lag(c, n).over(w) for n in (1, 2) for c in ("frame", "x")])
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize(("size", "fan"), [(5, 3), (64, 512)])
def test_running_sums(points, size, fan, monkeypatch):
    monkeypatch.setattr(scan.before_spans, "__defaults__", (fan,))
    w = Window.partitionBy("track_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    number = F.col("x").cast("decimal(20,6)")
    got = scan.with_running(points, "track_id", {"n": F.lit(1), "s": number}, size=size).select("track_id", "frame", "n", F.col("s").cast("decimal(30,6)"))
    want = points.select("track_id", "frame", F.count(F.lit(1)).over(w), F.sum(number).over(w).cast("decimal(30,6)"))
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("alpha", [0.72, 0.5])
def test_smoothing_is_an_affine_scan(points, alpha):
    want, state = [], {}
    for r in points.orderBy("track_id", "frame").collect():
        s = state.get(r.track_id)
        fresh = s is None or r.frame - s[0] > 4 or ((r.x - s[1]) ** 2 + (r.y - s[2]) ** 2) ** 0.5 > 230.4
        session = 1 if s is None else s[5] + fresh
        sx, sy = (r.x, r.y) if fresh else (alpha * r.x + (1 - alpha) * s[3], alpha * r.y + (1 - alpha) * s[4])
        state[r.track_id] = (r.frame, r.x, r.y, sx, sy, session)
        want.append((r.track_id, r.frame, session, round(sx, 6), round(sy, 6)))
    for size in (8, 4096):
        got = sorted(map(tuple, tracks.smoothed(points, alpha=alpha, size=size).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
        assert all(abs(g[i] - w[i]) < 2e-6 for g, w in zip(got, sorted(want), strict=True) for i in (3, 4))


@pytest.mark.parametrize(("size", "span"), [(3, 16), (40, 16), (40, 4096)])
def test_best_window(points, size, span):
    w = Window.partitionBy("track_id").orderBy("frame").rowsBetween(0, size - 1)
    full = points.select("track_id", "frame", F.round(F.avg("v").over(w), 6).alias("mean"), F.count(F.lit(1)).over(w).alias("n")).filter(F.col("n") == size)
    want = full.groupBy("track_id").agg(F.max(F.struct("mean", (-F.col("frame")).alias("o"))).alias("b")).select("track_id", -F.col("b.o"), "b.mean")
    assert rows_of(tracks.best_window(points, size, "track_id", "frame", "v", span)) == rows_of(want)


def test_halos_across_spans(points, monkeypatch):
    frames = points.select(F.col("track_id").alias("clip_id"), "frame")
    wide = [rows_of(tracks.triplets(frames)), rows_of(tracks.histories(frames, 5)), rows_of(tracks.trails(points, 12))]
    monkeypatch.setattr(scan.with_halo, "__defaults__", (0, 0, "frame", 16))
    monkeypatch.setattr(tracks, "SIZE", 16)
    narrow = [rows_of(tracks.triplets(frames)), rows_of(tracks.histories(frames, 5)), rows_of(tracks.trails(points, 12))]
    assert wide == narrow
    w = Window.partitionBy("clip_id").orderBy("frame")
    plain = frames.select("clip_id", "frame", F.coalesce(F.lag("frame").over(w) == F.col("frame") - 1, F.lit(False)), F.coalesce(F.lead("frame").over(w) == F.col("frame") + 1, F.lit(False)))
    assert rows_of(tracks.triplets(frames).drop("triplet")) == rows_of(plain)


def test_no_window_over_a_whole_track(points):
    frames = points.select(F.col("track_id").alias("clip_id"), "frame", "x", "y")
    cuts = frames.where("frame % 500 = 0").select("clip_id", "frame")
    for df in (tracks.with_kinematics(points), tracks.smoothed(points), tracks.best_window(points, 9, "track_id", "frame", "x"), tracks.trails(points), tracks.histories(frames), tracks.triplets(frames), tracks.links(frames, cuts=cuts), tracks.summaries(points.selectExpr("*", "x as score", "x as error", "x as acceleration"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
        assert windows and all("__span" in w for w in windows)


def test_one_track_of_a_million_points(spark):
    one = spark.range(1_000_000, numPartitions=4).select(F.lit(1).alias("track_id"), F.col("id").alias("frame"), (F.col("id") % 977).cast("double").alias("x"), F.lit(0.0).alias("y"))
    spread = scan.with_span(one).repartition(64, "track_id", scan.SPAN).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 32 and max(r["count"] for r in spread) < 100_000
    total = tracks.with_kinematics(one).agg(F.count("step"), F.count("acceleration"), F.sum("step")).first()
    assert tuple(total) == (999_999, 999_998, 999_999 - 1023 + 1023 * 976.0)


def test_links_count_cuts_by_span(points):
    frames = points.where("track_id = 'a'").select(F.col("track_id").alias("clip_id"), "frame", "x", "y")
    cuts = frames.where("frame % 50 = 0").select("clip_id", "frame")
    at = sorted(r.frame for r in cuts.collect())
    found = tracks.links(frames, max_jump=1e9, cuts=cuts).select("a_frame", "b_frame").collect()
    every = tracks.links(frames, max_jump=1e9).select("a_frame", "b_frame").collect()
    assert {tuple(r) for r in found} == {(a, b) for a, b in every if not any(a < c <= b for c in at)}
