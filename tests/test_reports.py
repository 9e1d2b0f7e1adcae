"""Reports with required keys, summaries, validated tables of a tracking job, neighbours by span, exact outlines."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rallyframe.functions import scores
from rallyframe.operators import jobs, pixels, reports, scan, tracklets


def test_documents(spark):
    texts = [None, "", "x", "[]", "3", "{}", '{"a": 1, "b": {}}', '{"a": null, "b": {"c": 1}}', '{"b": [1]}', '{"a": 1, "b": null}', '{"a": 1, "a": 2, "b": {}}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("d", reports.document(F.col("t")))
    got = rows.select("i", reports.document_problem(F.col("d"), ("a", "b"), ("b",)).alias("p"), F.to_json(reports.descriptor(F.col("d"), ("a", "b"), ("b",))).alias("j")).orderBy("i").collect()
    no = "not an object"
    assert [r.p for r in got] == [no, no, no, no, no, "missing: a, b", None, None, "missing: a", "not an object: b", no]
    assert got[6].j == '{"a":1,"b":{}}' and got[7].j == '{"a":null,"b":{"c":1}}' and got[8].j is None


def test_candidate_summaries_against_plain_counts(spark):
    rng = random.Random(1)
    rows = [(c, f, round(rng.random(), 6)) for c in ("a", "b") for f in range(9) for _ in range(rng.randrange(4))]
    clips = spark.createDataFrame([("a", 9), ("b", 12), ("empty", 5), ("none", 0)], "clip_id string, analyzed long")
    got = {r.clip_id: r.summary for r in reports.candidate_summaries(clips, spark.createDataFrame(rows, "clip_id string, frame long, score double")).collect()}
    for clip, n in (("a", 9), ("b", 12), ("empty", 5), ("none", 0)):
        own = [[s for c, g, s in rows if (c, g) == (clip, f)] for f in range(n)]
        counts, scored = [len(x) for x in own], [s for x in own for s in x]
        s = got[clip]
        assert (s.analyzed_frames, s.frames_with_candidates, s.total_candidates, s.max_candidates_per_frame) == (n, sum(k > 0 for k in counts), sum(counts), max(counts, default=0))
        assert s.median_candidates_per_frame == (statistics.median(counts) if counts else 0) and abs(s.mean_candidates_per_frame - (statistics.mean(counts) if counts else 0)) < 6e-4
        assert abs(s.mean_candidate_score - (statistics.mean(scored) if scored else 0)) < 2e-6 and s.max_candidate_score == max(scored, default=0)


def test_analyses_name_what_is_absent(spark):
    runs = spark.createDataFrame([(i, 7 if i < 3 else 8, "p", "v.mp4", 1.0, 2.0) for i in range(4)], "run_id long, video_id long, pipeline string, video_filename string, clip_start_s double, clip_duration_s double").withColumn("generated_at", F.lit("2024-01-02 03:04:05.678").cast("timestamp"))
    videos = spark.createDataFrame([(7, 50.0, 640)], "video_id long, fps double, width int")
    clips = reports.clip_report(runs, spark.createDataFrame([(0, 2097152, 25.0), (1, 1, None), (3, 1, 25.0)], "run_id long, size_bytes long, fps double"))
    summary = lambda ids: spark.createDataFrame([(i, (i,)) for i in ids], "run_id long, summary struct<n: long>")
    tracking = spark.createDataFrame([(i, ("s",)) for i in (0, 1, 3)], "run_id long, descriptor struct<scorer_id: string>")
    got = {r.run_id: r for r in reports.analyses(runs, videos, clips, summary([0, 3]), summary([0, 1, 3]), tracking).collect()}
    assert [got[i].problem for i in range(4)] == [None, "absent: candidates", "absent: clip, candidates, tracks, tracking", None]
    assert got[1].report is None and got[0].report.generated_at == "2024-01-02T03:04:05" and got[0].report.source.resolution.width == 640 and got[0].report.source.resolution.height is None
    assert got[0].report.clip.fps == 25.0 and got[0].report.candidates.n == 0 and got[3].report.source.fps is None
    assert clips.filter("run_id = 0").first().clip.size_mb == 2.0
    empty = reports.analyses(runs.limit(0), videos, clips, summary([0]), summary([0]), tracking)
    assert empty.count() == 0
    with pytest.raises(ValueError, match="fields missing: policy"):
        reports.compact(runs)


def disc(frames: int, height: int = 40, width: int = 60):
    yy, xx = np.mgrid[0:height, 0:width]
    return [np.where((xx - 8 - 3 * f) ** 2 + (yy - 20) ** 2 <= 9, 230, 10).ravel().astype(int).tolist() for f in range(frames)]


def test_tracking_job_writes_checks_and_reports(spark, tmp_path):
    frames = [("a/b", f, g) for f, g in enumerate(disc(14))] + [("still", f, [10] * 2400) for f in range(4)] + [("one", 0, [10] * 2400)]
    table = spark.createDataFrame(frames, "clip_id string, frame long, gray array<int>")
    folder = f"file://{tmp_path}/run"
    job = jobs.TrackingJob(40, 60, scores.ComponentLimits(blur=1), scorer_id=" mine ")
    got = {r.clip_id: r.result for r in job.run(table, folder).collect()}
    assert set(got) == {"a/b", "still", "one"}
    moving, still = got["a/b"], got["still"]
    assert (moving.scorer_id, moving.status, moving.configuration.candidates.blur, moving.artifacts.tracks) == ("mine", "completed", 1, "tracks")
    assert moving.metrics.candidates.analyzed_frames == 12 and moving.metrics.candidates.frames_with_candidates == 12 and moving.metrics.tracks.selected_tracks >= 1
    assert still.metrics.candidates.total_candidates == 0 and still.metrics.tracks.selected_tracks == 0 and got["one"].metrics.candidates.analyzed_frames == 0
    kept = jobs.Artifacts(folder)
    assert kept.problems(spark) == []
    metrics = kept.read(spark, "track_metrics").collect()
    assert {r.clip_id for r in metrics} == {"a/b"} and metrics[0].point_count == moving.metrics.tracks.longest_track_points
    # A table that lost rows, one of another type, one that is gone.
    other = jobs.Artifacts(f"file://{tmp_path}/other")
    for name in jobs.ARTIFACTS:
        rows = kept.read(spark, name)
        rows = rows.filter("rank > 1 or frame > 5") if name == "candidates" else rows
        rows.write.parquet(other.path(name))
    assert [p.split(" (")[0] for p in other.problems(spark)] == ["candidate_metrics: other count", "tracks: unknown candidate"]
    kept.read(spark, "tracks").withColumn("x", F.col("x").cast("string")).write.mode("overwrite").parquet(other.path("tracks"))
    assert other.problems(spark) == ["tracks: x is string"]
    assert jobs.Artifacts(f"file://{tmp_path}/nowhere").problems(spark) == [f"{n}: absent" for n in jobs.ARTIFACTS]


def test_tracking_job_settings(spark):
    for bad in ("", "  ", None):
        with pytest.raises(TypeError):
            jobs.TrackingJob(4, 4, scorer_id=bad)
    with pytest.raises(ValueError):
        jobs.TrackingJob(0, 4)
    table = spark.createDataFrame([("c", f, g) for f, g in enumerate(disc(5))], "clip_id string, frame long, gray array<int>")
    own = jobs.found_candidates(table, 40, 60, scores.ComponentLimits(blur=1), scorer=lambda rows: -rows["x"])
    ranks = own.filter("frame = 2").orderBy("rank").collect()
    assert [r.score for r in ranks] == sorted((-r.x for r in ranks), reverse=True)


@pytest.mark.parametrize("size", [1, 3, 50])
def test_neighbours_equal_lag_and_lead(spark, size):
    rng = random.Random(size)
    wanted, rows = set(), []
    for key in ("a", None, "b"):
        at = sorted(rng.sample(range(-40, 200), 30))
        rows += [(key, f, [f]) for f in at]
        wanted |= {(key, f, b, a) for f, b, a in zip(at, [None, *at], [*at[1:], None], strict=False)}
    table = spark.createDataFrame(rows, "k string, frame long, v array<long>")
    got = scan.with_neighbours(table, "k", "v", size=size).select("k", "frame", F.get("__before", 0), F.get("__after", 0))
    assert {tuple(r) for r in got.collect()} == wanted and got.count() == len(wanted)
    assert scan.with_neighbours(table.limit(0), "k", "v", size=size).count() == 0


def test_no_window_holds_a_clip(spark):
    table = spark.createDataFrame([("c", f, [f]) for f in range(5)], "clip_id string, frame long, gray array<int>")
    plan = pixels.triples(table)._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "Window" in line and "gray" in line]
    assert wide and all("__span" in line.split("], [")[1] for line in wide)


@pytest.mark.parametrize(
    "shape, area, perimeter",
    [
        ([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)], 4, 8),
        ([(0, 1), (1, 0), (1, 1), (1, 2), (2, 1)], 2, 4 * 2**0.5),
        ([(0, 0), (0, 1), (0, 2), (0, 3)], 0, 6),
        ([(0, 0), (1, 0), (1, 1)], 0.5, 2 + 2**0.5),
        ([(y, x) for y in range(5) for x in range(7) if y in (0, 4) or x in (0, 6)], 24, 20),  # a hole doesn't count
        ([(0, 0), (1, 1), (0, 2)], 0, 4 * 2**0.5),
        ([(0, 0), (1, 1), (2, 2), (1, 0), (2, 0), (2, 1)], 2, 4 + 2 * 2**0.5),
    ],
)
def test_outlines_by_hand(shape, area, perimeter):
    mask = np.zeros((8, 9), bool)
    for y, x in shape:
        mask[y + 1, x + 1] = True
    for m in (mask, mask[:, ::-1], mask.T):
        assert pixels.circularity(m) == pytest.approx(min(1.0, 4 * np.pi * area / perimeter**2), abs=1e-6)


@pytest.mark.parametrize("pairs", [1, 40])
def test_beams_do_not_depend_on_how_pairs_are_cut(monkeypatch, pairs):
    rng = np.random.default_rng(3)
    n = 240
    rows = pd.DataFrame({"candidate_id": [f"c{i:03d}" for i in range(n)], "frame": np.sort(rng.integers(0, 40, n)), "rank": 1, "segment": 0, "score": rng.integers(0, 9, n) / 10.0})
    rows = rows.assign(x=rng.integers(0, 60, n).astype(float), y=rng.integers(0, 60, n).astype(float), area=10.0, bright=rng.integers(0, 3, n).astype(float), size=3.0)
    frames, seeds = tracklets._Frames(rows), np.arange(0, 60, 4)
    grown = lambda: {(s, k): (p.rows, p.errors) for s, k, p in tracklets._grow(frames, seeds, tracklets.TrackConfig())}
    whole = grown()
    monkeypatch.setattr(tracklets, "PAIRS", pairs)
    assert len(whole) > len(seeds) and grown() == whole
    assert list(tracklets._grow(frames, np.zeros(0, np.int64), tracklets.TrackConfig())) == []
