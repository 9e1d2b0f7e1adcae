"""Literal examples, independent plain versions and invariance under repartitioning."""

import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.functions import scalars, scores
from rallyframe.operators import evaluation, jobs, pixels, ranking, ranks, records, sampling, scene, tracklets, tracks
from rallyframe.sources import files
from rallyframe.streaming import sessions

RNG = random.Random(3)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_scores(spark):
    full = scores.heuristic_score(*[F.lit(v) for v in (100.0, 255.0, 0.7, 1.0, 28)])
    assert one(spark, full).c0 == pytest.approx(1.0)
    assert one(spark, scores.turn_degrees(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)), scores.turn_degrees(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))) == (pytest.approx(90.0), 0.0)
    look = scores.appearance_penalty(F.lit(10.0), F.lit(20.0), F.lit(0.0), F.lit(50.0), F.lit(5.0), F.lit(10.0))
    assert one(spark, look).c0 == pytest.approx(math.log(2) * 1.5)
    assert one(spark, scores.component_fits(F.lit(20), F.lit(5), F.lit(5)), scores.component_fits(F.lit(20), F.lit(27), F.lit(1)), scores.component_fits(F.lit(1), F.lit(1), F.lit(1))) == (True, False, False)
    with pytest.raises(ValueError):
        scores.ComponentLimits(blur=2)


def test_casts(spark):
    texts = ["1.5", " 2 ", "", "nan", "inf", "x", None, "3.0", "3.4", "1,5"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = rows.select(scalars.to_double(F.col("t")).alias("d"), scalars.to_int_exact(F.col("t")).alias("n"), scalars.to_int_truncated(F.col("t")).alias("k"), scalars.to_double_comma(F.col("t")).alias("c")).collect()
    assert [r.d for r in got] == [1.5, 2.0, None, None, None, None, None, 3.0, 3.4, None]
    assert [r.n for r in got] == [None, 2, None, None, None, None, None, 3, None, None]
    assert [r.k for r in got] == [1, 2, 0, 0, 0, 0, 0, 3, 3, 0] and got[9].c == 1.5
    assert one(spark, F.round(scalars.rate(F.lit("30000/1001")), 2), scalars.rate(F.lit("0/0")), scalars.rate(F.lit("N/A")), scalars.rate(F.lit("25"))) == (29.97, None, None, 25.0)
    assert one(spark, scalars.ratio(F.lit(1), F.lit(0)), scalars.f_beta(F.lit(0.0), F.lit(0.0)), scalars.f_beta(F.lit(0.5), F.lit(1.0)), scalars.f_beta(F.lit(None).cast("double"), F.lit(1.0))) == (0.0, 0.0, pytest.approx(2 / 3), None)
    assert one(spark, scalars.fixed(F.lit(1.5)), scalars.fixed(F.lit(2.0)), scalars.fixed(F.lit(None))) == ("1.5", "2", "")


def test_names(spark):
    assert one(spark, scalars.slug(F.lit("Match Démo_01 !")), scalars.slug(F.lit("***")), scalars.slug(F.lit(None).cast("string"))) == ("match-demo-01", "run", "run")
    assert one(spark, *[scalars.nominal_rate(F.lit(v).cast("double")) for v in (29.97, 24.5, None, 90.0, 59.0)]) == ("30", "24", "unknown", "other", "60")
    assert one(spark, scalars.wall_time(F.lit("2026-01-02T03:04:05+02:00")), scalars.wall_time(F.lit("soon"))) == ("02/01/2026 03:04:05", "soon")
    import hashlib

    assert one(spark, scalars.stable_id(F.lit("Data\\A.MP4"))).c0 == hashlib.sha1(b"data/a.mp4").hexdigest()[:16]
    assert one(spark, *[scalars.is_hit(F.lit(v).cast("double")) for v in (19.999, 20.0, 20.001, None)]) == (True, True, False, False)
    assert one(spark, scalars.inside(F.lit(0), F.lit(0), 10, 10), scalars.strictly_inside(F.lit(0), F.lit(1), 10, 10), scalars.inside(F.lit(None).cast("int"), F.lit(1), 10, 10)) == (True, False, None)
    assert one(spark, scalars.same_value(F.lit(1.0), F.lit(1.0 + 1e-10)), scalars.same_value(F.lit(None).cast("double"), F.lit(None).cast("double")), scalars.same_value(F.lit(1.0), F.lit(None).cast("double"))) == (True, True, False)


TRUTH = [("c", 0, True, 100.0, 100.0), ("c", 1, True, 50.0, 50.0), ("c", 2, False, None, None), ("c", 3, True, 10.0, 10.0)]
CANDS = [("c", 0, 1, 119.0, 100.0, "a", 0.9), ("c", 0, 2, 101.0, 100.0, "b", 0.8), ("c", 1, 1, 90.0, 50.0, "d", 0.7), ("c", 2, 1, 5.0, 5.0, "e", 0.6)]


def test_labels_and_outcomes(spark):
    truth = spark.createDataFrame(TRUTH, "clip_id string, frame long, visible boolean, gt_x double, gt_y double")
    cands = spark.createDataFrame(CANDS, "clip_id string, frame long, rank long, x double, y double, candidate_id string, score double").repartition(3)
    rows = ranking.nearest_labelled(ranking.with_distance(cands, truth)).withColumn("hard_negative", F.col("candidate_id") == "e")
    assert {r.candidate_id: r.label for r in rows.collect()} == {"a": "ignore", "b": "ball", "d": "not_ball", "e": "not_ball"}
    out = {r.frame: r for r in ranking.frame_outcomes(truth, rows).collect()}
    assert out[0].baseline_hit and out[0].baseline_ignore_hit and not out[0].baseline_strict_hit and out[0].oracle_covered
    assert out[1].visible_candidates_without_ball and out[3].visible_without_candidates and out[2].baseline_hard_negative and not out[2].oracle_covered
    total = {r.clip_id: r for r in ranking.summarized(ranking.frame_outcomes(truth, rows)).collect()}
    assert total["all"].visible == 3 and total["all"].oracle_recall == pytest.approx(0.333333333)
    curve = {(r.radius, r.k): r.hits for r in ranking.recall_at(rows, truth, [1, 2], [5.0, 20.0]).collect()}
    assert curve == {(5.0, 1): 0, (5.0, 2): 1, (20.0, 1): 1, (20.0, 2): 1}
    kinds = rows.select(ranking.category(F.col("label"), F.col("hard_negative"), F.col("visible"), F.lit(True)).alias("k")).collect()
    assert sorted(r.k for r in kinds) == ["hard_negative", "ignore", "positive", "same_frame"]
    with pytest.raises(Exception, match="unknown label"):
        one(spark, ranking.category(F.lit("?"), F.lit(False), F.lit(True), F.lit(True)))


def test_policies(spark):
    schema = "visible boolean, global_x double, global_y double, global_conf double, refined_x double, refined_y double, local_conf double, global_error double, refined_error double, fps_nominal string, match_id long"
    rows = [(True, 0.0, 0.0, 0.25, 1280.0, 5.0, 0.3, 3.0, 1.0, "50", 1), (True, -1.0, 5.0, 0.2, 5.0, 5.0, 0.25, 30.0, 2.0, "50", 1), (False, 5.0, 5.0, 0.1, 5.0, 5.0, 0.0, None, None, "120", 2), (True, None, None, None, None, None, None, None, None, "120", 2)]
    pred = spark.createDataFrame(rows, schema)
    chosen = lambda p, g, v: [r.s for r in pred.select(evaluation.policy_choice(F.lit(p), F.lit(g), F.lit(v)).alias("s")).collect()]
    assert chosen("global_only", 0.1, 0.0) == ["global", None, "global", None]
    assert chosen("refined_only", 0.1, 0.25) == [None, "refined", None, None]
    assert chosen("refined_then_global", 0.1, 0.25) == ["global", "refined", "global", None]
    assert [r.v for r in pred.select(evaluation.strict_refined_valid(0.1, 0.25).alias("v")).collect()] == [False, False, False, False]
    sweep = evaluation.threshold_sweep(pred)
    assert sweep.count() == 363
    plain = sweep.filter("policy = 'refined_then_global' and global_threshold = 0.1 and local_threshold = 0.25").first()
    assert (plain.predicted, plain.hits, plain.false_positives, plain.from_refined) == (3, 2, 1, 1)
    assert evaluation.best_of(sweep).count() == 3
    whole = evaluation.grouped_stage_metrics(pred, 0.1, 0.25).filter("grouping = 'all' and stage = 'global'").first()
    assert (whole.frames, whole.visible_frames, whole.valid_frames, whole.valid_hits, whole.raw_hits) == (4, 3, 2, 1, 1)


def test_sampling_examples(spark):
    rows = spark.createDataFrame([("c", f, r, f"f{f}r{r}") for f in (0, 1) for r in (2, 1, 3)], "clip_id string, frame long, rank long, candidate_id string").repartition(4)
    keys = rows.select("clip_id", "frame").filter("frame = 0").distinct()
    assert sorted(r.rank for r in sampling.lowest_per_frame(rows, keys, 2).collect()) == [1, 2]
    with pytest.raises(Exception, match="too few"):
        sampling.lowest_per_frame(rows, keys, 4).collect()
    assert [(r.frame, r.rank) for r in sampling.round_robin(rows, 3).collect()] == [(0, 1), (1, 1), (0, 2)]
    for n, k in ((10, 4), (7, 7), (5, 1), (3, 9), (100, 7)):
        down, near = one(spark, sampling.even_indices(F.lit(n), k), sampling.even_indices(F.lit(n), k, True))
        assert down == ([*range(n)] if k >= n else [n // 2] if k == 1 else [i * (n - 1) // (k - 1) for i in range(k)])
        assert near == ([*range(n)] if k >= n else [n // 2] if k == 1 else [round(i * (n - 1) / (k - 1)) for i in range(k)])
    numbers = sampling.numbered(rows.withColumn("part", F.col("frame")), ("part", "rank"), "n", ("part",)).orderBy("n").collect()
    assert [(r.frame, r.rank, r.n) for r in numbers] == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 1, 3), (1, 2, 4), (1, 3, 5)]
    flags = spark.createDataFrame([(i, i < 3) for i in range(43)], "i long, rare boolean")
    assert sampling.oversampled(flags, "rare", 0.25, ("i",)).filter("rare").count() == 10


def test_fold_plan(spark):
    rows = []
    for clip in ("a", "b", "h"):
        rows += [(clip, 1, 1, f"{clip}p", "positive"), (clip, 9, 1, f"{clip}h", "hard_negative"), (clip, 7, 1, f"{clip}g", "ignore")]
        rows += [(clip, 1, 1 + r, f"{clip}s{r}", "same_frame") for r in range(1, 7)] + [(clip, 2 + f, 1, f"{clip}m{f}", "visible_missing") for f in range(4)] + [(clip, 20 + f, 1, f"{clip}i{f}", "invisible") for f in range(4)]
    frame = spark.createDataFrame(rows, "clip_id string, frame long, rank long, candidate_id string, category string")
    plan = sampling.fold_plan(frame, ["h"]).orderBy("sample_order").collect()
    assert [r.sample_order for r in plan] == list(range(len(plan))) and all(r.clip_id != "h" and r.category != "ignore" for r in plan)
    from collections import Counter

    assert Counter(r.category for r in plan) == {"positive": 2, "hard_negative": 2, "same_frame": 8, "visible_missing": 4, "invisible": 2}
    again = sampling.fold_plan(frame.repartition(7).orderBy(F.rand(1)), ["h"]).orderBy("sample_order").collect()
    assert [r.candidate_id for r in again] == [r.candidate_id for r in plan]


def test_track_features(spark):
    points = spark.createDataFrame([(1, f, float(10 * f), 0.0) for f in range(5)] + [(2, 3, 1.0, 1.0)], "track_id long, frame long, x double, y double")
    out = {r.track_id: r for r in tracks.features(points).collect()}
    assert out[1].median_speed == 10 and out[1].straightness == 1 and out[1].speed_mad == 0 and out[1].turns_over_45 == 0
    assert out[2].median_speed == 0 and out[2].coverage_ratio == 1


def test_links_do_not_cross_cuts(spark):
    rows = spark.createDataFrame([("c", f, f"p{f}", float(3 * f), float(f)) for f in range(8)], "clip_id string, frame long, candidate_id string, x double, y double")
    cuts = spark.createDataFrame([("c", 4)], "clip_id string, frame long")
    got = {(r.a_frame, r.b_frame) for r in tracks.links(rows, cuts=cuts).collect()}
    assert got == {(a, b) for a in range(8) for b in range(a + 1, min(8, a + 4)) if not a < 4 <= b}


def test_smoothing_equals_the_stream_rule(spark, tmp_path):
    rows = []
    for t in (1, 2):
        frame, x, y = 0, 100.0, 100.0
        for _ in range(150):
            frame += RNG.choice([1, 1, 1, 2, 7])
            x, y = x + RNG.uniform(-40, 40) + RNG.choice([0, 0, 0, 0, 400]), y + RNG.uniform(-40, 40)
            rows.append((t, frame, x, y))
    schema = "track_id long, frame long, x double, y double"
    points = spark.createDataFrame(rows, schema)
    wanted, last = {}, {}
    for t, f, x, y in rows:
        p = last.get(t)
        fresh = p is None or f - p[0] > 4 or math.hypot(x - p[1], y - p[2]) > 230.4
        s = (x, y) if fresh else (0.72 * x + 0.28 * p[3], 0.72 * y + 0.28 * p[4])
        n = 1 if p is None else p[5] + fresh
        last[t] = (f, x, y, *s, n)
        wanted[(t, f)] = (n, *s)
    check = lambda out: all((r.session, r.smooth_x, r.smooth_y) == (wanted[(r.track_id, r.frame)][0], pytest.approx(wanted[(r.track_id, r.frame)][1], abs=2e-6), pytest.approx(wanted[(r.track_id, r.frame)][2], abs=2e-6)) for r in out)
    out = tracks.smoothed(points.repartition(5)).collect()
    assert len(out) == len(rows) and check(out)
    points.orderBy("frame").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    job = sessions.live_sessions(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    job.awaitTermination(120)
    live = spark.table("live").collect()
    assert len(live) == len(rows) and check(live)


def test_windowed_counts_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"2026-01-01 00:{m:02d}:00", "view", 1.5) for m in range(20)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    batch = {(r.window_start, r.n, r.total) for r in sessions.windowed_counts(rows).collect()}
    stream = sessions.windowed_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.window_start, r.n, r.total) for r in spark.table("counts").collect()} == batch and len(batch) == 4


def test_islands_and_windows(spark):
    flags = [True, True, False, True, True, True, False, False]
    rows = spark.createDataFrame([("c", i, f, float(i % 4)) for i, f in enumerate(flags)], "k string, i long, f boolean, v double")
    r = tracks.islands(rows, "k", "i", "f").first()
    assert (r.longest_true, r.longest_false) == (3, 2)
    best = tracks.best_window(rows, 2, "k", "i", "v").first()
    assert (best.start, best.best_mean) == (2, 2.5)


def moving(n=14, noise=3):
    rows = []
    for f in range(n):
        rows.append(("c", f, 1, f"ball{f}", 10.0 + 3 * f, 20.0 + f, 0.8, 20.0, 220.0, 5.0))
        rows += [("c", f, 2 + j, f"n{f}_{j}", RNG.uniform(0, 300), RNG.uniform(0, 200), RNG.uniform(0.1, 0.5), 20.0, 100.0, 5.0) for j in range(noise)]
    return rows


CANDIDATE = "clip_id string, frame long, rank long, candidate_id string, x double, y double, score double, area double, bright double, size double"


def plain_paths(rows, c):
    """An unvectorised search over dictionaries, for comparison."""
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], -r[6])):
        by.setdefault(r[1], []).append(r)
    found = []
    for f in sorted(by):
        for place, seed in enumerate(by[f][: c.seeds_per_frame] if f % c.seed_stride == 0 else []):
            beam, number = [([seed], 1.2 * seed[6])], 0
            while beam:
                grown = []
                for path, worth in beam:
                    nxt = []
                    if path[-1][1] - path[0][1] + 1 < c.max_span_frames:
                        for dt in range(1, c.max_gap_frames + 2):
                            if path[-1][1] + dt - path[0][1] + 1 > c.max_span_frames:
                                continue
                            for q in by.get(path[-1][1] + dt, []):
                                p = path[-1]
                                jump = math.hypot(q[4] - p[4], q[5] - p[5])
                                if jump / dt > c.max_jump_per_frame:
                                    continue
                                err = acc = 0.0
                                if len(path) > 1:
                                    o = path[-2]
                                    vx, vy = (p[4] - o[4]) / (p[1] - o[1]), (p[5] - o[5]) / (p[1] - o[1])
                                    err = math.hypot(q[4] - p[4] - vx * dt, q[5] - p[5] - vy * dt)
                                    ux, uy = (q[4] - p[4]) / dt, (q[5] - p[5]) / dt
                                    acc = math.hypot(ux - vx, uy - vy)
                                    a, b = math.hypot(vx, vy), math.hypot(ux, uy)
                                    turn = 0.0 if min(a, b) < 1e-6 else math.degrees(math.acos(max(-1, min(1, (vx * ux + vy * uy) / (a * b)))))
                                    if err > c.prediction_error_limit + 4 * (dt - 1) or acc > c.max_acceleration or turn > c.max_turn_degrees:
                                        continue
                                gain = 1.65 * q[6] - 0.035 * err - 0.022 * acc - 0.01 * jump - 0.24 * abs(q[8] - p[8]) / 255 - 0.1 * (dt - 1)
                                nxt.append((gain, q[6], q))
                    if not nxt:
                        if len(path) >= c.min_points:
                            found.append((f, place, number, [q[3] for q in path]))
                        number += 1
                    for gain, _, q in sorted(nxt, key=lambda e: (-e[0], -e[1]))[: c.branch_factor]:
                        grown.append(([*path, q], worth + gain))
                span = lambda p: p[-1][1] - p[0][1] + 1
                beam = sorted(grown, key=lambda g: (g[1] + 0.16 * len(g[0]) + 0.25 * len(g[0]) / span(g[0]), len(g[0])), reverse=True)[: c.beam_width]
    return found


def test_tracklets(spark):
    rows = moving()
    frame = spark.createDataFrame(rows, CANDIDATE)
    config = tracklets.TrackConfig()
    got = tracklets.hypotheses(frame.repartition(6), config).collect()
    wanted = plain_paths(rows, config)
    assert sorted((r.seed_frame, r.seed_rank, r.path, tuple(r.candidate_ids)) for r in got) == sorted((f, p, n, tuple(ids)) for f, p, n, ids in wanted)
    best = tracklets.selected(tracklets.hypotheses(frame, config), config).orderBy("track_rank").collect()
    assert best[0].candidate_ids == [f"ball{f}" for f in range(14)]
    for i, a in enumerate(best):
        for b in best[:i]:
            shared = set(a.candidate_ids) & set(b.candidate_ids)
            assert len(shared) / min(len(a.candidate_ids), len(b.candidate_ids)) < config.overlap
    points = tracklets.track_points(tracklets.selected(tracklets.hypotheses(frame, config), config)).filter("track_id = 'T001'").orderBy("point_index").collect()
    assert [p.point_index for p in points] == list(range(1, 15)) and points[0].prediction_error == 0


def test_tracklets_over_blocks_and_cuts(spark):
    rows = moving(100, 0)
    frame = spark.createDataFrame(rows, CANDIDATE)
    config = tracklets.TrackConfig(max_span_frames=20)
    got = tracklets.hypotheses(frame, config, block=10).collect()
    assert sorted(tuple(r.candidate_ids) for r in got) == sorted(tuple(ids) for *_, ids in plain_paths(rows, config))
    cut = frame.withColumn("segment", F.when(F.col("frame") >= 50, 1).otherwise(0))
    assert all(not (r.frames[0] < 50 <= r.frames[-1]) for r in tracklets.hypotheses(cut, config).collect())
    with pytest.raises(ValueError):
        tracklets.TrackConfig(min_points=1)


def disc(x, height=100, width=120):
    ys, xs = np.mgrid[:height, :width]
    return np.where((xs - x) ** 2 + (ys - 50) ** 2 <= 9, 255, 0).astype(int).ravel().tolist()


def test_moving_disc(spark):
    frames = spark.createDataFrame([("c", i, disc(x)) for i, x in enumerate((20, 60, 100))], "clip_id string, frame long, gray array<int>")
    limits = scores.ComponentLimits(motion_threshold=10, min_area=1, max_area=100, max_dimension=20, min_fill=0.05, per_frame=10, blur=1)
    out = pixels.detected(frames, 100, 120, limits).collect()
    assert len(out) == 1 and abs(out[0].x - 60) <= 1 and abs(out[0].y - 50) <= 1 and out[0].area >= 20 and out[0].frame == 1 and out[0].candidate_id == "f000001_c01"
    assert out[0].score == pytest.approx(0.926, abs=0.02)
    with pytest.raises(ValueError):
        pixels.components(np.zeros((2, 2)), np.zeros((2, 3)), np.zeros((2, 2)), scores.ComponentLimits())


def test_crops(spark):
    image = np.zeros((3, 3, 3), np.uint8)
    image[0, 0] = (1, 2, 3)
    crop = pixels.cropped(image, 0.0, 0.0, 4)
    assert crop.shape == (4, 4, 3) and crop[2, 2].tolist() == [3, 2, 1] and crop.sum() == 6
    box = pixels.crop_box(F.lit(10.49), F.lit(10.5), F.lit(4).cast("bigint"), 1280, 720)
    assert one(spark, box["crop_x"], box["crop_y"]) == (8, 9)
    label, n = pixels.labelled(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 0, 0]], bool))
    assert n == 2 and label[3, 0] == 2
    assert len(files.packed_crop([np.zeros((48, 48, 3), np.uint8)] * 3)) == 3 * 48 * 48 * 3


def test_scene(spark):
    def quad(*points):
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])

    problem = lambda *p: one(spark, scene.quad_problem(quad(*p), 100, 100)).c0
    assert problem((0, 0), (10, 0), (10, 10), (0, 10)) is None
    assert problem((0, 0), (10, 10), (10, 0), (0, 10)) == "crossed"
    assert problem((0, 0), (10, 0), (20, 0), (0, 10)) == "collinear"
    assert problem((0, 0), (101, 0), (10, 10), (0, 10)) == "out_of_bounds"
    assert problem((0, 0), (10, 0), (0, 0), (0, 10)) == "repeated_corner"
    assert problem((0, 0), (float("nan"), 0), (10, 10), (0, 10)) == "not_finite"
    assert problem((0, 0), (10, 0), (10, 10)) == "not_four_corners"
    check = lambda v, g, r, c=0.5, u=0.0: one(spark, scene.observation_problem(F.lit(v), F.lit(g), F.lit(r).cast("string"), F.lit(c), F.lit(u))).c0
    assert (check(True, "g", None), check(True, None, None), check(False, None, " "), check(False, None, "blur"), check(True, "g", None, 1.5)) == (None, "geometry_missing", "reason_missing", None, "confidence")


def test_files(spark, tmp_path):
    (tmp_path / "v" / "runs").mkdir(parents=True)
    for name in ("b.MP4", "A.mov", "note.txt", "runs/old.mp4"):
        (tmp_path / "v" / name).write_bytes(b"x" * 10)
    listed = files.listed_videos(spark, str(tmp_path / "v")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in listed] == ["A.mov", "b.MP4"]
    probed = files.probed_videos(files.listed_videos(spark, str(tmp_path / "v")).select("id", "path"), lambda p: {"width": 640, "avg_rate": "0/0", "rate": "30000/1001", "duration_s": 2.0} if p.endswith("MP4") else 1 / 0).orderBy("path").collect()
    assert probed[1].frame_count == 60 and abs(probed[1].fps - 29.97003) < 1e-5 and probed[0].fps is None
    assert probed[1].width == 640 and probed[0].probe_error.startswith("ZeroDivisionError")
    (tmp_path / "c.csv").write_text("﻿candidate_id,frame,time_s,x,y,score,rank\nb,1.0,0.1,1,2,0.5,2\na,1,0.1,1,2,0.9,1\n", encoding="utf-8")
    rows = files.read_candidates(spark, str(tmp_path / "c.csv")).collect()
    assert [r.candidate_id for r in rows] == ["a", "b"] and rows[0].area == 0.0
    (tmp_path / "bad.csv").write_text("candidate_id,frame\nx,1\n")
    with pytest.raises(ValueError, match="columns missing"):
        files.read_candidates(spark, str(tmp_path / "bad.csv"))
    assert files.column_named(rows and files.delimited(spark, str(tmp_path / "c.csv")), ["Missing", " FRAME "]) == "frame"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m/7_3.csv", "Frame,Visibility,X,Y\n1,1,2.5,3\n2,0,,\n")
    marks = files.read_annotation_archives(spark, str(tmp_path / "a.zip")).orderBy("frame").collect()
    assert (marks[0].match_id, marks[0].rally_id, marks[0].x, marks[1].x, marks[1].visibility) == ("07", "003", 2.5, None, 0)
    for i, text in enumerate(('{"run_id": "r1", "created_at": "2026-01-01"}', '{"run_id": "r2", "created_at": "2026-02-01"}', "{broken")):
        (tmp_path / "runs" / str(i)).mkdir(parents=True)
        (tmp_path / "runs" / str(i) / "run.json").write_text(text)
    assert [r.run_id for r in files.read_runs(spark, str(tmp_path / "runs")).collect()] == ["r2", "r1"]
    (tmp_path / "m.json").write_text('{"tracks": [{"track_id": "T1", "score": 1.0}, {"track_id": null}, {"track_id": "T1", "score": 2.0}]}')
    assert files.read_track_metrics(spark, str(tmp_path / "m.json"), "score double").first().score == 2.0
    frame = spark.range(10).withColumn("n", F.col("id"))
    bytes_of = lambda n: F.encode(F.lpad(F.lit(""), 9 * n * n, F.lit("a")), "UTF-8")
    values = {"local_rgb": bytes_of(2), "context_rgb": bytes_of(4), "label": F.col("id") % 3 - 1, "hard_negative": F.lit(0), "manifest_index": F.col("id"), "candidate_id": F.concat(F.lit("c"), F.col("id")), "clip_id": F.lit("k"), "local_frame": F.lit(1), "source_frame": F.lit(1), "rank": F.lit(1), "x": F.lit(0.5), "y": F.lit(0.5)}
    shard = frame.select(*[values[c].cast(t).alias(c) for c, t in files.SHARD_COLUMNS.items()])
    where = str(tmp_path / "shards")
    files.write_shards(shard, where, 4, local=2, context=4)
    written = spark.read.parquet(where)
    assert sorted(r["count"] for r in written.groupBy("shard").count().collect()) == [2, 4, 4]
    assert files.written_problem(written, shard, 4).count() == 0
    other = shard.filter("manifest_index != 9").withColumn("candidate_id", F.when(F.col("manifest_index") == 5, "z").otherwise(F.col("candidate_id")))
    assert sorted(map(tuple, files.written_problem(written, other, 4).collect())) == [(1, "order"), (2, "extra")]
    assert files.shard_schema_problem(shard.drop("y")).startswith("columns") and files.shard_schema_problem(shard.withColumn("rank", F.lit(1))) == "rank: int in place of smallint"
    bad = [("label", F.lit(5).cast("tinyint"), "label"), ("hard_negative", F.lit(2).cast("tinyint"), "hard_negative"), ("local_rgb", bytes_of(3), "local_rgb"), ("clip_id", F.lit(None).cast("string"), "null: clip_id"), ("candidate_id", F.lit("c" * 65), "id too long")]
    for column, value, problem in bad:
        assert shard.withColumn(column, value).select(files.shard_row_problem(local=2, context=4).alias("p")).first().p == problem
    with pytest.raises(Exception, match="hard_negative"):
        files.write_shards(shard.withColumn("hard_negative", F.lit(2).cast("tinyint")), where, 4, local=2, context=4)
    whole = files.catalog(files.listed_videos(spark, str(tmp_path / "v")).drop("modificationTime"))
    files.write_json(whole, str(tmp_path / "catalog"), one_file=True)
    back = spark.read.json(str(tmp_path / "catalog")).first()
    assert (back.schema_version, back.video_count) == (1, 2) and [v.path[-5:] for v in back.videos] == ["A.mov", "b.MP4"]
    with pytest.raises(ValueError, match="too many"):
        files.catalog(frame.withColumn("path", F.lit("x")), most=3)
    files.write_csv(frame, str(tmp_path / "out"), ["n"], one_file=True)
    assert files.delimited(spark, str(tmp_path / "out"), ["n"]).count() == 10


def test_audit_of_candidates(spark):
    """The medians of the candidates that a track names; the last of repeated names counts, missing ones add nothing."""
    points = spark.createDataFrame([("a", 1, 0.0, 0.0, "p", None), ("a", 2, 1.0, 0.0, "q", 3.0), ("a", 3, 2.0, 0.0, "r", 5.0), ("a", 4, 3.0, 0.0, "lost", float("nan")), ("b", 1, 0.0, 0.0, None, 2.0)], "track_id string, frame long, x double, y double, candidate_id string, prediction_error double")
    boxes = [(0, "p", 999.0, 9.0, 9.0), (1, "p", 10.0, 2.0, 4.0), (2, "q", 20.0, 3.0, 3.0), (3, "r", 40.0, 0.0, 5.0)]
    found = spark.createDataFrame([(*b, 50.0, float("inf"), 0.5, None, 0.25) for b in boxes], "row long, candidate_id string, area double, width double, height double, bright double, motion double, fill double, circ double, score double")
    out = {r.track_id: r for r in tracks.audit(points, found, ("row",)).collect()}
    assert [out["a"][n] for n in tracks.APPEARANCE] == [1.5, 20.0, 0.5, 1.5, pytest.approx(1 / 3, abs=1e-6), 50.0, 0.0, 0.5, 0.0, 0.25]
    assert [out["b"][n] for n in tracks.APPEARANCE] == [2.0, *[0.0] * 9] and out["a"].point_count == 4
    label = F.when(F.col("track_id") == "a", "ball").otherwise("not_ball")
    assert tracks.separation(tracks.audit(points, found, ("row",)).withColumn("label", label), "label", tracks.COMPARED + tracks.APPEARANCE).count() == 23


def test_registered_tracklets_grow_every_seed(spark):
    """The registered query keeps the operator's seeds and span, and grows what the plain search does."""
    from rallyframe.plans.motion import RELAXED

    own = random.Random(9)  # without ties, which the two searches may break apart by rounding
    rows = [(*r[:4], r[4] + own.uniform(0, 0.5), r[5] + own.uniform(0, 0.5), r[6] + own.uniform(0, 0.1), *r[7:]) for r in moving(60, 6)]
    got = tracklets.hypotheses(spark.createDataFrame(rows, CANDIDATE), RELAXED).collect()
    assert sorted((r.seed_frame, r.seed_rank, r.path, tuple(r.candidate_ids)) for r in got) == sorted((f, p, n, tuple(ids)) for f, p, n, ids in plain_paths(rows, RELAXED))
    assert {r.seed_rank for r in got} == set(range(6)) and max(r.frames[-1] - r.frames[0] + 1 for r in got) == 45


def test_stratified_sample(spark):
    groups = {"a": (100, 20), "b": (29, 3), "c": (40, 0), "d": (31, 1)}
    rows = [(g, i, i >= seen) for g, (seen, hidden) in groups.items() for i in range(seen + hidden)]
    frame = spark.createDataFrame(rows, "rally string, frame long, invisible boolean").repartition(5)
    out = sampling.stratified_sample(frame, "invisible", "rally", ("frame",)).collect()
    for g, (seen, hidden) in groups.items():
        k = min(8, hidden)
        even = lambda n, k: list(range(n)) if n <= k else [round(i * (n - 1) / (k - 1)) for i in range(k)]
        assert sorted(r.frame for r in out if r.rally == g) == even(seen, 32 - k) + [seen + i for i in even(hidden, k)]
    with pytest.raises(Exception, match="too few rows"):
        sampling.stratified_sample(frame.filter("rally = 'b' and frame > 0"), "invisible", "rally", ("frame",)).collect()


def test_peaks_targets_margins_and_bytes(spark):
    peaks = pixels.axis_peaks(spark.createDataFrame([([0.1, 0.9, 0.9, 0.2], [0.3, 0.7])], "x_axis array<double>, y_axis array<double>"), F.lit(1280), F.lit(720)).first()
    assert (peaks.pred_x, peaks.pred_y, peaks.confidence) == (320.0, 360.0, 0.7)
    place = lambda seen, x: one(spark, *pixels.target_position(F.lit(seen), F.lit(x).cast("double"), F.lit(72.0), F.lit(1280), F.lit(720)))
    assert place(True, 640.0) == (160.0, 12.8) and place(False, None) == (-1.0, -1.0)
    with pytest.raises(Exception, match="position is missing"):
        place(True, None)
    boxes = spark.createDataFrame([(32, 100.0, 100.0, 90, 95, 10, 12), (32, 10.0, 10.0, -9, 0, 4, 4), (48, 100.0, 100.0, 90, 95, 10, 12)], "size long, x double, y double, bbox_x long, bbox_y long, bbox_w long, bbox_h long")
    assert sorted(map(tuple, pixels.crop_margins(boxes).collect())) == [(32, 2, 1, -3, pytest.approx(-2.55), 1.5), (48, 1, 0, 14, 14.0, 14.0)]
    crops = spark.createDataFrame([(32, "a", b"12"), (32, "a", b"345"), (32, "b", b"1"), (48, "a", None)], "size long, candidate_id string, data binary")
    found = {r.size: r for r in pixels.compression_summary(crops, 1000).collect()}
    assert tuple(found[32]) == (32, 2, 3.0, 3.0, pytest.approx(4.8), 3000.0, 3000 / 2**20)


def test_reconciled_keys_of_both_sides(spark):
    from rallyframe.plans.motion import both_sides

    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string"), spark.createDataFrame([(2, "b"), (3, "c"), (4, None)], "k long, t string")
    assert sorted(map(tuple, both_sides(left, right).collect())) == [(1, 1, 0, 0, 0), (2, 0, 0, 1, 1), (3, 0, 1, 0, 0), (4, 0, 1, 0, 0)]


def test_labels_and_manifests(spark):
    rows = spark.createDataFrame([("ball", True, " r1 "), ("not_ball", True, "r1"), ("ignore", False, None), (None, None, "r2")], "label string, hard boolean, run_id string").withColumn("track_id", F.lit("T1"))
    assert [r.n for r in rows.filter("label is not null").select(records.label_number(F.col("label")).alias("n")).collect()] == [1, 0, -1]
    for wrong in ("Ball", None):
        with pytest.raises(Exception, match="unknown label"):
            spark.range(1).select(records.label_number(F.lit(wrong).cast("string"))).collect()
    assert [r.p for r in rows.select(records.manifest_problem(F.col("label"), F.col("hard")).alias("p")).collect()] == ["hard_negative", None, None, "label"]
    assert records.label_rows_problem(rows.limit(2), "r1") is None
    assert records.label_rows_problem(rows.limit(3), "r1") == "rows of another run: without an id"
    assert records.label_rows_problem(rows.filter("run_id = 'r2'"), "r1") == "rows of another run: r2"
    assert records.label_rows_problem(rows.limit(0), "r1") == "no rows"
    assert records.label_rows_problem(rows.drop("label", "track_id"), "r1") == "columns missing: label, track_id"


def test_run_history(spark):
    """Refused events change nothing, whatever the blocks; an unknown event is refused."""
    events = "start create create complete start delete complete start delete delete create".split() + ["noise", "create", "delete"]
    rows = [("a", i, e) for i, e in enumerate(events)] + [("b", 3, "create"), ("b", 900, "start"), ("b", 2000, "fail"), ("c", 0, None)]
    frame = spark.createDataFrame(rows, "run string, at long, event string")
    wanted, state = [], {}
    for run, at, event in rows:
        before = state.get(run, "none")
        after = records.CHANGES.get((before, event), before)
        state[run] = after
        wanted.append((run, at, event, before, (before, event) not in records.CHANGES, after))
    for block in (3, 1000):
        assert sorted(map(tuple, records.run_history(frame, "run", "at", "event", block).collect()), key=repr) == sorted(wanted, key=repr)
    assert records.run_history(frame.limit(0), "run", "at", "event").count() == 0


def test_run_checks(spark):
    check = lambda *v: spark.range(1).select(records.clip_range_problem(*[F.lit(x).cast("double") for x in v]).alias("p")).first().p
    assert [check(*v) for v in ((0, 15, None), (-1, 15, None), (0, 0.5, None), (0, 61, None), (20, 5, 20), (10, 10.01, 20), (10, 10.02, 20), (None, 5, 20), (float("nan"), 5, 20), (3, 5, 0))] == [None, "negative start", "too short", "too long", "starts after the end", None, "ends after the end", "not a number", "not a number", None]
    made = spark.sql("SELECT timestamp'2026-03-04 05:06:07' AS t").select(records.new_run_id(F.col("t"), F.lit("a/b/Été Final.v2.mp4"), F.lit("abcdef99")).alias("i")).first().i
    assert made == "20260304T050607_ete-final-v2_abcdef"
    kept = records.video_snapshot(spark.createDataFrame([("1", "/abs/x.mp4", "x.mp4")], "id string, absolute_path string, filename string"))
    assert kept.columns == list(records.SNAPSHOT) and kept.first().id == "1" and kept.first().codec is None
    a = spark.createDataFrame([(1, True, 0.0, 0.0)], "id int, visible boolean, x double, y double")
    assert records.reconciled_or_error(a, a, ["id"], ("visible",)).first().delta == 0
    for b, problem in ((a.withColumn("id", F.lit(2)), "only"), (a.withColumn("visible", F.lit(False)), "differs: visible")):
        with pytest.raises(Exception, match=problem):
            records.reconciled_or_error(a, b, ["id"], ("visible",)).collect()


@pytest.mark.parametrize("cells", [2, 4, 64])
def test_percentiles(spark, cells):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 501)) for v in rng.integers(0, 40, n)] + [(None, 3.0), ("d", None), ("c", None)] + [("e", 7.0)] * 50
    frame = spark.createDataFrame(rows, "k string, v double")
    counted = ranks.counted_values(frame, ["k"], "v", cells).collect()
    by_key = {}
    for k, v in rows:
        if v is not None:
            by_key.setdefault(k, []).append(v)
    assert sorted(((r.k, r.v, r["__n"], r["__first"], r["__size"]) for r in counted), key=repr) == sorted(((k, v, vs.count(v), sum(x < v for x in vs), len(vs)) for k, vs in by_key.items() for v in set(vs)), key=repr)
    got = {r.k: r for r in ranks.percentiles(frame, ["k"], "v", {"p5": 0.05, "p50": 0.5, "p90": 0.9, "n90": 0.9}, nearest=("n90",)).collect()}
    assert set(got) == set(by_key)
    for k, vs in by_key.items():
        assert (got[k].p5, got[k].p50, got[k].p90) == pytest.approx(tuple(np.percentile(vs, [5, 50, 90])))
        assert got[k].n90 == sorted(vs)[round((len(vs) - 1) * 0.9)]


def test_longest_runs_over_spans(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(i), bool(f)) for k in "ab" for i, f in zip(sorted(rng.choice(4000, 700, replace=False)), np.repeat(rng.random(100) < 0.5, 7), strict=True)]
    frame = spark.createDataFrame(rows + [("a", 5000, None)], "k string, i long, f boolean")
    from itertools import groupby

    for span in (16, 300, 4096):
        for r in tracks.islands(frame, "k", "i", "f", span).collect():
            runs = [(f, len(list(g))) for f, g in groupby(x[2] for x in rows if x[0] == r.k)]
            assert (r.longest_true, r.longest_false) == tuple(max((n for f, n in runs if f is flag), default=0) for flag in (True, False))


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(4)
    sets = {i: {rng.randrange(14) for _ in range(rng.randrange(1, 12))} for i in range(60)}
    rows = spark.createDataFrame([(i % 2, i, x) for i, xs in sets.items() for x in xs], "g long, s long, x long")
    wanted = {(i % 2, i, j, len(sets[i] & sets[j]), round(len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])), 6)) for i in sets for j in sets if i < j and i % 2 == j % 2 and len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) >= 0.65}
    assert {tuple(r) for r in tracks.overlaps(rows, "s", "x", "g").collect()} == wanted


def test_tracking_job(spark):
    """A bright disc that moves over dark frames is found, tracked as one track and summarized."""
    h, w, frames = 40, 60, []
    for f in range(14):
        yy, xx = np.mgrid[0:h, 0:w]
        image = np.where((xx - 8 - 3 * f) ** 2 + (yy - 20) ** 2 <= 9, 230, 10)
        frames.append(("c", f, image.ravel().astype(int).tolist()))
    table = spark.createDataFrame(frames, "clip_id string, frame long, gray array<int>")
    job = jobs.tracked(table, h, w, scores.ComponentLimits(blur=1))
    assert {r.frame: r.n for r in job.counts.collect()}[7] >= 1 and job.counts.count() == 14
    best = job.summaries.orderBy(F.desc("point_count")).first()
    assert best.point_count >= 8 and abs(best.mean_speed - 3) < 1
    labels = spark.createDataFrame([("r", "T001", "Ball")], "run_id string, track_id string, label string")
    rows, _ = jobs.audited(job.points, job.candidates.withColumnsRenamed({"mean_brightness": "bright", "motion_strength": "motion", "fill_ratio": "fill", "circularity": "circ", "bbox_w": "width", "bbox_h": "height"}), labels, "r")
    assert rows.first().label == "ball"
    with pytest.raises(ValueError, match="another run"):
        jobs.audited(job.points, job.candidates, labels, "other")
