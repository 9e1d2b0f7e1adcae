"""Occupancy by bits equals measured distances, and a still camera costs no pairs."""

from __future__ import annotations

import numpy as np
import pytest

from rallyframe.operators import tracks

SCHEMA = "clip_id string, frame long, candidate_id string, x double, y double"


@pytest.mark.parametrize(("seed", "radius", "steps"), [(1, 20, 4), (2, 7, 3), (3, 20, 6)])
def test_against_all_distances(spark, seed, radius, steps):
    rng = np.random.default_rng(seed)
    rows = []
    for clip in ("a", "b"):
        for f in range(-3, 160, 1 if clip == "a" else 3):
            spots = [(50 + rng.normal(), 50 + rng.normal()), (50 + radius + rng.normal(), 50.0)][: 1 + f % 2] + [tuple(rng.uniform(0, 120, 2)) for _ in range(rng.integers(0, 4))] + [(float(rng.integers(0, 6)) * 5, -5.0)]
            rows += [(clip, f, f"{clip}{f}.{k}", float(x), float(y)) for k, (x, y) in enumerate(spots)]
    got = {(r.clip_id, r.candidate_id): (r.frames_near, r.occupancy) for r in tracks.occupancy(spark.createDataFrame(rows, SCHEMA), radius, steps).collect()}
    assert len(got) == len(rows)
    for clip in ("a", "b"):
        mine = [r for r in rows if r[0] == clip]
        frames, xy = np.array([r[1] for r in mine]), np.array([r[3:] for r in mine])
        for i, r in enumerate(mine):
            near = np.hypot(*(xy - xy[i]).T) <= radius
            n = len(set(frames[near].tolist()) - {r[1]})
            assert got[clip, r[2]] == (n, round(n / (len(set(frames.tolist())) - 1), 9))


def joined_rows(df) -> int:
    """Rows that the plan's joins put out."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        if "Join" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_a_still_camera_costs_no_pairs(spark):
    def still(n):
        rng = np.random.default_rng(n)
        return spark.createDataFrame([("c", f, f"{f}.{k}", float(x + rng.normal() / 3), 10.0) for f in range(n) for k, x in enumerate((10, 30, 200))], SCHEMA)

    small, large = (joined_rows(tracks.occupancy(still(n))) for n in (400, 1600))
    assert 0 < small and large < 5 * small


def test_no_candidates(spark):
    assert tracks.occupancy(spark.createDataFrame([], SCHEMA)).count() == 0


def sent_rows(df) -> int:
    """Rows that the plan's generators put out."""
    df.collect()
    total, nodes, seen = 0, [df._jdf.queryExecution().executedPlan()], set()
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        if "Generate" in node.nodeName() and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_sparse_candidates_are_hardly_sent_twice(spark):
    rng = np.random.default_rng(5)
    rows = [("c", f, f"{f}.{k}", float(rng.uniform(0, 1280)), float(rng.uniform(0, 720))) for f in range(150) for k in range(4)]
    assert 0 < sent_rows(tracks.occupancy(spark.createDataFrame(rows, SCHEMA))) < 2 * len(rows)


@pytest.mark.parametrize("full", [0, 20, 10**6])
def test_full_and_thin_tiles_agree(spark, full):
    rng = np.random.default_rng(6)
    rows = [("c", f, f"{f}.{k}", float(x), float(y)) for f in range(90) for k, (x, y) in enumerate([(rng.normal(100), rng.normal(60)), tuple(rng.uniform(-200, 400, 2))])] + [("c", 5, "none", None, 3.0)]
    frames, xy, ids = [r[1] for r in rows], np.array([r[3:] for r in rows], float), [r[2] for r in rows]
    wanted = {i: len({f for f, p in zip(frames, xy, strict=True) if np.hypot(*(p - q)) <= 20} - {g}) for i, g, q in zip(ids, frames, xy, strict=True)}
    assert {r.candidate_id: r.frames_near for r in tracks.occupancy(spark.createDataFrame(rows, SCHEMA), full=full).collect()} == wanted
