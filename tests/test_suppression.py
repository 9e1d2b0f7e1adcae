"""Suppression in rounds equals the sequential rule."""

from __future__ import annotations

import numpy as np
import pytest

from rallyframe.operators import tracklets
from rallyframe.operators.tracklets import TrackConfig

SCHEMA = "clip_id string, seed_frame long, seed_rank long, path long, score double, candidate_ids array<string>, frames array<long>, xs array<double>, ys array<double>, errors array<double>"


def sequential(rows, config):
    out = []
    for clip in sorted({r[0] for r in rows}):
        kept = []
        for r in sorted((r for r in rows if r[0] == clip), key=lambda r: (-r[4], *r[1:4])):
            own = set(r[5])
            if len(kept) < config.max_tracks and all(len(own & set(k[5])) / min(len(own), len(set(k[5]))) < config.overlap for k in kept):
                kept.append(r)
        out += [(clip, i + 1, *r[1:4]) for i, r in enumerate(kept)]
    return sorted(out)


def paths(seed: int, clips: int, frames: int, each: int):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(clips):
        for f in range(0, frames, 3):
            for k in range(each):
                size = int(rng.integers(5, 20))
                ids = [f"{f + int(j)}.{int(rng.integers(2))}" for j in np.sort(rng.choice(24, size, replace=False))]
                rows.append((f"c{c}", f, k, int(rng.integers(3)), float(rng.integers(0, 12)) / 4, ids, [f + i for i in range(size)], [0.0] * size, [0.0] * size, [0.0] * size))
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize(("seed", "most", "frames", "each"), [(1, 24, 90, 4), (2, 3, 90, 4), (3, 1000, 300, 3)])
def test_rounds_equal_the_sequential_rule(spark, seed, most, frames, each):
    rows, config = paths(seed, 2, frames, each), TrackConfig(max_tracks=most)
    got = tracklets.selected(spark.createDataFrame(rows, SCHEMA).repartition(5), config)
    assert sorted(tuple(r[:5]) for r in got.collect()) == sequential(rows, config)


def test_a_chain_is_decided_link_by_link(spark):
    ids = [(f"a{i}", i) for i in range(9)]
    ranked = spark.createDataFrame([("g", i) for _, i in ids], "clip string, id long")
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(8)], "clip string, better long, worse long")
    assert sorted(r.id for r in tracklets.suppressed(ranked, edges, "clip").collect()) == [0, 2, 4, 6, 8]
    assert tracklets.suppressed(ranked.limit(0), edges.limit(0), "clip").count() == 0


def test_no_paths(spark):
    assert tracklets.selected(spark.createDataFrame([], SCHEMA)).count() == 0
