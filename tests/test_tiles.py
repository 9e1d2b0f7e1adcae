"""Components across tiles equal those of the whole frame; connected components equal union-find."""

from __future__ import annotations

import numpy as np
import pytest

from rallyframe.operators import graphs, pixels, tiles

SCHEMA = "clip_id string, frame long, mask array<int>, gray array<int>, motion array<int>"


def snake(height: int, width: int) -> np.ndarray:
    """A path that winds through the whole frame."""
    mask = np.zeros((height, width), int)
    mask[::4] = 1
    mask[2::8, -1] = mask[1::8, -1] = mask[3::8, -1] = 1
    mask[5::8, 0] = mask[6::8, 0] = mask[7::8, 0] = 1
    return mask


def whole(mask, gray, motion):
    label, n = pixels.labelled(mask.astype(bool))
    out = []
    for i in range(1, n + 1):
        ys, xs = np.nonzero(label == i)
        out.append((i, round(float(xs.mean()), 3), round(float(ys.mean()), 3), xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, len(xs), gray[ys, xs].mean(), motion[ys, xs].mean()))
    return out


@pytest.mark.parametrize("size", [4, 7, 64])
def test_tiles_equal_the_whole_frame(spark, size):
    rng, height, width = np.random.default_rng(size), 21, 30
    masks = [snake(height, width), *[(rng.random((height, width)) < p).astype(int) for p in (0.1, 0.4, 0.55)], np.zeros((height, width), int), np.ones((height, width), int), np.eye(height, width, dtype=int)]
    gray, motion = rng.integers(0, 256, (2, height, width))
    rows = [(c, f, m.ravel().tolist(), gray.ravel().tolist(), motion.ravel().tolist()) for c in ("a", "b") for f, m in enumerate(masks)]
    cut = tiles.tiled(spark.createDataFrame(rows, SCHEMA), height, width, size)
    assert cut.count() == len(rows) * -(-height // size) * -(-width // size)
    got = {}
    for r in tiles.tile_components(cut).collect():
        got.setdefault((r.clip_id, r.frame), []).append(tuple(r)[2:])
    for c in ("a", "b"):
        for f, m in enumerate(masks):
            want = whole(m, gray, motion)
            mine = sorted(got.get((c, f), []))
            assert len(mine) == len(want)
            for g, w in zip(mine, want, strict=True):
                assert g[:1] + g[3:8] == w[:1] + w[3:8] and g[1:3] == pytest.approx(w[1:3], abs=0.0011) and g[8:] == pytest.approx(w[8:])


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    pairs = [("g", int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [("g", 1000 + i, 1001 + i) for i in range(60)] + [("h", 1, 2), ("h", 5, 5)] + [("h", 7, 100 + i) for i in range(50)]
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for g, a, b in pairs:
        if a != b:
            x, y = sorted((find((g, a)), find((g, b))))
            root[y] = x
    got = {(r.g, r.node): (r.g, r.root) for r in graphs.components(spark.createDataFrame(pairs, "g string, a long, b long"), ("g",)).collect()}
    assert got == {n: find(n) for n in root}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0
