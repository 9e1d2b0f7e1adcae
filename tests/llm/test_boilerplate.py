"""Unlike texts with much boilerplate in common: whole results without all pairs."""

from __future__ import annotations

import random

import pytest

from rallyframe.llm import near_dedup


def texts(n: int, seed: int) -> list[str]:
    """100 common words and 30 of their own each; every tenth is a near copy of the one before, every 15th lies just
    below the threshold of one; a dozen near copies of a long text lie in between."""
    rng = random.Random(seed)
    common = [f"common{i}" for i in range(100)]
    out: list[str] = []
    for i in range(n):
        own = [f"w{rng.randrange(10**9)}" for _ in range(30)]
        if i and i % 10 == 0:
            words = out[-1].split()
            words[rng.randrange(100, 130)] = "other"
        elif i and i % 15 == 0:
            words = out[-1].split()
            words[100:] = [w if rng.random() < 0.62 else f"x{rng.randrange(10**9)}" for w in words[100:]]
        else:
            words = common + own
        out.append(" ".join(words))
    return out


def brute(rows: list[tuple[int, str]], k: int) -> dict[int, int]:
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize(("block", "pays"), [(64, 0), (64, 50)])
def test_boilerplate_equals_brute_force(spark, block, pays):
    rows = list(enumerate(texts(500, 64)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in near_dedup.NearDedup(k=2, block=block, crowd=8, representatives=2, index_pays=pays).labelled(frame).collect()}
    want = brute(rows, 2)
    assert len(set(want.values())) < 460 and got == want


def test_a_family_of_copies_beside_boilerplate(spark):
    """A family whose main component is large, with loose texts that only a rare shingle or a full scan can place."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.choice([1, 3, 9, 20, 23, 26])):
            words[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in near_dedup.NearDedup(k=2, block=32, crowd=4, representatives=2, index_pays=0).labelled(frame).collect()}
    assert got == brute(rows, 2)
