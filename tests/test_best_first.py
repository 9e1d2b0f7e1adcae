"""A clip's best paths decide what is kept: no pairs of paths, and few rows beyond the paths themselves."""

from __future__ import annotations

import pytest
from test_alike import written
from test_blocks import CONFIG, clips
from test_suppression import SCHEMA, paths, sequential

from rallyframe.operators import tracklets
from rallyframe.operators.tracklets import TrackConfig


@pytest.mark.parametrize(("most", "looked"), [(24, 3), (3, 7), (1000, 10)])
def test_clips_that_the_first_paths_do_not_decide(spark, monkeypatch, most, looked):
    monkeypatch.setattr(tracklets, "LOOKED", looked)
    rows, config = paths(4, 3, 60, 3) + [("short", 0, 0, 0, 1.0, ["x"], [0], [0.0], [0.0], [0.0]), ("short", 0, 1, 0, 0.5, [], [], [], [], []), ("short", 3, 1, 0, 0.2, None, [], [], [], []), ("short", 3, 2, 0, 0.1, ["x", None], [3], [0.0], [0.0], [0.0])], TrackConfig(max_tracks=most)
    plain = [(*r[:5], [i for i in r[5] or () if i], *r[6:]) for r in rows if r[5]]
    want = [r for r in sequential(plain, config) if r[0] != "short"] + [("short", 1, 0, 0, 0), ("short", 2, 0, 1, 0), ("short", 3, 3, 1, 0)]
    assert sorted(tuple(r[:5]) for r in tracklets.selected(spark.createDataFrame(rows, SCHEMA).repartition(3), config).collect()) == sorted(want)


def test_crowded_paths_are_not_paired(spark):
    """All paths of a clip share most of their points: each used to meet each other in a shuffled row."""
    ids = [f"{i}" for i in range(8)]
    rows = [("c", f, k, 0, float(k), ids, list(range(8)), [0.0] * 8, [0.0] * 8, [0.0] * 8) for f in range(20) for k in range(10)]
    kept, sent = written(spark, lambda: tracklets.selected(spark.createDataFrame(rows, SCHEMA)))
    assert kept == 1 and sent < 3 * len(rows)


def test_frames_inside_a_part_are_sent_once(spark):
    frame = spark.createDataFrame(clips(3, 512)).repartition(2)
    frame.count()
    found, sent = written(spark, lambda: tracklets.hypotheses(frame, CONFIG))
    assert found and sent < 2.3 * frame.count()  # one row in the repartition above, and one beside a few copies here


def test_candidates_that_lie_together(spark):
    """Ranks can be found where the search is: then its rows are sent once in all."""
    frame = spark.createDataFrame(clips(3, 512))
    keys = ["clip_id", "seed_frame", "seed_rank", "path", "score", "candidate_ids"]
    lies = lambda: tracklets.hypotheses(tracklets.together(frame, CONFIG), CONFIG)
    found, sent = written(spark, lies)
    assert sent < 1.3 * frame.count()
    got = sorted(tuple(r) for r in lies().select(*keys).collect())
    assert len(got) == found and got == sorted(tuple(r) for r in tracklets.hypotheses(frame, CONFIG, block=1024).select(*keys).collect())
