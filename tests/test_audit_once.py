"""Audits find their steps and their points' candidates once, and rank a feature's values by cells."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from rallyframe.operators import tracks
from rallyframe.plans import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="generated tables aren't here")
def test_an_audit_reads_its_tables_before_it_aggregates(spark):
    plan = QUERIES["track_audit"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "LogicalRDD" in plan


def test_separation_equals_percentiles_of_lists(spark):
    rng = np.random.default_rng(6)
    rows = [(i, ("ball", "not_ball", "uncertain")[int(rng.integers(3))], float(rng.integers(40)), None if i % 5 == 0 else float(rng.random()), None, 7.0) for i in range(300)]
    frame = spark.createDataFrame(rows, "track_id long, label string, a double, b double, c double, d double")
    out = tracks.separation(frame, "label", ("a", "b", "c", "d"))
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.feature: tuple(r)[1:] for r in out.collect()}
    for at, name in ((2, "a"), (3, "b"), (5, "d")):
        of = lambda *labels: [r[at] for r in rows if r[1] in labels and r[at] is not None]  # noqa: B023, E731
        b, n = np.percentile(of("ball"), 50), np.percentile(of("not_ball"), 50)
        q1, q3 = np.percentile(of("ball", "not_ball"), [25, 75])
        assert got[name] == pytest.approx((b, n, (b - n) / max(q3 - q1, 1e-9)), abs=1e-5)
    assert got["c"] == (0.0, 0.0, 0.0) and tracks.separation(frame.where("label = 'uncertain'"), "label", ("a",)).count() == 0
