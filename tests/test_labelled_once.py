"""Candidates are ranked once, whatever a query asks of their frames."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from rallyframe.plans import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="generated tables aren't here")
@pytest.mark.parametrize(("name", "scans"), [("frame_universe", 1), ("recall_curve", 1), ("category_counts", 1), ("longest_runs", 2), ("classifier_quality", 1)])
def test_candidates_are_read_once(spark, name, scans):
    """The runs read their flags in two places, each with one scan."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < len(re.findall(r"l_orderkey#\d+L?[^\n]*\] parquet", plan)) <= scans


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="generated tables aren't here")
def test_both_samples_come_from_one_numbering(spark):
    plan = QUERIES["even_samples"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and len(re.findall(r"l_orderkey#\d+L?[^\n]*\] parquet", plan)) <= 5
