"""Draws with replacement: exact totals, even chances, the same again."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.operators import sampling


def test_draws_are_even_and_exact(spark):
    rows = spark.range(500).withColumn("payload", F.lit("x"))
    n = 20_000
    copies = np.zeros(500, int)
    for r in sampling.drawn(rows, n, ("id",), seed=1).collect():
        copies[r.id] = r.copies
    assert copies.sum() == n
    chi = ((copies - n / 500) ** 2 / (n / 500)).sum()
    assert abs(chi - 499) < 5 * math.sqrt(2 * 499)
    few = [sum(r.copies for r in sampling.drawn(rows, 7, ("id",), seed=s).collect()) for s in range(3)]
    assert few == [7, 7, 7]


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(300)
    draws = [sorted(map(tuple, sampling.drawn(r, 900, ("id",), 3).collect())) for r in (rows, rows.repartition(7), rows.orderBy(F.desc("id")).coalesce(1))]
    assert draws[0] == draws[1] == draws[2] != sorted(map(tuple, sampling.drawn(rows, 900, ("id",), 4).collect()))


def test_training_rows(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") == 999, None).otherwise(F.col("id") % 50 == 0).alias("rare"))
    out = sampling.training_rows(rows, "rare", 0.25, ("id",), seed=5).collect()
    assert sum(r.rare for r in out) == math.ceil(979 / 3) and sum(not r.rare for r in out) == 979
    assert sorted(r.place for r in out) == list(range(len(out))) and {r.id for r in out} == set(range(999))
    places = np.array([r.place for r in out if r.rare])
    assert abs(places.mean() - len(out) / 2) < 60
    for share, flags in ((0.01, None), (0.25, True), (0.25, False)):
        same = rows.where("rare is not null") if flags is None else rows.where(f"rare = {flags}")
        assert sampling.training_rows(same, "rare", share, ("id",), 5).count() == same.count()
    with pytest.raises(ValueError, match="no rows"):
        sampling.drawn(rows.limit(0), 1, ("id",), 1)
