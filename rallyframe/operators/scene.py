"""Scene geometry: quadrilaterals and observations, checked by columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _corner(corners: Column, i: Column | int) -> Column:
    return F.get(corners, F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(4)))


def turns(corners: Column) -> Column:
    """Cross products at the four corners of an array of structs (x, y)."""
    def at(i: Column) -> Column:
        a, b, c = (_corner(corners, i + d) for d in range(3))
        return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])

    return F.transform(F.sequence(F.lit(0), F.lit(3)), at)


def shoelace(corners: Column) -> Column:
    """Signed area of the quadrilateral."""
    terms = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _corner(corners, i)["x"] * _corner(corners, i + 1)["y"] - _corner(corners, i + 1)["x"] * _corner(corners, i)["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2


def quad_problem(corners: Column, width: Column | int, height: Column | int, flat: float = 1e-9) -> Column:
    """Why four ordered corners are no valid quadrilateral, or null: the first reason that holds."""
    finite = F.forall(corners, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    within = F.forall(corners, lambda p: (p["x"] >= 0) & (p["x"] <= width) & (p["y"] >= 0) & (p["y"] <= height))
    t = turns(corners)
    one_way = F.forall(t, lambda v: v > 0) | F.forall(t, lambda v: v < 0)
    return (F.when(corners.isNull() | (F.size(corners) != 4), "not_four_corners").when(~finite, "not_finite").when(~within, "out_of_bounds").when(F.size(F.array_distinct(corners)) < 4, "repeated_corner")
            .when(F.exists(t, lambda v: F.abs(v) <= flat), "collinear").when(~one_way, "crossed").when(F.abs(shoelace(corners)) <= flat, "no_area"))


def observation_problem(valid: Column, geometry: Column, reason: Column, confidence: Column, uncertainty: Column) -> Column:
    """A valid observation has a geometry and no reason, an invalid one a reason; numbers keep their ranges."""
    return (F.when(~confidence.between(0, 1), "confidence").when(uncertainty < 0, "uncertainty").when(valid & geometry.isNull(), "geometry_missing")
            .when(valid & reason.isNotNull(), "reason_with_valid").when(~valid & F.coalesce(F.trim(reason) == "", F.lit(True)), "reason_missing"))
