"""Scores of candidates and of links between them, as columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scorer turns a table of candidates into a column; higher is better.
Scorer = Callable[[DataFrame], Column]


@dataclass(frozen=True)
class ComponentLimits:
    """What a moving blob must be to count as a candidate."""

    motion_threshold: int = 18
    min_area: int = 2
    max_area: int = 160
    max_dimension: int = 26
    min_fill: float = 0.10
    per_frame: int = 24
    blur: int = 3

    def __post_init__(self) -> None:
        if not (0 <= self.motion_threshold <= 255 and 1 <= self.min_area <= self.max_area and self.max_dimension >= 1 and 0 < self.min_fill <= 1 and self.per_frame >= 1 and self.blur in (1, 3, 5, 7)):
            raise ValueError(f"limits out of range: {self}")


def heuristic_score(motion: Column, brightness: Column, fill: Column, circularity: Column, area: Column) -> Column:
    """Weighted sum of saturated features; a round bright fast blob of 28 pixels scores 1."""
    one = F.lit(1.0)
    return (
        0.38 * F.least(one, motion / 100.0) + 0.22 * F.least(one, brightness / 255.0) + 0.16 * F.least(one, fill / 0.70)
        + 0.14 * circularity + 0.10 * F.exp(-F.abs(area - 28.0) / 28.0)
    )


def component_fits(area: Column, width: Column, height: Column, limits: ComponentLimits = ComponentLimits()) -> Column:
    box = (area >= limits.min_area) & (area <= limits.max_area) & (width >= 1) & (height >= 1) & (width <= limits.max_dimension) & (height <= limits.max_dimension)
    return box & (F.try_divide(area.cast("double"), width * height) >= limits.min_fill)


def appearance_penalty(area_a: Column, area_b: Column, bright_a: Column, bright_b: Column, size_a: Column, size_b: Column) -> Column:
    """Change of area, brightness and box size; a term with a value that isn't positive is left out."""
    two = F.lit(2.0)
    log_ratio = lambda a, b: F.least(two, F.abs(F.ln(b / a)))
    term = lambda a, b, value: F.coalesce(F.when((a > 0) & (b > 0), value), F.lit(0.0))
    return term(area_a, area_b, log_ratio(area_a, area_b)) + term(bright_a, bright_b, F.abs(bright_b - bright_a) / 255.0) + 0.5 * term(size_a, size_b, log_ratio(size_a, size_b))


def track_score(mean_score: Column, coverage: Column, points: Column, speed: Column, error: Column, acceleration: Column, gaps: Column) -> Column:
    return 1.8 * mean_score + 0.55 * coverage + 0.32 * F.log1p(points) + 0.25 * F.least(F.lit(1.0), speed / 18.0) - 0.030 * error - 0.018 * acceleration - 0.025 * gaps


def turn_degrees(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two velocities; 0 if either stands still."""
    na, nb = F.hypot(ax, ay), F.hypot(bx, by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ax * bx + ay * by, na * nb)))
    return F.when((na < 1e-6) | (nb < 1e-6), 0.0).otherwise(F.degrees(F.acos(cosine)))
