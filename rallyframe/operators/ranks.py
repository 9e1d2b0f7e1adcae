"""Ranks and exact percentiles over groups of any size: no task sorts a whole group, no buffer holds its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def counted_values(rows: DataFrame, keys: list[str], value: str, cells: int = 64, weight: str | None = None) -> DataFrame:
    """(keys, value, __n, __first, __size): each distinct value of a group, how often it occurs, how many rows of the
    group lie below it, and how many the group has. Nulls don't count.

    Values are counted before anything is sorted. A group's values are split at approximate quantiles into cells,
    running sums go over a cell's values and over the cells. These quantiles depend on the order in which partial ones
    arrive, so they are found once and stored: both sums must see the same cells. Keys are matched with null as a value.
    With `weight`, a row counts so many times; keys and value are unique then.
    """
    if cells < 2:
        raise ValueError("cells must be 2 or more")
    known = rows.filter(F.col(value).isNotNull())
    per = known.where(F.col(weight) > 0).select(*keys, value, F.col(weight).alias("__n")) if weight else known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    named = {k: f"__key{i}" for i, k in enumerate(keys)}
    steps = [i / cells for i in range(1, cells)]
    cuts = per.groupBy(*keys).agg(F.percentile_approx(value, steps, 1000).alias("__cuts"), F.sum("__n").alias("__size")).withColumnsRenamed(named)
    celled = per.join(cut(cuts), _same(named)).drop(*named.values()).withColumn("__cell", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    sums = celled.groupBy(*keys, "__cell").agg(F.sum("__n").alias("__cell_n"))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.col("__cell").alias("__at"), F.coalesce(F.sum("__cell_n").over(before), F.lit(0)).alias("__start")).withColumnsRenamed(named)
    inside = Window.partitionBy(*keys, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = celled.withColumn("__local", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    out = local.join(starts, _same(named) & (F.col("__cell") == F.col("__at")))
    return out.select(*keys, value, "__n", (F.col("__start") + F.col("__local")).alias("__first"), "__size")


def _same(named: dict[str, str]) -> Column:
    both = F.lit(True)
    for mine, theirs in named.items():
        both = both & F.col(mine).eqNullSafe(F.col(theirs))
    return both


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], nearest: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(keys, names): exact percentiles of each group's values, interpolated between neighbours, or the value at the
    nearest rank for names in `nearest`. Groups without a value have no row."""
    ranked = counted_values(rows, keys, value, weight=weight)
    at = lambda rank: F.max(F.when((rank >= F.col("__first")) & (rank < F.col("__first") + F.col("__n")), F.col(value)))
    out = []
    for name, p in wanted.items():
        place = (F.col("__size") - 1) * F.lit(float(p))
        if name in nearest:
            out.append(at(F.bround(place)).alias(name))
        else:
            low, share = at(F.floor(place)), F.max(place - F.floor(place))
            out.append(F.when(share == 0, low).otherwise(low * (1 - share) + at(F.ceil(place)) * share).alias(name))
    return ranked.groupBy(*keys).agg(*out)
