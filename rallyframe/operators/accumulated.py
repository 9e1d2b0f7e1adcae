"""Evaluation states of bounded size: one row a group, added to batch by batch, merged across days and runs.

Counts and sums merge exactly. Errors and confidences are held in KLL sketches, whose merge answers quantiles within
`rank_error(k)` of the true rank (99 %), whatever the order of the merges; for exact quantiles of any size use the
counted cells of `evaluation.error_cells`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import f_beta, is_hit

COUNTS = ("samples", "visible", "invisible", "valid", "valid_visible", "valid_invisible", "raw_hits", "valid_hits")
SUMS = ("loss_sum", "error_sum")
SKETCHES = ("raw_errors", "valid_errors", "confidences")
#: Losses and errors are summed as decimals, so that merges don't depend on the order.
EXACT = "decimal(38,12)"


def rank_error(k: int) -> float:
    """How far the rank of an answered quantile is off at most, as a share of the values, with 99 % confidence."""
    return 2.296 / k**0.9723


def accumulated(rows: DataFrame, keys: list[str], valid: Column, error: Column, confidence: Column, loss: Column | None = None, k: int = 800) -> DataFrame:
    """The state of each group of `rows`, which have a `visible` column. `loss` is a row's own (a batch's mean stands
    for each of its rows). Only visible rows have an error; null errors, confidences and losses don't count."""
    loss = F.lit(None).cast("double") if loss is None else loss
    given = rows.select(*keys, F.coalesce("visible", F.lit(False)).alias("s"), F.coalesce(valid, F.lit(False)).alias("v"), error.cast("double").alias("e"), confidence.cast("double").alias("c"), loss.cast("double").alias("l"))
    s, v = F.col("s"), F.col("v")
    hit = s & is_hit(F.col("e"))
    when = {"samples": F.lit(True), "visible": s, "invisible": ~s, "valid": v, "valid_visible": v & s, "valid_invisible": v & ~s, "raw_hits": hit, "valid_hits": v & hit}
    total = lambda c: F.coalesce(F.sum(c.cast(EXACT)), F.lit(0)).cast(EXACT)
    shown = F.when(s, F.col("e"))
    return given.groupBy(*keys).agg(
        *[F.count_if(when[c]).alias(c) for c in COUNTS], total(F.col("l")).alias("loss_sum"), F.count("l").alias("loss_count"), total(shown).alias("error_sum"),
        F.kll_sketch_agg_double(shown, k).alias("raw_errors"), F.kll_sketch_agg_double(F.when(v, shown), k).alias("valid_errors"), F.kll_sketch_agg_double(F.col("c"), k).alias("confidences"),
    )


def merged(keys: list[str], *states: DataFrame, k: int = 800) -> DataFrame:
    """One state for each group of several tables of states."""
    whole = reduce(DataFrame.unionByName, states)
    return whole.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*COUNTS, "loss_count")], *[F.sum(c).cast(EXACT).alias(c) for c in SUMS], *[F.kll_merge_agg_double(c, k).alias(c) for c in SKETCHES])


def finalized(states: DataFrame, keys: list[str]) -> DataFrame:
    """Rates, means and quantiles of each state; null without a denominator or a value."""
    rate = lambda a, b: F.round(F.try_divide(a, b), 9)

    def quantile(sketch: str, q: float) -> Column:
        return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(q)))

    out = states.withColumn("precision", rate("valid_hits", "valid")).withColumn("recall", rate("valid_hits", "visible"))
    return out.select(
        *keys, *COUNTS, "precision", "recall", F.round(f_beta(F.col("precision"), F.col("recall")), 6).alias("f1"), rate("valid_invisible", "invisible").alias("fp_rate"), rate("raw_hits", "visible").alias("raw_recall"),
        F.try_divide(F.col("loss_sum").cast("double"), "loss_count").alias("mean_loss"), F.try_divide(F.col("error_sum").cast("double"), F.kll_sketch_get_n_double("raw_errors")).alias("mean_error"),
        quantile("raw_errors", 0.5).alias("raw_median_error"), quantile("valid_errors", 0.5).alias("valid_median_error"), quantile("valid_errors", 0.9).alias("valid_p90_error"), quantile("confidences", 0.5).alias("median_confidence"),
    )
