"""Prediction policies and their quality."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import f_beta, inside, is_hit
from ..session import cut
from .ranks import percentiles

# The thresholds that the sweep tries.
GLOBAL_THRESHOLDS = (0.02, 0.03, 0.04, 0.05, 0.06, 0.075, 0.10, 0.125, 0.15, 0.20, 0.25)
LOCAL_THRESHOLDS = (0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.075, 0.10, 0.15, 0.20, 0.25)
REFINED_POLICIES = ("refined_only", "refined_then_global")
SIZE = (1280, 720)


def in_image(stage: str) -> Column:
    return F.coalesce(inside(F.col(f"{stage}_x"), F.col(f"{stage}_y"), *SIZE), F.lit(False))


def policy_choice(policy: Column, global_min: Column, local_min: Column) -> Column:
    """Which stage predicts: `global`, `refined` or null. A refined prediction needs both confidences and its own
    place in the image; the global place doesn't bind it."""
    use_global = (F.col("global_conf") >= global_min) & in_image("global")
    use_refined = (F.col("global_conf") >= global_min) & (F.col("local_conf") >= local_min) & in_image("refined")
    return (F.when((policy == "global_only") & use_global, "global").when((policy != "global_only") & use_refined, "refined")
            .when((policy == "refined_then_global") & use_global, "global"))


def strict_refined_valid(global_min: float, local_min: float) -> Column:
    """The final test's rule: a refined prediction also needs a valid global one."""
    valid = (F.col("global_conf") >= global_min) & in_image("global") & (F.col("local_conf") >= local_min) & in_image("refined")
    return F.coalesce(valid, F.lit(False))


CELL = ["stage", "fps_nominal", "match_id", "visible", "valid", "error"]


def error_cells(predictions: DataFrame, global_min: float = 0.15, local_min: float = 0.04) -> DataFrame:
    """How many rows of each frame rate and match share a stage's outcome: (stage, fps_nominal, match_id, visible,
    valid, error, n).

    This is all that the stages' quality depends on, so it is its exact, mergeable state: tables of several days or
    runs are merged by `merged_cells`, in any order.
    """
    stages = F.array(
        F.struct(F.lit("global").alias("stage"), F.coalesce((F.col("global_conf") >= global_min) & in_image("global"), F.lit(False)).alias("valid"), F.col("global_error").alias("error")),
        F.struct(F.lit("refined").alias("stage"), strict_refined_valid(global_min, local_min).alias("valid"), F.col("refined_error").alias("error")),
    )
    return predictions.select("fps_nominal", "match_id", "visible", F.inline(stages)).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))


def merged_cells(*parts: DataFrame) -> DataFrame:
    """One table of cells for all parts."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*CELL).agg(F.sum("n").alias("n"))


def metrics_of_cells(cells: DataFrame) -> DataFrame:
    """Both stages by frame rate, by match and over all. Rates are null without a denominator; error percentiles are
    exact, by ranks over counted values.

    The cells are stored once, and once more by group and error; everything else reads these.
    """
    groups = F.array(*[F.struct(F.lit(n).alias("grouping"), v.alias("value")) for n, v in (("fps", F.col("fps_nominal")), ("match", F.col("match_id").cast("string")), ("all", F.lit("all")))])
    rows = cut(cells).select("stage", "visible", "valid", "error", "n", F.inline(groups))
    keys = ["stage", "grouping", "value"]
    number = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    seen = F.col("visible") & F.col("error").isNotNull()
    errors = cut(rows.where(seen).groupBy(*keys, "error").agg(F.sum("n").alias("raw_n"), number(F.col("valid")).alias("valid_n")))
    raw = percentiles(errors, keys, "error", {"raw_median_error": 0.5}, weight="raw_n")
    shown = percentiles(errors, keys, "error", {"valid_median_error": 0.5, "valid_p90_error": 0.9}, weight="valid_n")
    hit = is_hit(F.col("error")) & F.col("visible")
    counts = {"frames": F.lit(True), "visible_frames": F.col("visible"), "valid_frames": F.col("valid"), "invisible_valid": F.col("valid") & ~F.col("visible"), "raw_hits": hit, "valid_hits": F.col("valid") & hit}
    out = rows.groupBy(*keys).agg(*[number(v).alias(c) for c, v in counts.items()])
    precision, recall = F.round(F.try_divide("valid_hits", "valid_frames"), 9), F.round(F.try_divide("valid_hits", "visible_frames"), 9)
    out = out.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.round(f_beta(F.col("precision"), F.col("recall")), 6))
    out = out.withColumnsRenamed({k: f"__{k}" for k in keys})
    for more in (raw, shown):
        out = out.join(more, [F.col(f"__{k}").eqNullSafe(F.col(k)) for k in keys], "left").drop(*keys)
    return out.withColumnsRenamed({f"__{k}": k for k in keys}).withColumns({c: F.round(c, 6) for c in ("raw_median_error", "valid_median_error", "valid_p90_error")})


def grouped_stage_metrics(predictions: DataFrame, global_min: float = 0.15, local_min: float = 0.04) -> DataFrame:
    """Both stages by frame rate, by match and over all, in one pass over the predictions."""
    return metrics_of_cells(error_cells(predictions, global_min, local_min))


def transitions(predictions: DataFrame) -> DataFrame:
    """How the refined stage changes the global one, over visible frames with both errors."""
    both = predictions.filter(F.col("visible") & F.col("global_error").isNotNull() & F.col("refined_error").isNotNull())
    before, after, delta = F.col("global_error") <= 20, F.col("refined_error") <= 20, F.col("refined_error") - F.col("global_error")
    return both.groupBy("fps_nominal").agg(
        F.count_if(before & after).alias("kept"), F.count_if(before & ~after).alias("lost"), F.count_if(~before & after).alias("recovered"), F.count_if(~before & ~after).alias("missed"),
        F.count_if(delta < -1e-6).alias("better"), F.count_if(delta > 1e-6).alias("worse"), F.count_if(F.abs(delta) <= 1e-6).alias("equal"), F.round(F.percentile(delta, 0.5), 6).alias("median_delta"),
    )


def policy_grid() -> list[tuple[str, float, float]]:
    refined = [(p, g, v) for p in REFINED_POLICIES for g in GLOBAL_THRESHOLDS for v in LOCAL_THRESHOLDS]
    return [("global_only", g, LOCAL_THRESHOLDS[0]) for g in GLOBAL_THRESHOLDS] + refined


def threshold_sweep(predictions: DataFrame) -> DataFrame:
    """Quality of all policies and thresholds in one scan.

    What a row adds to a combination depends only on how many thresholds of each kind its confidences
    pass. Rows are first counted by that cell (a few thousand of them at most, however many rows there
    are); the grid then meets cells, not rows.
    """
    passed = lambda c, ts: F.aggregate(F.array(*[F.coalesce((F.col(c) >= t).cast("int"), F.lit(0)) for t in ts]), F.lit(0), lambda a, b: a + b)
    cells = predictions.select(
        passed("global_conf", GLOBAL_THRESHOLDS).alias("g"), passed("local_conf", LOCAL_THRESHOLDS).alias("l"), in_image("global").alias("gi"), in_image("refined").alias("ri"), "visible",
        (is_hit(F.col("global_error")) & F.col("visible")).alias("gh"), (is_hit(F.col("refined_error")) & F.col("visible")).alias("rh"),
    ).groupBy("g", "l", "gi", "ri", "visible", "gh", "rh").agg(F.count(F.lit(1)).alias("n"))
    grid = [{"ordinal": i, "policy": p, "global_threshold": g, "local_threshold": v, "g_at": GLOBAL_THRESHOLDS.index(g) + 1, "l_at": LOCAL_THRESHOLDS.index(v) + 1} for i, (p, g, v) in enumerate(policy_grid())]
    kind = "array<struct<ordinal long, policy string, global_threshold double, local_threshold double, g_at int, l_at int>>"
    both = cells.select("*", F.inline(F.from_json(F.lit(json.dumps(grid)), kind)))
    g_ok, r_ok = (F.col("g") >= F.col("g_at")) & F.col("gi"), (F.col("g") >= F.col("g_at")) & (F.col("l") >= F.col("l_at")) & F.col("ri")
    source = F.when((F.col("policy") == "global_only") & g_ok, "global").when((F.col("policy") != "global_only") & r_ok, "refined").when((F.col("policy") == "refined_then_global") & g_ok, "global")
    hit = ((source == "global") & F.col("gh")) | ((source == "refined") & F.col("rh"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    out = both.groupBy("ordinal", "policy", "global_threshold", "local_threshold").agg(
        total(source.isNotNull()).alias("predicted"), total(hit).alias("hits"), total(F.col("visible")).alias("visible_frames"), total(~F.col("visible")).alias("invisible_frames"),
        total(source.isNotNull() & ~F.col("visible")).alias("false_positives"), total(source == "global").alias("from_global"), total(source == "refined").alias("from_refined"),
    )
    precision, recall = F.round(F.try_divide("hits", "predicted"), 9), F.round(F.try_divide("hits", "visible_frames"), 9)
    return out.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.round(f_beta(F.col("precision"), F.col("recall")), 6)).withColumn("fp_rate", F.round(F.try_divide("false_positives", "invisible_frames"), 9))


def best_of(sweep: DataFrame) -> DataFrame:
    """The best combination of each policy by f1, recall, precision, least false positives, then the first."""
    order = F.struct(F.coalesce("f1", F.lit(-1.0)), F.coalesce("recall", F.lit(-1.0)), F.coalesce("precision", F.lit(-1.0)), -F.coalesce("fp_rate", F.lit(1.0)), -F.col("ordinal"))
    best = sweep.groupBy("policy").agg(F.max_by(F.struct("global_threshold", "local_threshold", "f1", "recall", "precision", "fp_rate"), order).alias("b"))
    return best.select("policy", "b.*")


def classifier_metrics(rows: DataFrame, score: str, positive: str, threshold: float) -> list[Column]:
    """Confusion counts and rates of a thresholded score."""
    p, y = F.col(score) >= threshold, F.col(positive)
    tp, fp, fn, tn = F.count_if(p & y), F.count_if(p & ~y), F.count_if(~p & y), F.count_if(~p & ~y)
    tpr, tnr = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.round((tp + tn) / F.count(F.lit(1)), 6).alias("accuracy"), F.round((tpr + tnr) / 2, 6).alias("balanced_accuracy")]


def separation_auc(rows: DataFrame, key: str, score: str, positive: str) -> DataFrame:
    """Area under the curve by rank sums with average ranks for ties.

    Equal scores are counted together first: the running sum of a group is over its distinct scores.
    """
    per = rows.groupBy(key, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(key).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2))
    return per.withColumn("below", below).groupBy(key).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.round(F.try_divide(won, F.sum("p") * F.sum("q")), 6).alias("auc"))
