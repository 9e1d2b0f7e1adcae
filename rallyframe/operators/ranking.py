"""Labelling and ranking quality of candidates, frame by frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_hit, ratio

FRAME = ["clip_id", "frame"]


def top_k(rows: DataFrame, k: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each key; `order` must be total."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def with_distance(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates of annotated frames with their distance to a visible position, else null."""
    both = candidates.join(truth, FRAME)
    return both.withColumn("distance", F.when(F.col("visible"), F.hypot(F.col("x") - F.col("gt_x"), F.col("y") - F.col("gt_y"))))


def nearest_labelled(rows: DataFrame, radius: float = 20.0) -> DataFrame:
    """`ball` for the nearest candidate within the radius, `ignore` for the others there, else `not_ball`."""
    near = is_hit(F.col("distance"), radius)
    place = F.row_number().over(Window.partitionBy(*FRAME, near).orderBy("distance", "rank", "candidate_id"))
    label = F.when(near & (place == 1), "ball").when(near, "ignore").otherwise("not_ball")
    reason = F.when(near & (place == 1), "nearest_within_20px").when(near, "additional_within_20px").when(F.col("visible"), "outside_20px").otherwise("gt_not_visible")
    return rows.withColumn("label", label).withColumn("label_reason", reason)


def frame_counts(labelled: DataFrame, *more: Column) -> DataFrame:
    """What the candidates of each frame say of it, and `more` aggregates; the first one counts by (rank, id)."""
    first = lambda c: F.min_by(c, F.struct("rank", "candidate_id"))
    return labelled.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("candidate_count"), F.bool_or(is_hit(F.col("distance"))).alias("any_hit"), first("candidate_id").alias("baseline_id"),
        first("label").alias("baseline_label"), first("distance").alias("baseline_distance"), first("hard_negative").alias("baseline_hard_negative"), *more,
    )


def frame_outcomes(truth: DataFrame, labelled: DataFrame) -> DataFrame:
    """A row for each annotated frame, those without candidates included.

    Coverage looks at any candidate, the baseline at the first by (rank, id); its hard-negative flag holds
    whether or not the ball is visible.
    """
    return outcomes(truth.select(*FRAME, "visible").join(frame_counts(labelled), FRAME, "left"))


def outcomes(rows: DataFrame) -> DataFrame:
    """The outcomes of frames with `visible` and their `frame_counts`, null where a frame has no candidates."""
    n = F.coalesce("candidate_count", F.lit(0)).cast("bigint")
    covered = F.col("visible") & F.coalesce("any_hit", F.lit(False))
    hit = F.col("visible") & is_hit(F.col("baseline_distance"))
    return rows.select(
        *FRAME, "visible", n.alias("candidate_count"), covered.alias("oracle_covered"), (F.col("visible") & (n == 0)).alias("visible_without_candidates"),
        (F.col("visible") & (n > 0) & ~covered).alias("visible_candidates_without_ball"), hit.alias("baseline_hit"),
        (F.col("visible") & F.coalesce(F.col("baseline_label") == "ball", F.lit(False))).alias("baseline_strict_hit"),
        (hit & F.coalesce(F.col("baseline_label") == "ignore", F.lit(False))).alias("baseline_ignore_hit"), F.coalesce("baseline_hard_negative", F.lit(False)).alias("baseline_hard_negative"),
    )


def summarized(outcomes: DataFrame) -> DataFrame:
    """Counts and ratios for every clip and, in the same pass, for all (`clip_id` 'all')."""
    count = lambda c: F.count_if(F.col(c)).alias(c)
    flags = ["visible", "oracle_covered", "visible_without_candidates", "visible_candidates_without_ball", "baseline_hit", "baseline_strict_hit", "baseline_ignore_hit", "baseline_hard_negative"]
    grouped = outcomes.groupingSets([["clip_id"], []], "clip_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("candidate_count").alias("candidates"), *[count(c) for c in flags], F.grouping("clip_id").alias("__all"))
    rows = grouped.withColumn("clip_id", F.when(F.col("__all") == 1, "all").otherwise(F.col("clip_id"))).drop("__all")
    return (rows.withColumn("oracle_recall", ratio(F.col("oracle_covered"), F.col("visible"))).withColumn("baseline_recall", ratio(F.col("baseline_hit"), F.col("visible")))
            .withColumn("baseline_strict_recall", ratio(F.col("baseline_strict_hit"), F.col("visible"))).withColumn("baseline_of_oracle", ratio(F.col("baseline_hit"), F.col("oracle_covered"))))


def first_ranks(labelled: DataFrame, radii: list[float], *more: Column) -> DataFrame:
    """For every frame with candidates, the first rank that hits within each radius, and `more` aggregates."""
    first = [F.min(F.when(F.col("distance") <= r, F.col("rank"))).alias(f"r{i}") for i, r in enumerate(radii)]
    return labelled.groupBy(*FRAME).agg(*first, *more)


def recall_at(labelled: DataFrame, truth: DataFrame, ks: list[int], radii: list[float]) -> DataFrame:
    """Recall for each radius and k: a frame counts if any of its first k candidates is within the radius.

    One aggregation keeps, for every frame and radius, the first rank that hits; the grid never multiplies rows.
    """
    return recall_of(truth.filter("visible").select(*FRAME).join(first_ranks(labelled, radii), FRAME, "left"), ks, radii)


def recall_of(seen: DataFrame, ks: list[int], radii: list[float]) -> DataFrame:
    """`recall_at` of visible frames with their `first_ranks`."""
    sums = [F.count_if(F.col(f"r{i}") <= k).alias(f"h{i}_{k}") for i in range(len(radii)) for k in ks]
    one = seen.agg(F.count(F.lit(1)).alias("visible"), *sums)
    cells = F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.lit(k).alias("k"), F.col(f"h{i}_{k}").alias("hits")) for i, r in enumerate(radii) for k in ks])
    return one.select("visible", F.inline(cells)).withColumn("recall", ratio(F.col("hits"), F.col("visible")))


def decomposed(labelled: DataFrame, truth: DataFrame, radius: float = 20.0, cap: int = 4) -> DataFrame:
    """Where the visible frames' balls are: first, within the cap, beyond, missed, or no candidate at all."""
    per = labelled.groupBy(*FRAME).agg(F.min(F.when(F.col("distance") <= radius, F.col("rank"))).alias("hit"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n").isNull(), "no_candidates").when(F.col("hit").isNull(), "missed").when(F.col("hit") == 1, "first").when(F.col("hit") <= cap, "within_cap").otherwise("beyond_cap")
    return truth.filter("visible").select(*FRAME).join(per, FRAME, "left").groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("frames"))


def category(label: Column, hard: Column, visible: Column, covered: Column) -> Column:
    """The sampler's category; the order of the cases matters and an unknown label raises."""
    return (F.when(label == "ball", "positive").when(label == "ignore", "ignore").when(label != "not_ball", F.raise_error(F.concat(F.lit("unknown label "), label)).cast("string"))
            .when(hard, "hard_negative").when(~visible, "invisible").when(covered, "same_frame").otherwise("visible_missing"))
