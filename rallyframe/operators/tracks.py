"""Kinematics, features and windows of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import track_score, turn_degrees
from ..session import cut
from . import ranks
from .scan import SIZE, inside, with_halo, with_previous, with_running, with_smoothed

# The features that the audit compares.
COMPARED = ("point_count", "span_frames", "coverage_ratio", "net_displacement", "total_distance", "straightness", "median_speed", "max_speed", "speed_mad", "median_acceleration", "max_acceleration", "turns_over_45", "turns_over_90")
APPEARANCE = ("median_prediction_error", "median_area", "area_relative_mad", "median_elongation", "elongation_relative_mad", "median_brightness", "median_motion_strength", "median_fill_ratio", "median_circularity", "median_candidate_score")


def with_kinematics(points: DataFrame, key: str = "track_id", order: tuple[str, ...] = ("frame",), size: int = SIZE) -> DataFrame:
    """Add step, dt (1 at least), vx, vy, speed, acceleration (of velocities, not divided by time) and turn.

    A row needs the two before it; these come from its span or, at a span's start, from the spans before.
    """
    moved = with_previous(points, key, ("frame", "x", "y"), order, size)
    away = lambda c: F.col(c) - F.col(f"__one.{c}")
    back = lambda c: (F.col(f"__one.{c}") - F.col(f"__two.{c}")) / F.greatest(F.lit(1), F.col("__one.frame") - F.col("__two.frame"))
    moved = moved.withColumn("dt", F.greatest(F.lit(1), away("frame"))).withColumn("step", F.hypot(away("x"), away("y")))
    moved = moved.withColumn("vx", away("x") / F.col("dt")).withColumn("vy", away("y") / F.col("dt")).withColumn("speed", F.col("step") / F.col("dt"))
    moved = moved.withColumn("px", F.when(F.col("__two").isNotNull(), back("x"))).withColumn("py", F.when(F.col("__two").isNotNull(), back("y")))
    return moved.withColumn("acceleration", F.hypot(F.col("vx") - F.col("px"), F.col("vy") - F.col("py"))).withColumn("turn", turn_degrees(F.col("px"), F.col("py"), F.col("vx"), F.col("vy"))).drop("px", "py", "__one", "__two")


def median_of_deviations(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Median absolute deviation for each key: an aggregate, a join on the key, an aggregate."""
    centre = rows.groupBy(key).agg(F.percentile(value, 0.5).alias("__c"))
    return rows.join(centre, key).groupBy(key).agg(F.percentile(F.abs(F.col(value) - F.col("__c")), 0.5).alias("mad"), F.first("__c").alias("centre"))


def features(points: DataFrame, key: str = "track_id") -> DataFrame:
    """One row of motion features a track; without steps they are 0. Steps are found once and stored."""
    moved = cut(with_kinematics(points, key).select(key, "frame", "x", "y", "step", "speed", "acceleration", "turn"))
    end = lambda f, c: f(c, "frame")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = moved.groupBy(key).agg(
        F.count(F.lit(1)).alias("point_count"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.hypot(end(F.max_by, "x") - end(F.min_by, "x"), end(F.max_by, "y") - end(F.min_by, "y")).alias("net"), zero(F.sum("step")).alias("total"), zero(F.percentile("speed", 0.5)).alias("median_speed"),
        zero(F.max("speed")).alias("max_speed"), zero(F.percentile("acceleration", 0.5)).alias("median_acceleration"), zero(F.max("acceleration")).alias("max_acceleration"),
        F.count_if(F.col("turn") >= 45).alias("turns_over_45"), F.count_if(F.col("turn") >= 90).alias("turns_over_90"),
    )
    spread = median_of_deviations(moved.filter("speed is not null").select(key, "speed"), key, "speed").select(key, F.col("mad").alias("speed_mad"))
    span = F.col("last_frame") - F.col("first_frame") + 1
    r = lambda c, d=6: F.round(c, d)
    return per.join(spread, key, "left").select(
        key, "point_count", "first_frame", "last_frame", span.alias("span_frames"), r(F.col("point_count") / span).alias("coverage_ratio"), r(F.col("net"), 4).alias("net_displacement"), r(F.col("total"), 4).alias("total_distance"),
        r(F.coalesce(F.try_divide("net", "total"), F.lit(0.0))).alias("straightness"), r(F.col("median_speed")).alias("median_speed"), r(F.col("max_speed")).alias("max_speed"), r(F.coalesce("speed_mad", F.lit(0.0))).alias("speed_mad"),
        r(F.col("median_acceleration")).alias("median_acceleration"), r(F.col("max_acceleration")).alias("max_acceleration"), "turns_over_45", "turns_over_90",
    )


def appearance(points: DataFrame, candidates: DataFrame, last: tuple[str, ...], key: str = "track_id") -> DataFrame:
    """Ten medians a track: of its points' prediction errors and of the candidates that the points name.

    Of a repeated candidate_id the row that is last by `last` counts. Points without a candidate add to the
    errors only; values that aren't finite numbers are 0; a box without width or height has no elongation.
    Scores have six digits, so their median keeps seven. Points meet their candidates once and are stored.
    """
    named = {"area": "area", "brightness": "bright", "motion_strength": "motion", "fill_ratio": "fill", "circularity": "circ", "candidate_score": "score", "width": "width", "height": "height"}

    def number(c):
        v = F.coalesce(c.try_cast("double"), F.lit(0.0))
        return F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)

    latest = candidates.groupBy("candidate_id").agg(F.max_by(F.struct(*[number(F.col(c)).alias(n) for n, c in named.items()]), F.struct(*last)).alias("c"))
    rows = points.select(key, "candidate_id", number(F.col("prediction_error")).alias("prediction_error")).join(latest, "candidate_id", "left").select(key, "prediction_error", "c.*")
    rows = rows.withColumn("elongation", F.when((F.col("width") > 0) & (F.col("height") > 0), F.greatest(F.col("width") / F.col("height"), F.col("height") / F.col("width")))).drop("width", "height")
    rows = cut(rows)
    centre = rows.groupBy(key).agg(*[F.coalesce(F.percentile(c, 0.5), F.lit(0.0)).alias(f"median_{c}") for c in rows.columns if c != key])
    off = lambda c: F.percentile(F.abs(F.col(c) - F.col(f"median_{c}")), 0.5).alias(f"{c}_mad")
    spread = rows.join(centre, key).groupBy(key).agg(off("area"), off("elongation"))
    relative = lambda c: F.when(F.abs(F.col(f"median_{c}")) > 1e-9, F.col(f"{c}_mad") / F.abs(F.col(f"median_{c}"))).otherwise(0.0).alias(f"{c}_relative_mad")
    return centre.join(spread, key).select("*", relative("area"), relative("elongation")).select(key, *[F.round(c, 7 if c == "median_candidate_score" else 6).alias(c) for c in APPEARANCE])


def audit(points: DataFrame, candidates: DataFrame, last: tuple[str, ...], key: str = "track_id") -> DataFrame:
    """All features of a track: those of its motion and those of its candidates."""
    return features(points, key).join(appearance(points, candidates, last, key), key)


def separation(per_track: DataFrame, label: str, names: tuple[str, ...] = COMPARED) -> DataFrame:
    """Difference of the two labels' medians over the joint interquartile range, for every feature. Tracks are stored,
    and no task holds a feature's values."""
    kept = cut(per_track.filter(F.col(label).isin("ball", "not_ball")).select(F.col(label).alias("__label"), *names))
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    long = kept.select("__label", F.inline(pairs))
    groups = long.withColumn("__group", F.explode(F.array("__label", F.lit("every"))))
    found = ranks.percentiles(groups, ["feature", "__group"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    of = lambda name: F.coalesce(F.max(F.when(F.col("__group") == name, F.col("q2"))), F.lit(0.0))
    iqr = F.max(F.when(F.col("__group") == "every", F.col("q3") - F.col("q1")))
    out = long.select("feature").distinct().join(found, "feature", "left").groupBy("feature").agg(of("ball").alias("ball_median"), of("not_ball").alias("not_ball_median"), iqr.alias("iqr"))
    gap = (F.col("ball_median") - F.col("not_ball_median")) / F.greatest(F.col("iqr"), F.lit(1e-9))
    return out.select("feature", F.round("ball_median", 6).alias("ball_median"), F.round("not_ball_median", 6).alias("not_ball_median"), F.round(gap, 6).alias("robust_separation"))


def summaries(points: DataFrame, key: str = "track_id") -> DataFrame:
    """Track summary and final score. Error and acceleration means leave out each track's first point."""
    steps = with_previous(points, key, ("frame", "x", "y"))
    steps = steps.withColumn("step", F.hypot(F.col("x") - F.col("__one.x"), F.col("y") - F.col("__one.y"))).withColumn("gap", F.greatest(F.lit(0), F.col("frame") - F.col("__one.frame") - 1))
    mean = lambda c: F.sum(F.col(c).cast("decimal(28,12)")).cast("double") / F.count(c)  # noqa: E731  the same in any order of rows
    per = steps.groupBy(key).agg(
        F.count(F.lit(1)).alias("point_count"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.coalesce(F.sum("gap"), F.lit(0)).cast("bigint").alias("gap_frames"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("distance"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("speed"), mean("score").alias("mean_score"), F.coalesce(mean("error"), F.lit(0.0)).alias("mean_error"), F.coalesce(mean("acceleration"), F.lit(0.0)).alias("mean_acceleration"),
    )
    span = F.col("last_frame") - F.col("first_frame") + 1
    coverage = F.col("point_count") / F.greatest(span, F.lit(1))
    score = track_score(F.col("mean_score"), coverage, F.col("point_count"), F.col("speed"), F.col("mean_error"), F.col("mean_acceleration"), F.col("gap_frames"))
    r = F.round
    return per.select(key, "point_count", "first_frame", "last_frame", span.alias("span_frames"), r(coverage, 6).alias("coverage_ratio"), "gap_frames", r("distance", 3).alias("total_distance"), r("speed", 3).alias("mean_speed"), r("mean_score", 6).alias("mean_candidate_score"), r("mean_error", 3).alias("mean_prediction_error"), r("mean_acceleration", 3).alias("mean_acceleration"), r(score, 6).alias("score"))


def links(candidates: DataFrame, max_gap: int = 2, max_jump: float = 58.0, cuts: DataFrame | None = None) -> DataFrame:
    """Pairs of the same clip, 1 to max_gap + 1 frames apart, with a limited jump a frame and no cut between.

    The interval join becomes an equi-join: each candidate is sent to the frames that it may link to, so rows
    grow by the gap and not with the clip. Cuts become a running segment number, equal on both sides, counted
    by span.
    """
    if cuts is not None:
        marks = cuts.select("clip_id", "frame").distinct().withColumn("__kind", F.lit(0))
        rows = candidates.withColumn("__kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
        counted = with_running(rows, "clip_id", {"segment": (F.col("__kind") == 0).cast("long")}, ("frame", "__kind"))
        candidates = counted.filter("__kind = 1").drop("__kind")
    else:
        candidates = candidates.withColumn("segment", F.lit(0))
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in candidates.columns if c not in ("clip_id", "segment")]
    left = candidates.select("clip_id", "segment", *side("a"), F.explode(F.sequence(F.col("frame") + 1, F.col("frame") + max_gap + 1)).alias("b_frame"))
    right = candidates.select("clip_id", "segment", *side("b"))
    both = left.join(right, ["clip_id", "segment", "b_frame"])
    jump = F.hypot(F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y"))
    return both.withColumn("frame_delta", F.col("b_frame") - F.col("a_frame")).withColumn("jump", jump).filter(F.col("jump") / F.col("frame_delta") <= max_jump)


#: Rows that hold one item and meet in one place of a task.
DEALT = 1 << 16
#: Equal sets of a group that travel in one row.
ALIKE = 128


def overlaps(members: DataFrame, set_key: str, item: str, within: str, least: float = 0.65) -> DataFrame:
    """Pairs of sets in the same group whose shared items are at least a part of the smaller set.

    Equal sets of a group are one row, ALIKE at most: rows are compared, and the pairs of their sets come out of the
    place where two rows meet, without passing a shuffle. A set of n items that shares p of them has a shared one among
    any n - p + 1 of its own: only the rarest of the smaller set's items look for partners. Rows travel with their
    items, and a pair is taken only at the first of these items that both have. Items are also bits of a number, in
    which most pairs are decided; where two items of a group have the same bit, the items are compared.
    The rows of an item meet in a square of places. Its side follows the item's share of all pairs and the number of
    tasks, so rows are copied as often as the tasks need it and not as often as there are rows; only above DEALT rows
    an item is divided further, as a place holds no more.
    """
    spark = members.sparkSession
    whole = dict(members.dtypes)[item] in ("tinyint", "smallint", "int", "bigint")
    bit = F.pmod(F.col(item) if whole else F.xxhash64(item), F.lit(64)).cast("int").alias("__bit")
    given = members.select(within, set_key, item).where(F.col(within).isNotNull() & F.col(set_key).isNotNull() & F.col(item).isNotNull())
    listed = given.repartition(within, set_key).distinct().groupBy(within, set_key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    place = F.row_number().over(Window.partitionBy(within, "items").orderBy(set_key)) - 1
    alike = listed.withColumn("__part", F.floor(place / ALIKE)).groupBy(within, "items", "__part").agg(F.min(set_key).alias("s"), F.collect_list(set_key).alias("of")).drop("__part")
    each = alike.select(within, "s", F.explode("items").alias(item))
    often = each.groupBy(within, item).agg(F.count(F.lit(1)).alias("__often"))
    bits = often.select(within, item, bit).groupBy(within, "__bit").agg((F.min(item) == F.max(item)).alias("__alone"))
    # Far more pairs come out than rows go in, so the number of tasks isn't left to the size of what goes in.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    every = often.agg(F.sum(F.col("__often").cast("double") ** 2).alias("__pairs"))
    side = F.greatest(F.ceil(F.col("__often") / DEALT), F.least("__often", F.ceil(F.col("__often") * F.sqrt(4 * tasks / F.col("__pairs"))))).cast("int")
    known = often.withColumn("__bit", bit).join(bits, [within, "__bit"]).crossJoin(F.broadcast(every))
    one = F.struct(F.col("__often").alias("often"), F.col(item).alias("item"), F.expr("shiftleft(1L, __bit)").alias("bit"), F.col("__alone").alias("alone"), side.alias("side"))
    ordered = each.join(known, [within, item]).groupBy(within, "s").agg(F.array_sort(F.collect_list(one)).alias("l"))
    mask = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(x["bit"]))
    size = F.size("l")
    sets = ordered.join(alike.select(within, "s", "of"), [within, "s"])
    sets = sets.select(within, "s", "of", "l", size.alias("n"), mask(F.col("l")).alias("bits"), F.transform("l", lambda x: x["item"]).alias("items"), F.forall("l", lambda x: x["alone"]).alias("alone"), (size - F.ceil(F.lit(least - 1e-6) * size) + 1).cast("int").alias("looks"))
    head = F.slice("l", 1, F.col("looks"))
    seeks = sets.select(within, "s", F.col("of").alias("os"), F.col("n").alias("ns"), F.col("bits").alias("bs"), F.col("items").alias("is"), "alone", F.inline(F.transform(head, lambda x, i: F.struct(x["item"].alias(item), x["side"].alias("__side"), i.alias("__at"), mask(F.slice("l", 1, i)).alias("__before")))))
    meets = sets.select(within, F.col("s").alias("t"), F.col("of").alias("ot"), F.col("n").alias("nt"), F.col("bits").alias("bt"), F.col("items").alias("it"), F.inline(F.transform("l", lambda x: F.struct(x["item"].alias(item), x["side"].alias("__side")))))
    own = lambda c: F.pmod(F.xxhash64(c), F.col("__side")).cast("int")
    every_place = F.explode(F.sequence(F.lit(0), F.col("__side") - 1))
    seeks = seeks.withColumn("__row", own("s")).withColumn("__column", every_place).drop("__side")
    meets = meets.withColumn("__column", own("t")).withColumn("__row", every_place).drop("__side")
    keys = [within, item, "__row", "__column"]
    both = seeks.repartition(tasks, *keys).hint("merge").join(meets.repartition(tasks, *keys), keys)
    both = both.where((F.col("ns") < F.col("nt")) | ((F.col("ns") == F.col("nt")) & ((F.col("s") < F.col("t")) | ((F.col("s") == F.col("t")) & (F.size("os") > 1)))))
    at_most = F.col("ns") - F.bit_count(F.col("bs").bitwiseAND(F.bitwise_not("bt")))
    first = F.when(F.col("alone"), F.col("__before").bitwiseAND(F.col("bt")) == 0).otherwise(~F.arrays_overlap(F.slice("is", 1, F.col("__at")), F.col("it")))
    shared = F.when(F.col("alone"), at_most).otherwise(F.size(F.array_intersect("is", "it"))).cast("bigint")
    enough = at_most >= (least - 1e-6) * F.col("ns")
    pairs = both.where(enough).where(first).select(within, (F.col("s") == F.col("t")).alias("__same"), "os", "ot", shared.alias("shared"), "ns")
    pairs = pairs.withColumn("overlap", F.round(F.col("shared") / F.col("ns"), 6)).filter(F.col("overlap") >= least)
    # Each set of the one row with those of the other.
    found = pairs.select(within, "__same", "ot", "shared", "overlap", F.explode("os").alias("__a"))
    others = F.when(F.col("__same"), F.filter("ot", lambda y: y > F.col("__a"))).otherwise(F.col("ot"))
    found = found.select(within, "shared", "overlap", "__a", others.alias("__others")).withColumn("__b", F.explode("__others"))
    return found.select(within, F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"), "shared", "overlap")


def triplets(frames: DataFrame, key: str = "clip_id") -> DataFrame:
    """Whether the frames just before and after are there."""
    w = inside(key, "frame")
    before, after = F.lag("frame").over(w) == F.col("frame") - 1, F.lead("frame").over(w) == F.col("frame") + 1
    seen = with_halo(frames, before=1, after=1).withColumn("has_before", F.coalesce(before, F.lit(False))).withColumn("has_after", F.coalesce(after, F.lit(False)))
    return seen.where("__own").drop("__own", "__span").withColumn("triplet", F.col("has_before") & F.col("has_after"))


def trails(points: DataFrame, frames: int = 12, key: str = "track_id") -> DataFrame:
    """Number and mean place of a track's points in the last `frames` frames.

    Places count in ten-thousandths, so sums are exact in any order; means are rounded half up to six digits.
    """
    w = inside(key, "frame").rangeBetween(-(frames - 1), 0)
    rows = with_halo(points, before=frames - 1, size=max(SIZE, frames)).select(key, "frame", "__own", F.count(F.lit(1)).over(w).alias("trail_points"), *[v.over(w).alias(f"__{c}{v_}") for c in ("x", "y") for v_, v in (("n", F.count(c)), ("s", F.sum(F.round(F.col(c) * 10_000).cast("bigint"))))]).where("__own")

    def mean(c: str) -> Column:
        doubled, n = F.expr(f"200 * __{c}s + __{c}n"), F.expr(f"nullif(2 * __{c}n, 0)")
        return ((doubled - F.pmod(doubled, n)) / n / 1e6).alias(f"trail_{c}")

    return rows.select(key, "frame", "trail_points", mean("x"), mean("y"))


def smoothed(points: DataFrame, alpha: float = 0.72, max_gap: int = 4, max_jump: float = 230.4, key: str = "track_id", reach: int = 60, size: int = SIZE) -> DataFrame:
    """Exponential smoothing that restarts after a gap or a jump; `session` counts the restarts."""
    rows = with_previous(points.select(key, "frame", "x", "y"), key, ("frame", "x", "y"), size=size)
    far = F.hypot(F.col("x") - F.col("__one.x"), F.col("y") - F.col("__one.y")) > max_jump
    fresh = F.col("__one.frame").isNull() | (F.col("frame") - F.col("__one.frame") > max_gap) | far
    out = with_smoothed(rows.withColumn("__fresh", fresh), key, "__fresh", ("x", "y"), alpha, reach=reach, size=size)
    return out.select(key, "frame", "session", F.round("smooth_x", 6).alias("smooth_x"), F.round("smooth_y", 6).alias("smooth_y"))


def trail_age(fps: float) -> int:
    """Frames after which a point leaves the trail."""
    return max(10, round(1.35 * fps))


def smoothed_trails(points: DataFrame, age: int, alpha: float = 0.72, max_gap: int = 4, max_jump: float = 230.4, key: str = "track_id", size: int = SIZE) -> DataFrame:
    """`smoothed` with `trail`: the session's points (frame, x, y) up to each point that are at most `age` frames old."""
    rows = smoothed(points, alpha, max_gap, max_jump, key, size=size)
    point = F.struct("frame", F.col("smooth_x").alias("x"), F.col("smooth_y").alias("y"), "session")
    near = F.collect_list(point).over(inside(key, "frame").rangeBetween(-age, 0))
    held = with_halo(rows, before=age, size=max(size, age)).withColumn("__near", near).where("__own")
    own = F.transform(F.filter("__near", lambda p: p["session"] == F.col("session")), lambda p: F.struct(p["frame"], p["x"], p["y"]))
    return held.select(key, "frame", "session", "smooth_x", "smooth_y", F.array_sort(own).alias("trail"))


def best_window(rows: DataFrame, size: int, key: str, order: str, value: str, span: int = SIZE) -> DataFrame:
    """The start of the full window of `size` rows with the greatest mean, the earliest on ties.

    Means are differences of running sums, so the work doesn't grow with the window. Sums are exact on fifteen
    decimals; a window with a null has the mean of its other values.
    """
    number = F.col(value).cast("decimal(38,15)")
    sums = {"__place": F.lit(1).cast("long"), "__held": F.col(value).isNotNull().cast("long"), "__sum": F.coalesce(number, F.lit(0).cast("decimal(38,15)"))}
    run = with_running(rows.select(key, order, value), key, sums, (order,), span)
    first = run.select(key, F.col(order).alias("__start"), "__place", (F.col("__held") - F.col(value).isNotNull().cast("long")).alias("__h0"), (F.col("__sum") - F.coalesce(number, F.lit(0))).alias("__s0"))
    last = run.select(key, (F.col("__place") - size + 1).alias("__place"), "__held", "__sum")
    mean = F.round(F.try_divide((F.col("__sum") - F.col("__s0")).cast("double"), (F.col("__held") - F.col("__h0")).cast("double")), 6)
    full = first.join(last, [key, "__place"]).select(key, F.col("__start").alias(order), mean.alias("mean"))
    best = full.groupBy(key).agg(F.max(F.struct(F.col("mean"), (-F.col(order)).alias("o"))).alias("b"))
    return best.select(key, (-F.col("b.o")).alias("start"), F.col("b.mean").alias("best_mean"))


def histories(frames: DataFrame, length: int = 9, key: str = "clip_id") -> DataFrame:
    """Frames with their `length - 1` direct predecessors, oldest first; others have no row."""
    w = inside(key, "frame").rowsBetween(-(length - 1), 0)
    rows = with_halo(frames, before=length - 1, size=max(SIZE, length)).select(key, "frame", "__own", F.collect_list("frame").over(w).alias("history"))
    return rows.filter("__own").drop("__own").filter((F.size("history") == length) & (F.get("history", 0) == F.col("frame") - (length - 1)))


def islands(rows: DataFrame, key: str, order: str, flag: str, span: int = 4096) -> DataFrame:
    """Longest run of true and of false for each key (gaps and islands), rows with a null flag left out.

    Runs are found inside spans of the numeric order. Only a span's first and last run can go on in the next one:
    these, two a span, are joined over the whole key.
    """
    rows = rows.filter(F.col(flag).isNotNull()).withColumn("__span", F.floor(F.col(order) / span))
    w = Window.partitionBy(key, "__span").orderBy(order)
    group = F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, "__span", flag).orderBy(order))
    runs = rows.withColumn("__g", group).groupBy(key, "__span", flag, "__g").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__from"))
    inside = Window.partitionBy(key, "__span")
    runs = runs.withColumn("__first", F.col("__from") == F.min("__from").over(inside)).withColumn("__last", F.col("__from") == F.max("__from").over(inside))
    edge = F.col("__first") | F.col("__last")
    line = Window.partitionBy(key).orderBy("__from")
    goes_on = F.col("__first") & F.lag("__last").over(line) & (F.lag(flag).over(line) == F.col(flag))
    edges = runs.filter(edge).withColumn("__on", F.coalesce(goes_on, F.lit(False)))
    joined = edges.withColumn("__run", F.count_if(~F.col("__on")).over(line.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, flag, "__run").agg(F.sum("n").alias("n"))
    whole = joined.select(key, flag, "n").union(runs.filter(~edge).select(key, flag, "n"))
    longest = lambda v: F.coalesce(F.max(F.when(F.col(flag) == v, F.col("n"))), F.lit(0))
    return whole.groupBy(key).agg(longest(True).alias("longest_true"), longest(False).alias("longest_false"))


def neighbours(candidates: DataFrame, radii: tuple[int, ...] = (20, 40, 80)) -> DataFrame:
    """Other candidates of the frame within each radius, and the nearest one's distance."""
    a = candidates.select("clip_id", "frame", "candidate_id", "x", "y")
    b = a.select("clip_id", "frame", F.col("candidate_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    d = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    pairs = a.join(b, ["clip_id", "frame"]).withColumn("d", F.when(F.col("other") != F.col("candidate_id"), d))
    return pairs.groupBy("clip_id", "frame", "candidate_id").agg(*[F.count_if(F.col("d") <= r).alias(f"within_{r}") for r in radii], F.round(F.min("d"), 6).alias("nearest"))


def _offsets(steps: int) -> tuple[Column, Column]:
    """Neighbours (i, j) of a cell of 1/steps of the radius: those whose every point lies within the radius of the
    cell's every point, and those of which some may."""
    around = [(i, j) for i in range(-steps - 1, steps + 2) for j in range(-steps - 1, steps + 2)]
    sure = [(i, j) for i, j in around if (abs(i) + 1) ** 2 + (abs(j) + 1) ** 2 < steps**2]
    rim = [(i, j) for i, j in around if (i, j) not in sure and max(abs(i) - 1, 0) ** 2 + max(abs(j) - 1, 0) ** 2 <= steps**2]
    listed = lambda cells: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in cells])
    return listed(sure), listed(rim)


#: Candidates of a tile and its margin up to which pairs are measured; beyond, frames are kept as bits.
FULL = 1024


def occupancy(candidates: DataFrame, radius: int = 20, steps: int = 4, tile: int = 8, full: int = FULL) -> DataFrame:
    """For every candidate, in how many other frames of its clip some candidate lies within the radius.

    The image is cut into tiles of `tile` radii, which also get the candidates that lie at most a radius outside. Where
    a tile holds up to `full` of them, all its pairs are measured: only the few near a tile's edge are sent twice. Fuller
    tiles, as those of a still camera or of a long clip, go by `_by_bits`. A candidate without a place has none near it.
    """
    a = candidates.select("clip_id", "frame", "candidate_id", "x", "y")
    side = tile * radius
    at = lambda c: F.coalesce(F.floor(F.col(c) / side), F.lit(-(2**62)))
    low, high = lambda c: F.floor((F.col(c) - radius) / side), lambda c: F.floor((F.col(c) + radius) / side)
    held = a.withColumn("__tx", at("x")).withColumn("__ty", at("y"))
    reach = F.flatten(F.transform(F.sequence(low("x"), high("x")), lambda i: F.transform(F.sequence(low("y"), high("y")), lambda j: F.struct(i.alias("__tx"), j.alias("__ty")))))
    sent = a.where("x is not null and y is not null").select("clip_id", F.col("frame").alias("of"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.inline(reach))
    place = ["clip_id", "__tx", "__ty"]
    crowds = sent.groupBy(*place).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > full).select(*place, F.lit(True).alias("__crowd"))
    crowds = cut(crowds)
    crowded = not crowds.isEmpty()
    some = held.join(crowds, place, "left_anti") if crowded else held
    thin = sent.join(crowds, place, "left_anti") if crowded else sent
    near = (F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= radius) & (F.col("frame") != F.col("of"))
    pairs = some.join(thin.hint("merge"), place, "left").groupBy(*place, "frame", "candidate_id").agg(F.count_distinct(F.when(near, F.col("of"))).alias("n"))
    counted = pairs.select("clip_id", "frame", "candidate_id", "n")
    if crowded:
        counted = counted.union(_by_bits(held.join(crowds, place, "left_semi").drop("__tx", "__ty"), sent.join(crowds, place, "left_semi").select("clip_id", F.col("of").alias("frame"), F.col("ox").alias("x"), F.col("oy").alias("y")).distinct(), radius, steps))
    total = candidates.groupBy("clip_id").agg((F.count_distinct("frame") - 1).alias("others"))
    out = counted.join(total, "clip_id")
    n = F.col("n")
    return out.select("clip_id", "frame", "candidate_id", n.alias("frames_near"), F.round(F.coalesce(F.try_divide(n, F.col("others")), F.lit(0.0)), 9).alias("occupancy"))


def _by_bits(a: DataFrame, others: DataFrame, radius: int, steps: int) -> DataFrame:
    """(clip_id, frame, candidate_id, n): in how many other frames one of `others`, which hold `a` too, lies near.

    Space is cut into cells of 1/steps of the radius, and the frames of a cell are kept as bits, 64 to a number. The
    cells that surely lie within the radius are joined by bitwise or, once for a cell and not for a candidate: where
    a still camera fills a cell with every frame, there are as many bits and no pairs. Distances are measured only on
    the rim, and only for frames that the bits don't hold yet.
    """
    sure, rim = _offsets(steps)
    cell = lambda c: F.floor(F.col(c) * steps / radius)
    a, others = (t.withColumn("cx", cell("x")).withColumn("cy", cell("y")) for t in (a, others))
    word = F.floor(F.col("frame") / 64).alias("word")
    bit = F.expr("shiftleft(1L, cast(pmod(frame, 64) as int))").alias("bit")
    place = ["clip_id", "cx", "cy"]
    held = others.groupBy(*place, word).agg(F.bit_or(bit).alias("bits"))
    cells = a.select(*place).distinct()

    def sent(rows: DataFrame, offsets: Column) -> DataFrame:
        """Rows to the occupied cells around theirs."""
        keep = [c for c in rows.columns if c not in place]
        moved = rows.select("*", F.inline(offsets)).select("clip_id", (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"), *keep)
        return moved.join(cells, place, "left_semi")

    core = sent(held, sure).groupBy(*place, "word").agg(F.bit_or("bits").alias("core"))
    inside_core = core.groupBy(*place).agg(F.sum(F.bit_count("core")).alias("__core"))
    far = sent(others.select(*place, "frame", F.col("x").alias("ox"), F.col("y").alias("oy"), word, bit), rim).join(core, [*place, "word"], "left")
    fresh = far.where(F.coalesce(F.col("core").bitwiseAND(F.col("bit")), F.lit(0)) == 0).select(*place, F.col("frame").alias("of"), "ox", "oy")
    near = a.join(fresh, place).filter(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= radius)
    counted = near.groupBy("clip_id", "frame", "candidate_id").agg(F.count_distinct("of").alias("__rim"))
    out = a.join(inside_core, place).join(counted, ["clip_id", "frame", "candidate_id"], "left")
    return out.select("clip_id", "frame", "candidate_id", (F.col("__core") - 1 + F.coalesce("__rim", F.lit(0))).alias("n"))
