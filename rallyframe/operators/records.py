"""Runs, artifacts, label files and reports: checks, state changes and decisions as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import slug
from . import scan

# The states of a run, what changes them, and the labels' numbers.
STATES = ("none", "created", "running", "completed", "failed", "deleted")
CHANGES = {("none", "create"): "created", ("created", "start"): "running", ("running", "complete"): "completed", ("running", "fail"): "failed",
           ("created", "delete"): "deleted", ("completed", "delete"): "deleted", ("failed", "delete"): "deleted"}
LABELS = {"ball": 1, "not_ball": 0, "ignore": -1}
# Names of a run's source clip, the best first.
SOURCE_NAMES = ("source_clip.mp4", "segment.mp4", "clip.mp4")
# What a run keeps of its video.
SNAPSHOT = ("id", "filename", "relative_path", "extension", "size_mb", "width", "height", "fps", "duration_s", "frame_count", "codec", "probe_error")


def label_number(label: Column) -> Column:
    """ball 1, not_ball 0, ignore -1; any other label, null too, raises."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int")
    return F.coalesce(F.try_element_at(known, F.coalesce(label, F.lit(""))), unknown)


def accepted(status: Column) -> Column:
    return F.coalesce(F.lower(F.trim(status)) == "accepted", F.lit(False))


def label_rows_problem(rows: DataFrame, run_id: str) -> str | None:
    """Why label rows aren't those of a run, or None. Only a count and two ids reach the driver."""
    if missing := sorted({"run_id", "track_id", "label"} - set(rows.columns)):
        return f"columns missing: {', '.join(missing)}"
    mine = F.coalesce(F.trim(F.col("run_id").cast("string")), F.lit(""))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(mine != run_id, mine)).alias("other")).first()
    return "no rows" if not seen["n"] else f"rows of another run: {seen['other'] or 'without an id'}" if seen["other"] is not None else None


def manifest_problem(label: Column, hard_negative: Column) -> Column:
    """Why a manifest row is refused, or null: a hard negative is a candidate that isn't the ball."""
    return F.when(~F.coalesce(label.isin(*LABELS), F.lit(False)), "label").when(F.coalesce(hard_negative, F.lit(False)) & (label != "not_ball"), "hard_negative")


def clip_range_problem(start: Column, duration: Column, source: Column, least: float = 1, most: float = 60, slack: float = 0.01) -> Column:
    """Why a part of a video can't be cut out, or null. A source without a positive duration doesn't bind."""
    known = source > 0
    return (F.when(start.isNull() | duration.isNull() | F.isnan(start) | F.isnan(duration), "not a number").when(start < 0, "negative start").when(duration < least, "too short").when(duration > most, "too long")
            .when(known & (start >= source), "starts after the end").when(known & (start + duration > source + slack), "ends after the end"))


def new_run_id(created: Column, filename: Column, token: Column, fold: bool = True) -> Column:
    """time_name_token: the file's name without its ending as a slug, and six characters that tell runs apart."""
    stem = F.regexp_replace(F.regexp_extract(filename, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.concat_ws("_", F.date_format(created, "yyyyMMdd'T'HHmmss"), slug(stem, fold=fold), F.substring(token, 1, 6))


def video_snapshot(videos: DataFrame) -> DataFrame:
    """The fields that a run keeps of its video; those that are absent are null, others don't go along."""
    return videos.select(*[F.col(c) if c in videos.columns else F.lit(None).cast("string").alias(c) for c in SNAPSHOT])


def run_history(events: DataFrame, run: str, order: str, event: str, block: int = 1000) -> DataFrame:
    """Add `before`, `refused` and `after` to every event of every run, in order of a number unique in its run.

    An event that the state at hand doesn't allow is refused and changes nothing. A block of events is a map from
    states to states; the maps of the blocks before are composed by a scan, so no group holds all events of a run.
    """
    at = {s: i for i, s in enumerate(STATES)}
    kinds = sorted({e for _, e in CHANGES})
    table = F.array(*[F.array(*[F.lit(at[CHANGES[s, e]] if (s, e) in CHANGES else -1) for e in kinds]) for s in STATES])
    kind = F.coalesce(F.array_position(F.array(*[F.lit(e) for e in kinds]), F.col(event)), F.lit(0)).cast("int") - 1
    to = lambda state, k: F.when(k >= 0, F.get(F.get(table, state), k)).otherwise(-1)
    step = lambda state, e: F.when(to(state, e["kind"]) >= 0, to(state, e["kind"])).otherwise(state)
    rows = events.withColumn("__block", F.floor(F.col(order) / block)).withColumn("__event", F.struct(F.col(order).alias("at"), kind.alias("kind"), F.struct(*events.columns).alias("row")))
    parts = rows.groupBy(run, F.col("__block").alias(scan.SPAN)).agg(F.array_sort(F.collect_list("__event")).alias("events"))
    every = F.array(*[F.lit(i) for i in range(len(STATES))])
    parts = parts.withColumn("map", F.transform(every, lambda s: F.aggregate("events", s, step)))
    carries = scan.before_spans(parts, run, "map", every, lambda first, then: F.transform(first, lambda s: F.get(then, s)))
    parts = scan.joined(parts, carries, run).withColumn("state", F.get("__before", F.lit(0)))
    none = F.expr("cast(array() as array<int>)")
    states = F.aggregate("events", F.struct(F.col("state").alias("s"), none.alias("out")), lambda acc, e: F.struct(step(acc["s"], e).alias("s"), F.array_append(acc["out"], acc["s"]).alias("out")))["out"]
    each = parts.select(F.inline(F.arrays_zip(F.col("events").alias("e"), states.alias("s"))))
    name = lambda s: F.get(F.array(*[F.lit(x) for x in STATES]), s)
    return each.select("e.row.*", name(F.col("s")).alias("before"), (to(F.col("s"), F.col("e.kind")) < 0).alias("refused"), name(step(F.col("s"), F.col("e"))).alias("after"))


def artifact_problem(wanted: DataFrame, runs: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, key, path, problem) for wanted (run_id, key, expected): the run's id must be a plain name and known,
    its `artifacts` must name the expected file, and the file (run_id, name) must be there."""
    known = runs.select("run_id", F.col("artifacts").alias("__artifacts"), F.lit(True).alias("__run"))
    there = files.select("run_id", F.col("name").alias("expected"), F.lit(True).alias("__file")).distinct()
    rows = wanted.join(known, "run_id", "left").join(there, ["run_id", "expected"], "left")
    plain = F.coalesce((F.col("run_id") != "") & ~F.col("run_id").isin(".", "..") & ~F.col("run_id").rlike(r"[/\\]"), F.lit(False))
    named = F.coalesce(F.try_element_at("__artifacts", F.col("key")) == F.col("expected"), F.lit(False))
    problem = F.when(~plain, "unsafe id").when(F.col("__run").isNull(), "unknown run").when(~named, "no reference").when(F.col("__file").isNull(), "no file")
    return rows.select("run_id", "key", F.when(problem.isNull(), F.concat_ws("/", "run_id", "expected")).alias("path"), problem.alias("problem"))


def source_clips(files: DataFrame, run: str = "run_id", name: str = "name") -> DataFrame:
    """The source clip of each run: a preferred name, else the only mp4 that isn't an overlay, else a problem."""
    n = F.col(name)
    place = F.array_position(F.array(*[F.lit(x) for x in SOURCE_NAMES]), n)
    other = n.endswith(".mp4") & ~n.startswith("overlay_")
    out = files.groupBy(run).agg(F.min_by(F.when(place > 0, n), F.when(place > 0, place)).alias("first"), F.count_if(other).alias("others"), F.min(F.when(other, n)).alias("other"))
    clip = F.coalesce("first", F.when(F.col("others") == 1, F.col("other")))
    return out.select(run, clip.alias("clip"), F.when(clip.isNull(), F.when(F.col("others") > 1, "ambiguous").otherwise("absent")).alias("problem"))


def best_videos(videos: DataFrame, by: str, least_s: float, name: str = "filename", duration: str = "duration_s", preferred: str = "reduced_fps.mp4", tie: str = "path") -> DataFrame:
    """One video of each group: long enough first, then the preferred name, then the longest, then the first path."""
    order = F.struct((F.col(duration) >= least_s).cast("int"), (F.lower(name) == preferred).cast("int"), F.col(duration))
    least = videos.groupBy(by).agg(F.max(order).alias("__order"))
    return videos.join(least, by).filter(order == F.col("__order")).groupBy(by).agg(F.min(tie).alias(tie))


def video_key(path: Column) -> tuple[Column, Column]:
    """Match and rally of a path of three parts below the data's root, null for extra files."""
    pattern = r"^([0-9]+)/(?:rallies_videos|videos_rallies)/([0-9]+)(?:\.[^./]*)?$"
    part = lambda i: F.when(path.rlike(pattern), F.regexp_extract(path, pattern, i).cast("int"))
    return part(1), part(2)


def resolved_paths(rows: DataFrame, files: DataFrame, bases: tuple[str, ...], raw: str = "raw") -> DataFrame:
    """Add `path`: the first base folder with the file, the raw path itself first; the raw path if none has it."""
    tries = F.array(F.struct(F.lit(0).alias("at"), F.col(raw).alias("path")), *[F.struct(F.lit(i).alias("at"), F.concat_ws("/", F.lit(b), F.col(raw)).alias("path")) for i, b in enumerate(bases, 1)])
    keyed = rows.select(raw).distinct().select(raw, F.inline(tries))
    found = keyed.join(files.select("path").distinct(), "path", "left_semi").groupBy(raw).agg(F.min_by("path", "at").alias("__path"))
    return rows.join(found, raw, "left").withColumn("path", F.coalesce("__path", F.col(raw))).drop("__path")


def with_fallback(rows: DataFrame, known: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Each field from the known table where that has a value, else as recomputed; `recomputed` counts these."""
    other = known.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = rows.join(other, key, "left")
    missing = [F.col(f"__{f}").isNull().cast("int") for f in fields]
    return joined.select(*[c for c in rows.columns if c not in fields], *[F.coalesce(f"__{f}", f).alias(f) for f in fields], sum(missing, F.lit(0)).alias("recomputed"))


def reconciled(left: DataFrame, right: DataFrame, keys: list[str], same: tuple[str, ...]) -> DataFrame:
    """Both tables over all keys: `side` (both, left, right), `differs` (the first of `same` that isn't equal) and
    `delta`, the distance of the places where both are visible and known."""
    a = left.select(*keys, F.struct(*[c for c in left.columns if c not in keys]).alias("l"))
    b = right.select(*keys, F.struct(*[c for c in right.columns if c not in keys]).alias("r"))
    rows = a.join(b, keys, "full")
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    differs = F.coalesce(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), c) for c in same])
    delta = F.when(F.col("l.visible") & F.col("r.visible"), F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y")))
    return rows.select(*keys, side.alias("side"), F.when(side == "both", differs).alias("differs"), F.when(side == "both", delta).alias("delta"))


def reconciled_or_error(left: DataFrame, right: DataFrame, keys: list[str], same: tuple[str, ...]) -> DataFrame:
    """`reconciled`, where a key on one side only or a difference is an error."""
    rows = reconciled(left, right, keys, same)
    wrong = F.when(F.col("side") != "both", F.concat(F.lit("only "), F.col("side"))).otherwise(F.concat(F.lit("differs: "), F.col("differs")))
    return rows.filter(F.when(wrong.isNull(), True).otherwise(F.raise_error(wrong).cast("boolean")))


def metric_deltas(final: DataFrame, base: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """final - base of each metric, null where either is; keys match null-safely and come from `final`."""
    other = base.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(m).alias(f"__{m}") for m in metrics])
    rows = final.join(other, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    return rows.select(*keys, *[F.round(F.col(m) - F.col(f"__{m}"), 9).alias(f"{m}_delta") for m in metrics])


def calibration_decision(gain: Column, fallback_gain: Column) -> Column:
    """Which of the two gains in f1 is worth acting on."""
    return F.when(gain >= 0.01, "calibration_useful_before_local_training").when(fallback_gain >= 0.005, "fallback_policy_useful_before_local_training").otherwise("legacy_local_already_near_calibrated")


def conservative(sweep: DataFrame, current_fp_rate: Column, precision: float = 0.90) -> DataFrame:
    """Combinations that keep the precision and raise no more false alarms than the current one."""
    return sweep.filter((F.col("precision") >= precision) & (F.col("fp_rate") <= current_fp_rate + 1e-12))


def training_success(isolated: Column, best_step: Column, loss_ratio: Column, recall_gain: Column, f1_gain: Column) -> Column:
    good = isolated & (best_step > 0) & (loss_ratio < 0.90) & (recall_gain >= 0.05) & (f1_gain >= 0.05)
    return F.coalesce(good, F.lit(False))


def best_checkpoints(rows: DataFrame, run: str, step: str = "step") -> DataFrame:
    """The checkpoint of each run with the greatest (f1, recall, -loss); the first of equal ones is kept."""
    order = F.struct("f1", "recall", (-F.col("loss")).alias("gain"), (-F.col(step)).alias("early"))
    return rows.groupBy(run).agg(F.max_by(F.struct(step, "f1", "recall", "loss"), order).alias("b")).select(run, "b.*")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of per-batch values by their number of rows; null without rows."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))
