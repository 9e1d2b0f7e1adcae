"""Reports of runs: JSON documents checked for the keys and kinds they need, summaries of clips, nested rows of several tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that a tracking result needs, those of them that are objects, versions of the reports, the name of
# a run's clip, and the fields of a compact row of the threshold sweep.
REQUIRED = ("schema_version", "engine", "scorer_id", "configuration")
OBJECTS = ("engine", "configuration")
CLIP_VERSION, RESULT_VERSION, ANALYSIS_VERSION = 1, 1, 4
CLIP_NAME = "source_clip.mp4"
COMPACT = ("policy", "global_threshold", "local_threshold", "valid_total", "valid_visible", "valid_invisible", "false_positive_rate_invisible", "hits_at_20px",
           "precision_at_20px", "recall_at_20px", "f1_at_20px", "median_valid_error_px", "refined_prediction_count", "global_fallback_count")

#: What an analysis reads of the tables that it joins.
RUN = ("run_id", "video_id", "pipeline", "video_filename", "generated_at")
PROBED = ("frame_count", "duration_s", "fps", "width", "height")


def document(text: Column) -> Column:
    """JSON text as a variant; null for null, for text that isn't JSON and for an object that repeats a key."""
    return F.try_parse_json(text)


def field(doc: Column, key: str) -> Column:
    """A key's value as a variant; null only where the object lacks the key (a JSON null is a value)."""
    return F.try_variant_get(doc, f"$.{key}", "variant")


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def document_problem(doc: Column, required: Sequence[str] = REQUIRED, objects: Sequence[str] = OBJECTS) -> Column:
    """Why a document can't be used, or null: no object at all, then all keys that it lacks in the order asked for,
    then the first key whose value must be an object and isn't."""
    missing = F.array_compact(F.array(*[F.when(field(doc, k).isNull(), F.lit(k)) for k in required]))
    wrong = F.coalesce(F.lit(None).cast("string"), *[F.when(~_is_object(field(doc, k)), F.lit(f"not an object: {k}")) for k in objects])
    return F.when(~_is_object(doc), "not an object").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).otherwise(wrong)


def descriptor(doc: Column, required: Sequence[str] = REQUIRED, objects: Sequence[str] = OBJECTS) -> Column:
    """The required keys of a document as a struct of variants, nothing else; null where the document has a problem."""
    return F.when(document_problem(doc, required, objects).isNull(), F.struct(*[field(doc, k).alias(k) for k in required]))


def clip_report(runs: DataFrame, clips: DataFrame, extra: Sequence[str] = PROBED) -> DataFrame:
    """(run_id, clip): what was asked of each run's clip and what its file turned out to be.

    `runs` has run_id, video_id, video_filename, clip_start_s and clip_duration_s; `clips` has run_id, size_bytes and
    the probe's fields, of which absent ones are null. A run without a clip has no row.
    """
    probe = F.struct(F.round(F.col("size_bytes") / 1048576, 3).alias("size_mb"), *[F.col(c) if c in clips.columns else F.lit(None).cast("double").alias(c) for c in extra]).alias("__p")
    rows = runs.select("run_id", "video_id", "video_filename", "clip_start_s", "clip_duration_s").join(clips.select("run_id", probe), "run_id")
    clip = F.struct(F.lit(CLIP_VERSION).alias("schema_version"), "run_id", "video_id", F.col("video_filename").alias("source_video_filename"), F.lit(CLIP_NAME).alias("artifact"),
                    F.col("clip_start_s").alias("requested_start_s"), F.col("clip_duration_s").alias("requested_duration_s"), "__p.*")
    return rows.select("run_id", clip.alias("clip"))


def candidate_summaries(clips: DataFrame, candidates: DataFrame) -> DataFrame:
    """(clip_id, summary) for every row of `clips` (clip_id, analyzed: frames that were searched).

    Frames are counted by how many candidates they have, those without any as the rest, so no group holds a clip's
    frames. Without frames or candidates the figures are 0. Scores are summed as decimals, the same in any order.
    """
    score = F.col("score").cast("decimal(28,12)")
    frames = candidates.groupBy("clip_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("total"), F.max("score").alias("best"), F.count("score").alias("scored"))
    sizes = frames.groupBy("clip_id", "n").agg(F.count(F.lit(1)).alias("frames"), F.sum("total").alias("total"), F.max("best").alias("best"), F.sum("scored").alias("scored"))
    found = sizes.groupBy("clip_id").agg(F.sum("frames").alias("found"))
    empty = clips.join(found, "clip_id", "left").select("clip_id", F.lit(0).cast("long").alias("n"), F.greatest(F.col("analyzed") - F.coalesce("found", F.lit(0)), F.lit(0)).cast("long").alias("frames"))
    every = empty.unionByName(sizes.join(clips.select("clip_id"), "clip_id", "left_semi"), allowMissingColumns=True)
    per = every.groupBy("clip_id").agg(
        F.sum("frames").alias("analyzed"), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("frames"))), F.lit(0)).alias("held"), F.sum(F.col("n") * F.col("frames")).alias("candidates"), F.max("n").alias("most"),
        F.percentile("n", 0.5, F.col("frames")).alias("median"), F.try_divide(F.sum("total").cast("double"), F.sum("scored")).alias("mean_score"), F.max("best").alias("best"),
    )
    part = lambda a, b, d: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), d)
    zero = lambda c, d: F.round(F.coalesce(c, F.lit(0.0)), d)
    summary = F.struct(
        F.col("analyzed").alias("analyzed_frames"), F.col("held").alias("frames_with_candidates"), part("held", "analyzed", 6).alias("coverage_ratio"), F.col("candidates").alias("total_candidates"),
        part("candidates", "analyzed", 3).alias("mean_candidates_per_frame"), zero("median", 3).alias("median_candidates_per_frame"), F.col("most").alias("max_candidates_per_frame"),
        zero("mean_score", 6).alias("mean_candidate_score"), zero("best", 6).alias("max_candidate_score"),
    )
    return per.select("clip_id", summary.alias("summary"))


def track_summaries(clips: DataFrame, tracks: DataFrame, max_span: int, cuts: DataFrame | None = None) -> DataFrame:
    """(clip_id, summary) for every row of `clips`, of the tracks chosen in it (as `tracks.summaries` gives them, with
    clip_id) and of its scene cuts (clip_id, one row each). Clips without tracks have zeros."""
    mean = lambda c: F.try_divide(F.sum(F.col(c).cast("decimal(28,12)")).cast("double"), F.count(c))
    per = tracks.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("point_count").alias("points"), F.max("point_count").alias("most"), F.max("span_frames").alias("span"), F.max("score").alias("best"),
        mean("point_count").alias("mean_points"), mean("coverage_ratio").alias("mean_coverage"), F.percentile("mean_prediction_error", 0.5).alias("error"),
    )
    cut = (cuts if cuts is not None else clips.limit(0)).groupBy("clip_id").agg(F.count(F.lit(1)).alias("cuts"))
    rows = clips.select("clip_id").join(per, "clip_id", "left").join(cut, "clip_id", "left")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    zero = lambda c, d: F.round(F.coalesce(F.col(c), F.lit(0.0)), d)
    summary = F.struct(
        whole("n").alias("selected_tracks"), whole("points").alias("total_track_points"), whole("most").alias("longest_track_points"), whole("span").alias("longest_track_span_frames"), zero("best", 6).alias("best_track_score"),
        zero("mean_points", 3).alias("mean_selected_points"), zero("mean_coverage", 6).alias("mean_selected_coverage"), zero("error", 3).alias("median_prediction_error_px"),
        whole("cuts").alias("scene_cut_count"), F.lit(max_span).cast("long").alias("max_track_span_frames"),
    )
    return rows.select("clip_id", summary.alias("summary"))


def analyses(runs: DataFrame, videos: DataFrame, clips: DataFrame, candidates: DataFrame, tracks: DataFrame, tracking: DataFrame) -> DataFrame:
    """(run_id, report, problem) of every run: the report is one nested row; where a part is absent it is null and
    the problem names all absent parts.

    `runs` has the columns of RUN; `videos` video_id and some of PROBED (the rest is null, and so is all of an
    unknown video); `clips` run_id and clip as `clip_report` gives it; `candidates` and `tracks` run_id and summary;
    `tracking` run_id and descriptor. These five have one row for a key; runs may share a video in any number.
    """
    known = videos.select("video_id", F.struct(*[F.col(c) if c in videos.columns else F.lit(None).cast("double").alias(c) for c in PROBED]).alias("__video"))
    parts = {"clip": clips.select("run_id", "clip"), "candidates": candidates.select("run_id", F.col("summary").alias("candidates")), "tracks": tracks.select("run_id", F.col("summary").alias("tracks")), "tracking": tracking.select("run_id", F.col("descriptor").alias("tracking"))}
    rows = runs.select(*RUN).join(known, "video_id", "left")
    for part in parts.values():
        rows = rows.join(part, "run_id", "left")
    absent = F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in parts]))
    size = lambda of: F.struct(F.col(f"{of}.width").alias("width"), F.col(f"{of}.height").alias("height")).alias("resolution")
    report = F.struct(
        F.lit(ANALYSIS_VERSION).alias("schema_version"), "run_id", "video_id", "pipeline", "tracking", F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
        F.struct(F.col("video_filename").alias("filename"), "__video.frame_count", "__video.duration_s", "__video.fps", size("__video")).alias("source"),
        F.struct("clip.artifact", "clip.requested_start_s", "clip.requested_duration_s", F.col("clip.duration_s").alias("actual_duration_s"), "clip.frame_count", "clip.fps", size("clip")).alias("clip"),
        "candidates", F.col("tracks").alias("tracks_probe"),
    )
    problem = F.when(F.size(absent) > 0, F.concat(F.lit("absent: "), F.array_join(absent, ", ")))
    return rows.select("run_id", F.when(problem.isNull(), report).alias("report"), problem.alias("problem"))


def compact(rows: DataFrame, fields: Sequence[str] = COMPACT) -> Column:
    """The named fields of a row as a struct, in their order; a table that lacks one raises."""
    if missing := [f for f in fields if f not in rows.columns]:
        raise ValueError(f"fields missing: {', '.join(missing)}")
    return F.struct(*fields)
