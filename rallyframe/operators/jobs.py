"""Whole jobs as compositions: frames to candidates, candidates to tracks, both in a row, and the audit of labelled tracks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import ComponentLimits
from . import pixels, records, reports, tracklets, tracks

# The tables of a tracking job below its folder, with the columns that readers rely on.
ARTIFACTS = {
    "candidates": {"clip_id": "string", "candidate_id": "string", "frame": "bigint", "rank": "int", "time_s": "double", "x": "double", "y": "double", "area": "int", "score": "double"},
    "candidate_metrics": {"clip_id": "string", "summary": "struct"},
    "tracks": {"clip_id": "string", "track_id": "string", "point_index": "int", "candidate_id": "string", "frame": "bigint", "x": "double", "y": "double", "prediction_error": "double"},
    "track_metrics": {"clip_id": "string", "track_id": "string", "point_count": "bigint", "span_frames": "bigint", "score": "double"},
}


@dataclass(frozen=True)
class Tracking:
    """What a tracking job gives: candidates, their number in each frame, points of tracks and a summary of each track."""

    candidates: DataFrame
    counts: DataFrame
    points: DataFrame
    summaries: DataFrame


def found_candidates(frames: DataFrame, height: int, width: int, limits: ComponentLimits = ComponentLimits(), fps: float = 30.0, scorer: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Moving blobs of all frames that have both neighbours, ranked in their frame."""
    return pixels.detected(frames, height, width, limits, fps, scorer=scorer)


def frame_counts(frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of every frame, 0 included."""
    per = candidates.groupBy("clip_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    return frames.select("clip_id", "frame").join(per, ["clip_id", "frame"], "left").select("clip_id", "frame", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def found_tracks(candidates: DataFrame, config: tracklets.TrackConfig = tracklets.TrackConfig(), fps: float = 30.0) -> DataFrame:
    """Points of the tracks that the beam search finds and suppression keeps."""
    if "mean_brightness" in candidates.columns:
        candidates = candidates.withColumn("bright", F.col("mean_brightness"))
    candidates = candidates.withColumn("size", F.sqrt("area"))
    return tracklets.track_points(tracklets.selected(tracklets.hypotheses(candidates, config), config), fps)


def track_summaries(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row for each track of each clip; scores come from its candidates."""
    scores = candidates.select("clip_id", "candidate_id", "score")
    rows = points.join(scores, ["clip_id", "candidate_id"]).withColumn("track", F.concat_ws("/", "clip_id", "track_id")).withColumn("error", F.when(F.col("point_index") > 1, F.col("prediction_error")))
    return tracks.summaries(tracks.with_kinematics(rows, "track"), "track")


def tracked(frames: DataFrame, height: int, width: int, limits: ComponentLimits = ComponentLimits(), config: tracklets.TrackConfig = tracklets.TrackConfig(), fps: float = 30.0) -> Tracking:
    """Frames to summaries. Every part is a table of its own; writing one runs what it needs."""
    candidates = found_candidates(frames, height, width, limits, fps)
    points = found_tracks(candidates, config, fps)
    return Tracking(candidates, frame_counts(frames, candidates), points, track_summaries(points, candidates))


def audited(points: DataFrame, candidates: DataFrame, labels: DataFrame, run_id: str, last: tuple[str, ...] = ("candidate_id",), key: str = "track_id") -> tuple[DataFrame, DataFrame]:
    """Features of the labelled tracks of a run, and how well each separates balls from others. Labels of another run raise."""
    if problem := records.label_rows_problem(labels, run_id):
        raise ValueError(problem)
    rows = tracks.audit(points, candidates, last, key).join(labels.select(key, F.lower(F.trim("label")).alias("label")), key)
    return rows, tracks.separation(rows, "label", tracks.COMPARED + tracks.APPEARANCE)


@dataclass(frozen=True)
class Artifacts:
    """The tables of a tracking job in a folder that all executors share."""

    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.path(name))

    def schema_problems(self, spark: SparkSession) -> list[str]:
        """Tables that can't be read and columns that are absent or of another type; reads the tables' footers only."""
        found = []
        for name, columns in ARTIFACTS.items():
            try:
                types = dict(self.read(spark, name).dtypes)
            except AnalysisException as e:
                if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
                found.append(f"{name}: absent")
                continue
            found += [f"{name}: {c} is {types.get(c, 'absent')}" for c, kind in columns.items() if types.get(c, "").split("<")[0] != kind]
        return found

    def problems(self, spark: SparkSession) -> list[str]:
        """All that is wrong with the tables: their schemas or else their rows. Five counts reach the driver."""
        if schema := self.schema_problems(spark):
            return schema
        rows = row_problems(*[self.read(spark, name) for name in ARTIFACTS])
        return [f"{r.artifact}: {r.problem} ({r.n})" for r in rows.orderBy("artifact", "problem").collect()]


def row_problems(candidates: DataFrame, candidate_metrics: DataFrame, points: DataFrame, track_metrics: DataFrame) -> DataFrame:
    """(artifact, problem, n): how many rows of a job's tables contradict the others; no rows where all is well.

    Candidates and points are unique, every point names a candidate of its clip, and metrics count what is there.
    Metrics of clips or tracks without rows, and rows without metrics, count as different. Counts meet by key, so
    nothing holds a clip.
    """
    n = F.count(F.lit(1))
    per_point = points.groupBy("clip_id", "track_id", "point_index").agg(n.alias("n"))
    repeated = per_point.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("tracks").alias("artifact"), F.lit("repeated").alias("problem"), "n")
    # One count for both tables: a join would sort their names.
    names = ["clip_id", "candidate_id"]
    side = lambda rows, c, p: rows.select(*names, F.lit(c).alias("__c"), F.lit(p).alias("__p"))
    used = side(candidates, 1, 0).union(side(points, 0, 1)).groupBy(*names).agg(F.sum("__c").alias("__c"), F.sum("__p").alias("__p"))
    absent = (F.col("__c") == 0) | F.col("clip_id").isNull() | F.col("candidate_id").isNull()
    both = used.agg(F.coalesce(F.sum(F.when(F.col("__c") > 0, F.col("__c") - 1)), F.lit(0)).alias("again"), F.coalesce(F.sum(F.when(absent, F.col("__p"))), F.lit(0)).alias("unknown"))
    named = both.select(F.inline(F.array(F.struct(F.lit("candidates").alias("artifact"), F.lit("repeated").alias("problem"), F.col("again").alias("n")), F.struct(F.lit("tracks").alias("artifact"), F.lit("unknown candidate").alias("problem"), F.col("unknown").alias("n")))))

    def different(rows: DataFrame, keys: list[str], metrics: DataFrame, stated: Column, name: str) -> DataFrame:
        counted = rows.groupBy(*keys).agg(n.alias("__n"))
        both = counted.join(metrics.select(*keys, stated.alias("__stated")), keys, "full")
        return both.agg(F.count_if(F.coalesce("__n", F.lit(0)) != F.coalesce("__stated", F.lit(-1))).alias("n")).select(F.lit(name).alias("artifact"), F.lit("other count").alias("problem"), "n")

    # A clip may have no candidate; its metrics then say 0.
    clips = different(candidates, ["clip_id"], candidate_metrics, F.col("summary.total_candidates"), "candidate_metrics")
    paths = different(points, ["clip_id", "track_id"], track_metrics, F.col("point_count"), "track_metrics")
    every = named.union(repeated).union(clips).union(paths)
    return every.filter("n > 0")


@dataclass(frozen=True)
class TrackingJob:
    """A whole run over frames with its settings. A scorer of one's own is a function from candidates to a column and
    needs an id that isn't blank."""

    height: int
    width: int
    limits: ComponentLimits = field(default_factory=ComponentLimits)
    config: tracklets.TrackConfig = field(default_factory=tracklets.TrackConfig)
    fps: float = 30.0
    scorer: Callable[[DataFrame], Column] | None = None
    scorer_id: str = "heuristic_v1"
    engine: str = "rallyframe"
    version: int = 1

    def __post_init__(self) -> None:
        if not isinstance(self.scorer_id, str) or not self.scorer_id.strip():
            raise TypeError("a scorer needs an id")
        if min(self.height, self.width, self.fps) <= 0:
            raise ValueError(f"size and rate are positive: {self.height} x {self.width} at {self.fps}")

    def run(self, frames: DataFrame, folder: str) -> DataFrame:
        """Write the tables below `folder`, check them, and return (clip_id, result) with one nested row for each clip.

        `frames` has clip_id, frame and gray and is not changed. Each table is read back for the next one, so a lost
        executor costs one step. What is wrong with the tables raises; clips without candidates or tracks don't. An empty
        table of frames gives empty tables and no results.
        """
        spark, kept = frames.sparkSession, Artifacts(folder)
        frames = frames.withColumn("clip_id", F.col("clip_id").cast("string"))
        write = lambda rows, name: rows.write.mode("overwrite").parquet(kept.path(name))
        write(found_candidates(frames, self.height, self.width, self.limits, self.fps, self.scorer), "candidates")
        candidates = kept.read(spark, "candidates")
        clips = frames.groupBy("clip_id").agg(F.greatest(F.count(F.lit(1)) - 2, F.lit(0)).alias("analyzed"))
        write(reports.candidate_summaries(clips, candidates), "candidate_metrics")
        write(found_tracks(candidates, self.config, self.fps), "tracks")
        points = kept.read(spark, "tracks")
        of = lambda i: F.regexp_extract("track", "(?s)^(.*)/([^/]*)$", i)
        write(track_summaries(points, candidates).select(of(1).alias("clip_id"), of(2).alias("track_id"), "*").drop("track"), "track_metrics")
        if problems := kept.problems(spark):
            raise RuntimeError(f"tables of the tracking job: {'; '.join(problems)}")
        return self.results(frames, kept)

    def results(self, frames: DataFrame, kept: Artifacts) -> DataFrame:
        """(clip_id, result): what ran, with which settings, and the summaries of the written tables."""
        spark = frames.sparkSession
        first = kept.read(spark, "candidate_metrics").select("clip_id", F.col("summary").alias("candidates"))
        cuts = pixels.scene_cuts(frames).select("clip_id")
        second = reports.track_summaries(first, kept.read(spark, "track_metrics"), self.config.max_span_frames, cuts).select("clip_id", F.col("summary").alias("tracks"))
        fixed = lambda values: F.struct(*[F.lit(v).alias(k) for k, v in values.items()])
        result = F.struct(
            F.lit(reports.RESULT_VERSION).alias("schema_version"), F.lit("completed").alias("status"), fixed({"name": self.engine, "version": self.version}).alias("engine"), F.lit(self.scorer_id.strip()).alias("scorer_id"), "clip_id",
            F.lit(kept.folder).alias("output_dir"), F.struct(fixed(asdict(self.limits)).alias("candidates"), fixed(asdict(self.config)).alias("tracks")).alias("configuration"),
            F.struct("candidates", "tracks").alias("metrics"), fixed({name: name for name in ARTIFACTS}).alias("artifacts"),
        )
        return first.join(second, "clip_id").select("clip_id", result.alias("result"))
