"""Files in and out: listings, delimited text, JSON documents, archives, tensors and run folders."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import stable_id, to_double

# File endings of videos, folders that a search leaves out, columns of candidate files.
VIDEO_ENDINGS = ("mp4", "avi", "mov", "mkv", "m4v", "webm")
SKIPPED_FOLDERS = (".git", ".venv", "venv", "node_modules", "__pycache__", "outputs", "runs")
CANDIDATE_COLUMNS = ("candidate_id", "frame", "time_s", "x", "y", "score")
OPTIONAL_COLUMNS = ("area", "mean_brightness", "bbox_w", "bbox_h", "rank")
POINT_COLUMNS = ("track_id", "candidate_id", "frame", "x", "y", "candidate_score")


def listed_videos(spark: SparkSession, root: str) -> DataFrame:
    """Videos below a folder, by path: id, path, size in MiB. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    skipped = F.col("path").rlike("/(" + "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS) + ")/")
    return files.filter(ending.isin(*VIDEO_ENDINGS) & ~skipped).select(stable_id(F.col("path")).alias("id"), "path", F.round(F.col("length") / 1048576, 2).alias("size_mb"), "modificationTime").orderBy(F.lower("path"))


def delimited(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """A CSV file as text columns; a byte-order mark and spaces in names go, empty fields are null."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return rows


def column_named(rows: DataFrame, aliases: Sequence[str], required: bool = True) -> str | None:
    """The first alias that a column has, whatever its letter case."""
    known = {c.strip().lower(): c for c in rows.columns}
    for alias in aliases:
        if found := known.get(alias.strip().lower()):
            return found
    if required:
        raise ValueError(f"none of the columns {', '.join(aliases)}")
    return None


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Typed candidates; optional columns default to 0, whole numbers may be written as decimals."""
    rows = delimited(spark, path, CANDIDATE_COLUMNS)
    number = lambda c: F.coalesce(to_double(F.col(c)), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
    whole = lambda c: number(c).cast("bigint")
    return rows.select("candidate_id", whole("frame").alias("frame"), *[number(c).alias(c) for c in ("time_s", "x", "y", "score", "area", "mean_brightness", "bbox_w", "bbox_h")], whole("rank").alias("rank")).orderBy("frame", "rank", F.desc("score"))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each track with its points in order of frames."""
    rows = delimited(spark, path, POINT_COLUMNS)
    number = lambda c: F.trim(c).cast("double").alias(c)
    point = F.struct(F.trim("frame").cast("double").cast("bigint").alias("frame"), "candidate_id", number("x"), number("y"), number("candidate_score"))
    return rows.groupBy("track_id").agg(F.array_sort(F.collect_list(point)).alias("points"))


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object a file. Strict reading raises on a broken one, tolerant reading leaves it out."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if strict:
        return reader.schema(schema).json(path)
    rows = reader.option("columnNameOfCorruptRecord", "_broken").schema(f"{schema}, _broken string").json(path)
    return rows.withColumn("_file", F.input_file_name()).filter("_broken is null").drop("_broken", "_file")


def read_track_metrics(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The objects of the `tracks` array with an id; the last one of an id counts."""
    rows = read_json(spark, path, f"tracks array<struct<track_id string, {fields}>>").select(F.posexplode("tracks").alias("at", "t")).select("at", "t.*").filter("track_id is not null")
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("at")))).filter("__r = 1").drop("__r", "at")


def run_listing(runs: DataFrame) -> DataFrame:
    """Runs with an id, newest first: by creation time as text, else by id."""
    return runs.filter("run_id is not null").orderBy(F.desc(F.coalesce("created_at", "run_id")))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return run_listing(read_json(spark, f"{root}/*/run.json", "run_id string, status string, created_at string, video_id string", strict=False))


def read_annotation_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the CSV members of ZIP archives; match and rally come from the member's name.

    An archive is read in its task; its members come out one after the other.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                with zipfile.ZipFile(io.BytesIO(r.content)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
                        rows = pd.read_csv(z.open(name), dtype=str, encoding="utf-8-sig")
                        rows.columns = [c.strip().lower() for c in rows.columns]
                        wanted = pd.DataFrame({c: rows.get(c) for c in ("frame", "visibility", "x", "y")}).astype(object)
                        yield wanted.where(wanted.notna(), None).assign(archive=r.path, member=name)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(run, "frame string, visibility string, x string, y string, archive string, member string")
    part = lambda i: F.regexp_extract("member", r"(\d+)[/_-](\d+)\.csv$", i)
    return rows.select("archive", "member", F.lpad(part(1), 2, "0").alias("match_id"), F.lpad(part(2), 3, "0").alias("rally_id"), to_double(F.col("frame")).cast("bigint").alias("frame"), to_double(F.col("visibility")).cast("int").alias("visibility"), to_double(F.col("x")).alias("x"), to_double(F.col("y")).alias("y"))


def probed_videos(rows: DataFrame, probe) -> DataFrame:
    """Add what `probe(path) -> dict` finds about each file; a failing probe gives probe_error and no row is lost.

    A probe may give `avg_rate` and `rate` as fractions in text, and `frames`. The rate is the average one, else the
    nominal one; without a count of frames it is the rate times the duration.
    """
    schema = rows.schema.simpleString()[7:-1].replace(":", " ") + ", width int, height int, avg_rate string, rate string, duration_s double, frames bigint, probe_error string"
    names = ["width", "height", "avg_rate", "rate", "duration_s", "frames", "probe_error"]

    def one(path: str) -> dict:
        try:
            return dict(probe(path))
        except Exception as e:  # the tool's own failure is the result
            return {"probe_error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame([one(p) for p in pdf["path"]], index=pdf.index, columns=names)
            yield pd.concat([pdf, found], axis=1)

    found = rows.mapInPandas(run, schema)
    rate = F.coalesce(fraction(F.col("avg_rate")), fraction(F.col("rate")))
    count = F.coalesce("frames", F.bround(F.col("fps") * F.col("duration_s")).cast("bigint"))
    return found.withColumn("fps", rate).withColumn("frame_count", count).drop("avg_rate", "rate", "frames")


def fraction(text: Column) -> Column:
    """`30000/1001` or `25` as a number; null for what isn't one or is 0."""
    top, below = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2))
    value = F.try_divide(top, F.when(below == "", 1.0).otherwise(below.try_cast("double")))
    return F.when(value > 0, value)


def write_json(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """One JSON object a row, nulls included. The committer renames files when all are written. One file only for small tables."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def catalog(videos: DataFrame, most: int = 100_000) -> DataFrame:
    """The catalogue as one row: schema_version, video_count and the videos in order of their paths. A document is
    one value, so more than `most` videos are an error; larger lists are tables."""
    entry = F.struct(F.lower("path").alias("by"), F.struct(*videos.columns).alias("video"))
    count = F.count(F.lit(1))
    some = videos.agg(count.alias("n")).first()["n"]
    if some > most:
        raise ValueError(f"{some} videos are too many for one document")
    return videos.agg(F.lit(1).alias("schema_version"), count.alias("video_count"), F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["video"]).alias("videos"))


def write_csv(rows: DataFrame, path: str, columns: Sequence[str], one_file: bool = False) -> None:
    """Fixed columns in order, with a header. One file only for small exports."""
    out = rows.select(*columns)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).csv(path)


# The columns of a crop shard in order, with the sizes of its two crops.
SHARD_COLUMNS = {"local_rgb": "binary", "context_rgb": "binary", "label": "tinyint", "hard_negative": "tinyint", "manifest_index": "int", "candidate_id": "string", "clip_id": "string", "local_frame": "int", "source_frame": "int", "rank": "smallint", "x": "float", "y": "float"}
LOCAL_SIZE, CONTEXT_SIZE = 64, 128


def shard_schema_problem(rows: DataFrame) -> str | None:
    """Why a table can't be a shard: its columns in order and their types; or None."""
    found = [(n, t) for n, t in rows.dtypes if n != "shard"]
    if [n for n, _ in found] != list(SHARD_COLUMNS):
        return f"columns: {', '.join(n for n, _ in found)}"
    return next((f"{n}: {t} in place of {SHARD_COLUMNS[n]}" for n, t in found if t != SHARD_COLUMNS[n]), None)


def shard_row_problem(id_width: int = 64, local: int = LOCAL_SIZE, context: int = CONTEXT_SIZE) -> Column:
    """Why a row doesn't keep the shard's contract, or null: whole crops of three frames, known values, ids that fit, no nulls."""
    crop = lambda c, n: F.octet_length(c) != 3 * n * n * 3
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in SHARD_COLUMNS]))
    return (F.when(F.size(missing) > 0, F.concat(F.lit("null: "), F.array_join(missing, ","))).when(crop("local_rgb", local), "local_rgb").when(crop("context_rgb", context), "context_rgb")
            .when(~F.col("label").isin(-1, 0, 1), "label").when(~F.col("hard_negative").isin(0, 1), "hard_negative").when((F.length("candidate_id") > id_width) | (F.length("clip_id") > id_width), "id too long"))


def write_shards(rows: DataFrame, path: str, per_shard: int, **sizes: int) -> None:
    """Parquet shards of `per_shard` rows by `manifest_index`. A wrong schema raises at once, a wrong row when it is written."""
    if problem := shard_schema_problem(rows):
        raise ValueError(problem)
    problem = shard_row_problem(**sizes)
    good = rows.filter(F.when(problem.isNull(), True).otherwise(F.raise_error(problem).cast("boolean")))
    sharded = good.withColumn("shard", F.floor(F.col("manifest_index") / per_shard)).repartition("shard").sortWithinPartitions("shard", "manifest_index")
    sharded.write.mode("overwrite").partitionBy("shard").parquet(path)


def written_problem(written: DataFrame, manifest: DataFrame, per_shard: int) -> DataFrame:
    """(shard, problem) of shards that don't hold the manifest's candidates at their places."""
    wanted = manifest.select(F.col("manifest_index").alias("i"), F.col("candidate_id").alias("wanted"))
    found = written.select(F.col("manifest_index").alias("i"), F.col("candidate_id").alias("found"), F.col("shard").cast("bigint").alias("in_shard"))
    rows = found.join(wanted, "i", "full")
    shard = F.coalesce("in_shard", F.floor(F.col("i") / per_shard))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("found") != F.col("wanted"), "order").when(F.col("in_shard") != F.floor(F.col("i") / per_shard), "shard")
    return rows.select(shard.alias("shard"), problem.alias("problem")).filter("problem is not null").groupBy("shard").agg(F.min("problem").alias("problem"))


def packed_crop(frames: Sequence[np.ndarray]) -> bytes:
    """Three uint8 crops of equal size as the bytes of one row."""
    stack = np.stack(frames)
    if stack.dtype != np.uint8 or stack.shape[0] != 3 or stack.ndim != 4:
        raise ValueError("three uint8 crops are needed")
    return stack.tobytes()
