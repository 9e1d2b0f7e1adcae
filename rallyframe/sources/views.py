"""Views that carry detection-and-tracking data on the generated tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import heuristic_score


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unranked(spark: SparkSession, sf_dir: str, sent: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Candidates with features and score. The division of keys by 3 spreads each clip over all partitions. `sent` gets the
    table's own columns with clip_id and frame, which are smaller, before the others are computed; what it adds stays."""
    li = table(spark, sf_dir, "lineitem").withColumns({"clip_id": F.concat(F.lit("clip_"), (F.col("l_orderkey") % 3).cast("string")), "frame": F.expr("l_orderkey div 3")})
    known = li.columns
    if sent:
        li = sent(li)
    rows = li.select(
        "clip_id", "frame", *[c for c in li.columns if c not in known],
        ((37 * F.col("l_partkey") + 11 * F.col("l_suppkey")) % 1280).cast("double").alias("x"), ((17 * F.col("l_partkey") + 91 * F.col("l_linenumber")) % 720).cast("double").alias("y"),
        (2 + F.col("l_partkey") % 160).alias("area"), (5.1 * F.col("l_quantity")).alias("bright"), (2 * F.col("l_quantity")).alias("motion"), (0.1 + F.col("l_discount")).alias("fill"),
        F.least(F.lit(1.0), 10 * F.col("l_tax")).alias("circ"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    score = heuristic_score(*[F.col(c) for c in ("motion", "bright", "fill", "circ", "area")])
    return rows.withColumn("score", F.round(score, 6))


def ranked(rows: DataFrame, *within: str) -> DataFrame:
    """Rows of `unranked` whose frames are whole, ranked in each frame by score, motion and then all columns; columns
    that were added stay. A frame that is there more than once is ranked by `within`, too."""
    ties = [F.desc("score"), F.desc("motion"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rank = F.row_number().over(Window.partitionBy("clip_id", "frame", *within).orderBy(*ties))
    columns = ["clip_id", "frame", "rank", "x", "y", "area", "bright", "motion", "fill", "circ", "score"]
    more = [c for c in rows.columns if c not in columns and not c.startswith("l_")]
    return rows.withColumn("rank", rank).select(*columns, F.format_string("f%06d_c%02d", "frame", "rank").alias("candidate_id"), *more)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates, ranked."""
    return ranked(unranked(spark, sf_dir))


CAND = """c0 AS (SELECT 'clip_' || (l_orderkey % 3) AS clip_id, l_orderkey // 3 AS frame, ((37 * l_partkey + 11 * l_suppkey) % 1280)::DOUBLE AS x, ((17 * l_partkey + 91 * l_linenumber) % 720)::DOUBLE AS y,
 2 + l_partkey % 160 AS area, 5.1::DOUBLE * l_quantity AS bright, 2 * l_quantity AS motion, 0.1::DOUBLE + l_discount AS fill, least(1.0::DOUBLE, 10 * l_tax) AS circ, * FROM lineitem),
c1 AS (SELECT *, round(0.38::DOUBLE * least(1.0::DOUBLE, motion / 100.0::DOUBLE) + 0.22::DOUBLE * least(1.0::DOUBLE, bright / 255.0::DOUBLE) + 0.16::DOUBLE * least(1.0::DOUBLE, fill / 0.70::DOUBLE) + 0.14::DOUBLE * circ + 0.10::DOUBLE * exp(-abs(area - 28.0::DOUBLE) / 28.0::DOUBLE), 6) AS score FROM c0),
cand AS (SELECT clip_id, frame, x, y, area, bright, motion, fill, circ, score, row_number() OVER (PARTITION BY clip_id, frame ORDER BY score DESC, motion DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rank FROM c1),
candidates AS (SELECT *, format('f{:06d}_c{:02d}', frame, rank) AS candidate_id FROM cand)"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated frames: each order is one."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("clip_"), (F.col("o_orderkey") % 3).cast("string")).alias("clip_id"), F.expr("o_orderkey div 3").alias("frame"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 61 - 30).alias("shift"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows of `annotated` with the frame's second candidate (x2, y2): add visible and the shifted position."""
    visible = (F.col("status") != "P") & F.col("x2").isNotNull()
    return rows.withColumns({"visible": visible, "gt_x": F.col("x2") + F.col("shift"), "gt_y": F.col("y2") + F.col("shift")}).drop("status", "shift", "x2", "y2")


def ground_truth(spark: SparkSession, sf_dir: str, ranked: DataFrame | None = None) -> DataFrame:
    """A row for each frame; the position is the frame's second candidate, shifted, or null without one."""
    second = (ranked if ranked is not None else candidates(spark, sf_dir)).filter("rank = 2").select("clip_id", "frame", F.col("x").alias("x2"), F.col("y").alias("y2"))
    return placed(annotated(spark, sf_dir).join(second, ["clip_id", "frame"], "left"))


GT = """gt AS (SELECT 'clip_' || (o_orderkey % 3) AS clip_id, o_orderkey // 3 AS frame, (o_orderstatus <> 'P' AND s.x IS NOT NULL) AS visible, s.x + (o_custkey % 61 - 30) AS gt_x, s.y + (o_custkey % 61 - 30) AS gt_y
 FROM orders LEFT JOIN (SELECT * FROM candidates WHERE rank = 2) s ON s.clip_id = 'clip_' || (o_orderkey % 3) AND s.frame = o_orderkey // 3)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global and refined predictions: the first and second candidate of each annotated frame."""
    ranked = candidates(spark, sf_dir)
    gt = ground_truth(spark, sf_dir, ranked)
    confident = ranked.filter("rank <= 2").withColumn("g", F.round(0.3 * F.col("score"), 6)).withColumn("l", F.round(F.col("fill") - 0.1, 4))
    two = confident.groupBy("clip_id", "frame").agg(
        *[F.max(F.when(F.col("rank") == r, F.col(c))).alias(n) for r, c, n in (
            (1, "x", "global_x"), (1, "y", "global_y"), (1, "g", "global_conf"), (2, "x", "refined_x"), (2, "y", "refined_y"), (2, "l", "local_conf"))]
    )
    rows = gt.join(two, ["clip_id", "frame"], "left")
    error = lambda a: F.when(F.col("visible"), F.hypot(F.col(f"{a}_x") - F.col("gt_x"), F.col(f"{a}_y") - F.col("gt_y")))
    return rows.select("*", (F.col("frame") % 24).alias("match_id"), F.when(F.col("frame") % 2 == 0, "50").otherwise("120").alias("fps_nominal"), error("global").alias("global_error"), error("refined").alias("refined_error"))


PRED = """two AS (SELECT clip_id, frame, max(x) FILTER (WHERE rank = 1) AS global_x, max(y) FILTER (WHERE rank = 1) AS global_y, max(round(0.3::DOUBLE * score, 6)) FILTER (WHERE rank = 1) AS global_conf, max(x) FILTER (WHERE rank = 2) AS refined_x, max(y) FILTER (WHERE rank = 2) AS refined_y, max(round(fill - 0.1::DOUBLE, 4)) FILTER (WHERE rank = 2) AS local_conf FROM candidates GROUP BY clip_id, frame),
pred AS (SELECT gt.*, global_x, global_y, global_conf, refined_x, refined_y, local_conf, frame % 24 AS match_id, CASE WHEN frame % 2 = 0 THEN '50' ELSE '120' END AS fps_nominal,
 CASE WHEN visible THEN sqrt((global_x - gt_x) ** 2 + (global_y - gt_y) ** 2) END AS global_error, CASE WHEN visible THEN sqrt((refined_x - gt_x) ** 2 + (refined_y - gt_y) ** 2) END AS refined_error FROM gt LEFT JOIN two USING (clip_id, frame))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track points; the event's number is the frame."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("frame"), F.col("value").alias("x"), ((F.col("event_id") * 7) % 720).cast("double").alias("y"), "event_type")


POINTS = "points AS (SELECT user_id AS track_id, event_id AS frame, value AS x, ((event_id * 7) % 720)::DOUBLE AS y, event_type FROM events)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray images from embeddings: clip, frame and 64 values of 0 to 255."""
    gray = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.6) * 200).cast("int"))))
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("clip_id"), F.col("vec_id").alias("frame"), gray.alias("gray"))


FRAMES = "frames AS (SELECT label::BIGINT AS clip_id, vec_id AS frame, list_transform(embedding, lambda e: greatest(0, least(255, floor((e::DOUBLE + 0.6::DOUBLE) * 200)::INT))) AS gray FROM embeddings)"


def sql(query: str, *views: str) -> str:
    """A query over views. `count_if(x)` is written out, as its type and its value on no rows differ between engines."""
    text = f"WITH {', '.join(views)} {query}" if views else query
    while (at := text.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}count(CASE WHEN {text[at + len('count_if('):end - 1]} THEN 1 END){text[end:]}"
    return text
