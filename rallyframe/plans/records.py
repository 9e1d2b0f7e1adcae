"""Registered queries: runs, artifacts, label files, reports and their decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import evaluation, jobs, pixels, records, reports, sampling
from ..sources import views
from ..sources.views import CAND, GT, sql
from .motion import SEG
from .quality import _stage_sql, _sweep_sql, segments

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


def _chosen(number: str, *names: str | None) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), F.expr(f"cast(({number}) % {len(names)} as int)"))


STEP = "CASE " + " ".join(f"WHEN s = '{s}' AND e = '{e}' THEN '{t}'" for (s, e), t in records.CHANGES.items()) + " ELSE s END"
HISTORY = f"""ev AS (SELECT user_id AS run_id, event_id AS seq, (['create', 'start', 'complete', 'fail', 'delete', 'noop'])[(event_id * 5 + user_id * 3) % 6 + 1] AS event FROM events),
h AS (SELECT *, coalesce(list(event) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS past FROM ev),
b AS (SELECT run_id, seq, event, list_reduce(list_prepend('none', past), lambda s, e: {STEP}) AS s FROM h)"""


@query(f"WITH {HISTORY} SELECT run_id, seq, event, s AS before, {STEP.replace('e = ', 'event = ')} = s AS refused, {STEP.replace('e = ', 'event = ')} AS after FROM b")
def run_histories(spark, sf_dir):
    """What every event does to its run, refused ones included."""
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), _chosen("event_id * 5 + user_id * 3", "create", "start", "complete", "fail", "delete", "noop").alias("event"))
    return records.run_history(rows, "run_id", "seq", "event", block=64)


RANGES = "r AS (SELECT o_orderkey AS id, (o_orderkey % 70 - 5)::DOUBLE AS start_s, (o_custkey % 90) * 0.9::DOUBLE AS duration_s, CASE WHEN o_orderkey % 7 <> 0 THEN (40 + o_orderkey % 50)::DOUBLE END AS source_s FROM orders)"


@query(sql("SELECT id, CASE WHEN start_s < 0 THEN 'negative start' WHEN duration_s < 1 THEN 'too short' WHEN duration_s > 60 THEN 'too long' WHEN start_s >= source_s THEN 'starts after the end' WHEN start_s + duration_s > source_s + 0.01::DOUBLE THEN 'ends after the end' END AS problem, round(start_s, 3) AS start_s, round(duration_s, 3) AS duration_s FROM r", RANGES))
def clip_ranges(spark, sf_dir):
    """Which parts of videos can be cut out."""
    rows = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 70 - 5).cast("double").alias("start_s"), (F.col("o_custkey") % 90 * F.lit(0.9)).alias("duration_s"), F.when(F.col("o_orderkey") % 7 != 0, (40 + F.col("o_orderkey") % 50).cast("double")).alias("source_s")
    )
    return rows.select("id", records.clip_range_problem(F.col("start_s"), F.col("duration_s"), F.col("source_s")).alias("problem"), F.round("start_s", 3).alias("start_s"), F.round("duration_s", 3).alias("duration_s"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%dT%H%M%S') || '_' || 'match-' || o_custkey || '-final-' || o_orderkey || '_' || md5(o_orderkey::VARCHAR)[1:6] AS run_id FROM orders")
def new_run_ids(spark, sf_dir):
    name = F.format_string("videos/Match %d  Final_%d.mp4", "o_custkey", "o_orderkey")
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), records.new_run_id(F.col("o_orderdate"), name, F.md5(F.col("o_orderkey").cast("string")), fold=False).alias("run_id"))


@query("""WITH w AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN '../run' || o_orderkey WHEN o_orderkey % 13 = 0 THEN '' ELSE 'run' || o_orderkey END AS run_id FROM orders),
r AS (SELECT 'run' || o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'clip.mp4' WHEN o_orderkey % 4 <> 0 THEN 'source_clip.mp4' END AS named FROM orders WHERE o_orderkey % 5 <> 0),
f AS (SELECT DISTINCT 'run' || l_orderkey AS run_id FROM lineitem WHERE l_linenumber = 3)
SELECT w.run_id, 'source_clip' AS key, CASE WHEN w.run_id = '' OR contains(w.run_id, '/') THEN 'unsafe id' WHEN r.run_id IS NULL THEN 'unknown run' WHEN named IS DISTINCT FROM 'source_clip.mp4' THEN 'no reference' WHEN f.run_id IS NULL THEN 'no file' END AS problem,
CASE WHEN named = 'source_clip.mp4' AND f.run_id IS NOT NULL AND w.run_id <> '' THEN w.run_id || '/source_clip.mp4' END AS path FROM w LEFT JOIN r USING (run_id) LEFT JOIN f USING (run_id)""")
def artifact_paths(spark, sf_dir):
    """The source clip of each wanted run, or why there is none."""
    orders, k = views.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.concat(F.lit("run"), k.cast("string"))
    wanted = orders.select(F.when(k % 11 == 0, F.concat(F.lit("../"), name)).when(k % 13 == 0, "").otherwise(name).alias("run_id"), F.lit("source_clip").alias("key"), F.lit("source_clip.mp4").alias("expected"))
    named = F.when(k % 3 == 0, "clip.mp4").when(k % 4 != 0, "source_clip.mp4")
    runs = orders.filter(k % 5 != 0).select(name.alias("run_id"), F.create_map(F.lit("source_clip"), named, F.lit("run"), F.lit("run.json")).alias("artifacts"))
    files = views.table(spark, sf_dir, "lineitem").filter("l_linenumber = 3").select(F.concat(F.lit("run"), F.col("l_orderkey").cast("string")).alias("run_id"), F.lit("source_clip.mp4").alias("name"))
    return records.artifact_problem(wanted, runs, files)


FILES = "f AS (SELECT l_orderkey AS run_id, (['overlay_x.mp4', 'segment.mp4', 'a.mp4', 'run.json', 'clip.mp4', 'source_clip.mp4', 'b.mp4'])[(l_partkey + l_linenumber) % 7 + 1] AS name FROM lineitem)"


@query(sql("SELECT run_id, clip, CASE WHEN clip IS NULL THEN CASE WHEN n > 1 THEN 'ambiguous' ELSE 'absent' END END AS problem FROM (SELECT run_id, n, coalesce(p, CASE WHEN n = 1 THEN o END) AS clip FROM (SELECT run_id, arg_min(name, list_position(['source_clip.mp4', 'segment.mp4', 'clip.mp4'], name)) FILTER (WHERE name IN ('source_clip.mp4', 'segment.mp4', 'clip.mp4')) AS p, count(*) FILTER (WHERE name LIKE '%.mp4' AND name NOT LIKE 'overlay%') AS n, min(name) FILTER (WHERE name LIKE '%.mp4' AND name NOT LIKE 'overlay%') AS o FROM f GROUP BY run_id))", FILES))
def source_clips(spark, sf_dir):
    files = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), _chosen("l_partkey + l_linenumber", "overlay_x.mp4", "segment.mp4", "a.mp4", "run.json", "clip.mp4", "source_clip.mp4", "b.mp4").alias("name"))
    return records.source_clips(files)


@query("SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 ELSE -1 END AS label_id, CASE WHEN l_linenumber = 7 THEN 'label' WHEN l_linenumber % 3 = 0 AND l_returnflag <> 'N' THEN 'hard_negative' END AS problem, count(*) AS n, count(CASE WHEN l_partkey % 3 = 0 THEN 1 END) AS accepted FROM lineitem GROUP BY ALL")
def label_rows(spark, sf_dir):
    """Label numbers, refused manifest rows and accepted reviews, counted."""
    label = F.when(F.col("l_returnflag") == "A", "ball").when(F.col("l_returnflag") == "N", "not_ball").otherwise("ignore")
    rows = views.table(spark, sf_dir, "lineitem").select(label.alias("label"), F.when(F.col("l_linenumber") != 7, label).otherwise("bal").alias("written"), (F.col("l_linenumber") % 3 == 0).alias("hard"), _chosen("l_partkey", " Accepted", "rejected", None).alias("status"))
    return rows.groupBy(records.label_number(F.col("label")).alias("label_id"), records.manifest_problem(F.col("written"), F.col("hard")).alias("problem")).agg(F.count(F.lit(1)).alias("n"), F.count_if(records.accepted(F.col("status"))).alias("accepted"))


@query("SELECT c_nationkey::BIGINT AS folder, arg_min(c_name, (c_acctbal >= 1000, c_custkey % 5 = 0, c_acctbal)) FILTER (WHERE r = 1) AS path FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal >= 1000 DESC, c_custkey % 5 = 0 DESC, c_acctbal DESC, c_name) AS r FROM customer) GROUP BY c_nationkey")
def best_videos(spark, sf_dir):
    """The video of each folder that a demonstration takes."""
    rows = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("folder"), F.when(F.col("c_custkey") % 5 == 0, "Reduced_FPS.mp4").otherwise("full.mp4").alias("filename"), F.col("c_acctbal").alias("duration_s"), F.col("c_name").alias("path"))
    return records.best_videos(rows, "folder", 1000.0)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 IN (0, 1) THEN (o_custkey % 26)::VARCHAR END AS match, CASE WHEN o_orderkey % 4 IN (0, 1) THEN (o_orderkey % 900)::VARCHAR END AS rally FROM orders")
def video_keys(spark, sf_dir):
    m, r = (F.col("o_custkey") % 26).cast("string"), (F.col("o_orderkey") % 900).cast("string")
    path = F.concat(m, _chosen("o_orderkey", "/rallies_videos/", "/videos_rallies/0", "/other/", "/rallies_videos/x/"), r, F.lit(".mp4"))
    match, rally = records.video_key(path)
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), match.cast("string").alias("match"), rally.cast("string").alias("rally"))


@query("SELECT o_orderkey AS id, 'v' || o_orderkey AS raw, coalesce(min(CASE WHEN l_linenumber = 3 THEN '0 ' || 'v' || l_orderkey WHEN l_linenumber = 1 AND l_partkey % 2 = 0 THEN '1 here/v' || l_orderkey WHEN l_linenumber = 2 THEN '2 there/v' || l_orderkey END)[3:], 'v' || o_orderkey) AS path FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def resolved_paths(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("raw"))
    name = F.concat(F.lit("v"), F.col("l_orderkey").cast("string"))
    n = F.col("l_linenumber")
    files = views.table(spark, sf_dir, "lineitem").select(F.when(n == 3, name).when((n == 1) & (F.col("l_partkey") % 2 == 0), F.concat(F.lit("here/"), name)).when(n == 2, F.concat(F.lit("there/"), name)).alias("path")).filter("path is not null")
    return records.resolved_paths(rows, files, ("here", "there"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus <> 'P' AS v, (o_custkey % 1280)::DOUBLE AS x, (o_custkey % 720)::DOUBLE AS y, o_custkey % 5 AS theta FROM orders WHERE o_orderkey % 9 <> 0),
b AS (SELECT o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 1000000000 ELSE 0 END AS k, o_orderstatus <> CASE WHEN o_orderkey % 6 = 0 THEN 'O' ELSE 'P' END AS v, (o_custkey % 1280 + o_orderkey % 4)::DOUBLE AS x, CASE WHEN o_orderkey % 8 <> 0 THEN (o_custkey % 720 + o_orderkey % 3)::DOUBLE END AS y, o_custkey % 5 + (o_orderkey % 10 = 0)::INT AS theta FROM orders)
SELECT coalesce(a.k, b.k) AS id, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'both' END AS side, CASE WHEN a.v <> b.v THEN 'visible' WHEN a.theta <> b.theta THEN 'theta' END AS differs, CASE WHEN a.v AND b.v THEN round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) END AS delta FROM a FULL JOIN b ON a.k = b.k""")
def reconciled_annotations(spark, sf_dir):
    """Endpoint against midpoint annotations: keys on one side, fields that differ, and how far the places are apart."""
    orders, k, c, s = views.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    left = orders.filter(k % 9 != 0).select(k.alias("id"), (s != "P").alias("visible"), (c % 1280).cast("double").alias("x"), (c % 720).cast("double").alias("y"), (c % 5).alias("theta"))
    right = orders.select((k + F.when(k % 50 == 0, 1_000_000_000).otherwise(0)).alias("id"), (s != F.when(k % 6 == 0, "O").otherwise("P")).alias("visible"), (c % 1280 + k % 4).cast("double").alias("x"), F.when(k % 8 != 0, (c % 720 + k % 3).cast("double")).alias("y"), (c % 5 + (k % 10 == 0).cast("int")).alias("theta"))
    return records.reconciled(left, right, ["id"], ("visible", "theta")).withColumn("delta", F.round("delta", 6))


def _delta_sql() -> str:
    inner = _stage_sql()
    body = f"WITH sm AS ({inner}) SELECT a.grouping, a.value, round(a.f1 - b.f1, 9) AS f1_delta, round(a.precision - b.precision, 9) AS precision_delta, round(a.recall - b.recall, 9) AS recall_delta FROM (SELECT * FROM sm WHERE stage = 'refined') a LEFT JOIN (SELECT * FROM sm WHERE stage = 'global') b ON a.grouping = b.grouping AND a.value IS NOT DISTINCT FROM b.value"
    return f"SELECT *, CASE WHEN f1_delta >= 0.01::DOUBLE THEN 'calibration_useful_before_local_training' WHEN recall_delta >= 0.005::DOUBLE THEN 'fallback_policy_useful_before_local_training' ELSE 'legacy_local_already_near_calibrated' END AS decision, coalesce(recall_delta >= 0.05::DOUBLE AND f1_delta >= 0.05::DOUBLE, false) AS success FROM ({body})"


@query(_delta_sql())
def metric_deltas(spark, sf_dir):
    """The refined stage against the global one in every group, and what follows from it."""
    rows = evaluation.grouped_stage_metrics(views.predictions(spark, sf_dir))
    out = records.metric_deltas(rows.filter("stage = 'refined'"), rows.filter("stage = 'global'"), ["grouping", "value"], ("f1", "precision", "recall"))
    decision = records.calibration_decision(F.col("f1_delta"), F.col("recall_delta"))
    success = records.training_success(F.lit(True), F.lit(1), F.lit(0.5), F.col("recall_delta"), F.col("f1_delta"))
    return out.withColumn("decision", decision).withColumn("success", success)


@query(_sweep_sql("SELECT ordinal, policy, precision, recall, f1, fp_rate FROM fs WHERE precision >= 0.15::DOUBLE AND fp_rate <= 0.5::DOUBLE + 1e-12::DOUBLE"))
def conservative_policies(spark, sf_dir):
    return records.conservative(evaluation.threshold_sweep(views.predictions(spark, sf_dir)), F.lit(0.5), 0.15).select("ordinal", "policy", "precision", "recall", "f1", "fp_rate")


@query("SELECT run, step, f1, recall, loss FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, recall DESC, loss, step) AS r FROM (SELECT l_orderkey AS run, l_linenumber::BIGINT AS step, l_partkey % 3 AS f1, l_suppkey % 2 AS recall, l_discount AS loss FROM lineitem)) WHERE r = 1")
def best_checkpoints(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("bigint").alias("step"), (F.col("l_partkey") % 3).alias("f1"), (F.col("l_suppkey") % 2).alias("recall"), F.col("l_discount").alias("loss"))
    return records.best_checkpoints(rows, "run")


@query("SELECT l_returnflag AS split, round(sum(l_discount * l_linenumber) / sum(l_linenumber), 9) AS loss, count(*) AS batches FROM lineitem GROUP BY l_returnflag")
def weighted_losses(spark, sf_dir):
    """Mean loss of each split over batches of different sizes."""
    return views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("split")).agg(F.round(records.weighted_mean(F.col("l_discount"), F.col("l_linenumber")), 9).alias("loss"), F.count(F.lit(1)).alias("batches"))


def _stratified_sql() -> str:
    num = "num AS (SELECT clip_id, candidate_id, frame, flag, row_number() OVER (PARTITION BY clip_id, flag ORDER BY frame, rank) - 1 AS i, count(*) OVER (PARTITION BY clip_id, flag) AS n, count(CASE WHEN flag THEN 1 END) OVER (PARTITION BY clip_id) AS a, count(CASE WHEN NOT flag THEN 1 END) OVER (PARTITION BY clip_id) AS b FROM (SELECT *, frame % 17 = 0 AS flag FROM seg) WHERE clip_id IN (SELECT clip_id FROM seg GROUP BY clip_id HAVING count(*) >= 100))"
    sized = "sz AS (SELECT *, CASE WHEN flag THEN least(a, 8) ELSE 32 - least(a, 8) END AS k FROM num)"
    return sql("SELECT clip_id, candidate_id, frame, flag FROM sz WHERE k > 0 AND (n <= k OR CASE WHEN k = 1 THEN i = n // 2 ELSE EXISTS (SELECT 1 FROM range(32) t(j) WHERE j < k AND round_even(j * (n - 1) / (k - 1)::DOUBLE, 0)::BIGINT = i) END)", CAND, SEG, num, sized)


@query(_stratified_sql())
def stratified_samples(spark, sf_dir):
    """32 candidates of each stretch: up to 8 of the rare kind, the others of the rest, evenly spread."""
    rows = segments(views.unranked(spark, sf_dir)).withColumn("flag", F.col("frame") % 17 == 0)
    return sampling.stratified_sample(rows, "flag", "clip_id", ("frame", "rank"), least=100, late=views.ranked).select("clip_id", "candidate_id", "frame", "flag")


@query(sql("SELECT clip_id, frame, CASE WHEN visible THEN round(gt_x * 320 / 1280, 6) ELSE -1 END::DOUBLE AS target_x, CASE WHEN visible THEN round(gt_y * 128 / 720, 6) ELSE -1 END::DOUBLE AS target_y FROM gt", CAND, GT))
def target_positions(spark, sf_dir):
    x, y = pixels.target_position(F.col("visible"), F.col("gt_x"), F.col("gt_y"), F.lit(1280), F.lit(720))
    return views.ground_truth(spark, sf_dir).select("clip_id", "frame", F.round(x, 6).alias("target_x"), F.round(y, 6).alias("target_y"))


@query("SELECT size, count(*) AS sample_rows, round(avg(bytes), 6) AS mean_bytes, round(quantile_cont(bytes, 0.5), 6) AS median_bytes, round(quantile_cont(bytes, 0.95), 6) AS p95_bytes, round(avg(bytes) * 1000, 6) AS estimated_total_bytes, round(avg(bytes) * 1000 / 1048576, 6) AS estimated_total_mib FROM (SELECT page_id % 4 AS size, page_id // 3 AS candidate_id, sum(octet_length(encode(html)))::BIGINT AS bytes FROM pages WHERE html IS NOT NULL GROUP BY ALL) GROUP BY size")
def compression_summaries(spark, sf_dir):
    """Bytes of encoded data for each size, carried on to a thousand rows."""
    rows = views.table(spark, sf_dir, "pages").filter("html is not null").select((F.col("page_id") % 4).alias("size"), F.expr("page_id div 3").alias("candidate_id"), F.encode("html", "UTF-8").alias("data"))
    out = pixels.compression_summary(rows, 1000)
    return out.select("size", "sample_rows", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("size", "sample_rows")])


# A tracking result as JSON text for each order; some lack keys, hold other kinds or aren't JSON.
DOCS = """docs AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'broken' WHEN o_orderkey % 11 = 0 THEN '[1, 2]' ELSE '{' || CASE WHEN o_orderkey % 7 <> 0 THEN '"schema_version": 1, ' ELSE '' END || CASE WHEN o_orderkey % 5 <> 0 THEN '"engine": {"name": "e' || (o_custkey % 4) || '", "version": ' || (o_orderkey % 3) || '}' ELSE '"engine": "e"' END
 || CASE WHEN o_orderkey % 17 <> 0 THEN ', "scorer_id": "s' || (o_custkey % 3) || '"' ELSE '' END || ', "configuration": ' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '{"candidates": {"min_area": ' || (o_custkey % 9) || '}}' END || ', "status": "completed"}' END AS body FROM orders)"""
CHECKED = """checked AS (SELECT *, json_valid(body) AS ok FROM docs),
told AS (SELECT id, body, CASE WHEN NOT ok OR json_type(body) <> 'OBJECT' THEN 'not an object' WHEN NOT (json_exists(body, '$.schema_version') AND json_exists(body, '$.scorer_id')) THEN 'missing: ' || concat_ws(', ', CASE WHEN NOT json_exists(body, '$.schema_version') THEN 'schema_version' END, CASE WHEN NOT json_exists(body, '$.scorer_id') THEN 'scorer_id' END)
 WHEN json_type(body, '$.engine') <> 'OBJECT' THEN 'not an object: engine' WHEN json_type(body, '$.configuration') <> 'OBJECT' THEN 'not an object: configuration' END AS problem FROM (SELECT id, ok, CASE WHEN ok THEN body ELSE '[]' END AS body FROM checked))"""


@query(sql("SELECT id, problem, CASE WHEN problem IS NULL THEN (body->>'$.schema_version')::DOUBLE END AS schema_version, CASE WHEN problem IS NULL THEN body->>'$.engine.name' END AS engine, CASE WHEN problem IS NULL THEN (body->>'$.engine.version')::DOUBLE END AS engine_version, CASE WHEN problem IS NULL THEN body->>'$.scorer_id' END AS scorer_id, CASE WHEN problem IS NULL THEN (body->>'$.configuration.candidates.min_area')::DOUBLE END AS min_area FROM told", DOCS, CHECKED))
def tracking_descriptors(spark, sf_dir):
    """Which tracking results can be described, why the others can't, and what the descriptions hold."""
    key, of = F.col("o_orderkey"), lambda n: (F.col("o_custkey") % n).cast("string")
    body = F.concat(
        F.lit("{"), F.when(key % 7 != 0, '"schema_version": 1, ').otherwise(""), F.when(key % 5 != 0, F.concat(F.lit('"engine": {"name": "e'), of(4), F.lit('", "version": '), (key % 3).cast("string"), F.lit("}"))).otherwise('"engine": "e"'),
        F.when(key % 17 != 0, F.concat(F.lit(', "scorer_id": "s'), of(3), F.lit('"'))).otherwise(""), F.lit(', "configuration": '), F.when(key % 3 == 0, "null").otherwise(F.concat(F.lit('{"candidates": {"min_area": '), of(9), F.lit("}}"))), F.lit(', "status": "completed"}'),
    )
    rows = views.table(spark, sf_dir, "orders").select(key.alias("id"), reports.document(F.when(key % 13 == 0, "broken").when(key % 11 == 0, "[1, 2]").otherwise(body)).alias("doc"))
    rows = rows.select("id", reports.document_problem(F.col("doc")).alias("problem"), reports.descriptor(F.col("doc")).alias("d"))
    part = lambda c, path, kind, name: F.try_variant_get(f"d.{c}", path, kind).alias(name)
    return rows.select("id", "problem", part("schema_version", "$", "double", "schema_version"), part("engine", "$.name", "string", "engine"), part("engine", "$.version", "double", "engine_version"), part("scorer_id", "$", "string", "scorer_id"), part("configuration", "$.candidates.min_area", "double", "min_area"))


# Every clip's frames are the annotated ones; candidates of other frames don't count among them.
CSUM = """analyzed AS (SELECT clip_id, count(*) AS analyzed FROM gt GROUP BY clip_id),
perframe AS (SELECT g.clip_id, g.frame, count(c.rank) AS n FROM gt g LEFT JOIN candidates c USING (clip_id, frame) GROUP BY ALL),
csum AS (SELECT clip_id, count(*) AS analyzed_frames, count_if(n > 0) AS frames_with_candidates, round(count_if(n > 0)::DOUBLE / count(*), 6) AS coverage_ratio, sum(n)::BIGINT AS total_candidates, round(sum(n)::DOUBLE / count(*), 3) AS mean_candidates_per_frame, round(quantile_cont(n, 0.5), 3) AS median_candidates_per_frame, max(n) AS max_candidates_per_frame FROM perframe GROUP BY clip_id),
cscore AS (SELECT clip_id, round(sum(round(score * 1000000)::BIGINT)::DOUBLE / 1000000 / count(*), 6) AS mean_candidate_score, max(score) AS max_candidate_score FROM candidates GROUP BY clip_id)"""


@query(sql("SELECT csum.*, coalesce(mean_candidate_score, 0) AS mean_candidate_score, coalesce(max_candidate_score, 0) AS max_candidate_score FROM csum LEFT JOIN cscore USING (clip_id)", CAND, GT, CSUM))
def candidate_summaries(spark, sf_dir):
    """The summary that a clip's report holds, from counts of counts."""
    ranked = views.candidates(spark, sf_dir)
    clips = views.table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("clip_"), (F.col("o_orderkey") % 3).cast("string")).alias("clip_id")).agg(F.count(F.lit(1)).alias("analyzed"))
    return reports.candidate_summaries(clips, ranked).select("clip_id", "summary.*")


# Runs are orders, videos are customers (every fifth unknown), a clip's file is missing for some.
RUNS = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS video_id, 'v' || o_custkey || '.mp4' AS video_filename, (o_orderkey % 40)::DOUBLE AS clip_start_s, (1 + o_custkey % 30)::DOUBLE AS clip_duration_s, o_orderdate AS generated_at FROM orders),
vids AS (SELECT c_custkey AS video_id, c_custkey * 25 AS frame_count, c_custkey * 0.5::DOUBLE AS duration_s, 50.0::DOUBLE AS fps, 1280 AS width, 720 AS height FROM customer WHERE c_custkey % 5 <> 0),
files AS (SELECT o_orderkey AS run_id, o_orderkey * 1000 AS size_bytes, (1 + o_custkey % 30)::DOUBLE - 0.25::DOUBLE AS duration_s, o_custkey % 30 * 50 AS frame_count FROM orders WHERE o_orderkey % 6 <> 0),
sums AS (SELECT l_orderkey AS run_id, count(*) AS total_candidates, max(l_partkey) AS best FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 10 <> 0 GROUP BY 1),
desc_ AS (SELECT id AS run_id, scorer_id FROM (SELECT id, body->>'$.scorer_id' AS scorer_id, problem FROM told) WHERE problem IS NULL),
parts AS (SELECT r.*, v.video_id IS NOT NULL AS video, v.frame_count AS vf, v.duration_s AS vd, v.fps, v.width, v.height, f.run_id IS NOT NULL AS file, f.size_bytes, f.duration_s AS fd, f.frame_count AS ff, s.total_candidates, s.best, d.scorer_id,
 nullif(concat_ws(', ', CASE WHEN f.run_id IS NULL THEN 'clip' END, CASE WHEN s.run_id IS NULL THEN 'candidates' END, CASE WHEN s.run_id IS NULL OR s.best % 4 = 0 THEN 'tracks' END, CASE WHEN d.run_id IS NULL THEN 'tracking' END), '') AS absent
 FROM runs r LEFT JOIN vids v USING (video_id) LEFT JOIN files f USING (run_id) LEFT JOIN sums s USING (run_id) LEFT JOIN desc_ d USING (run_id))"""


@query(sql("""SELECT run_id, 'absent: ' || absent AS problem, CASE WHEN absent IS NULL THEN scorer_id END AS scorer_id, CASE WHEN absent IS NULL THEN strftime(generated_at, '%Y-%m-%dT%H:%M:%S') END AS generated_at, CASE WHEN absent IS NULL THEN round(size_bytes / 1048576.0::DOUBLE, 3) END AS size_mb,
 CASE WHEN absent IS NULL THEN '{"filename":"' || video_filename || '","frame_count":' || coalesce(vf::VARCHAR, 'null') || ',"duration_s":' || coalesce(vd::VARCHAR, 'null') || ',"fps":' || coalesce(fps::VARCHAR, 'null') || ',"resolution":{"width":' || coalesce(width::VARCHAR, 'null') || ',"height":' || coalesce(height::VARCHAR, 'null') || '}}' END AS source,
 CASE WHEN absent IS NULL THEN '{"artifact":"source_clip.mp4","requested_start_s":' || clip_start_s || ',"requested_duration_s":' || clip_duration_s || ',"actual_duration_s":' || fd || ',"frame_count":' || ff || ',"fps":null,"resolution":{"width":null,"height":null}}' END AS clip,
 CASE WHEN absent IS NULL THEN total_candidates::DOUBLE END AS total_candidates, CASE WHEN absent IS NULL THEN best::DOUBLE END AS best FROM parts""", DOCS, CHECKED, RUNS))  # fmt: skip
def run_analyses(spark, sf_dir):
    """The nested report of every run, or what it lacks; some videos are unknown."""
    orders = views.table(spark, sf_dir, "orders")
    key, video = F.col("o_orderkey"), F.col("o_custkey")
    runs = orders.select(
        key.alias("run_id"), video.alias("video_id"), F.lit("p").alias("pipeline"), F.concat(F.lit("v"), video.cast("string"), F.lit(".mp4")).alias("video_filename"), F.col("o_orderdate").alias("generated_at"), (key % 40).cast("double").alias("clip_start_s"), (1 + video % 30).cast("double").alias("clip_duration_s")
    )
    c = F.col("c_custkey")
    videos = views.table(spark, sf_dir, "customer").filter(c % 5 != 0).select(c.alias("video_id"), (c * 25).alias("frame_count"), (c * 0.5).alias("duration_s"), F.lit(50.0).alias("fps"), F.lit(1280).alias("width"), F.lit(720).alias("height"))
    files = orders.filter(key % 6 != 0).select(key.alias("run_id"), (key * 1000).alias("size_bytes"), ((1 + video % 30).cast("double") - 0.25).alias("duration_s"), (video % 30 * 50).alias("frame_count"))
    clips = reports.clip_report(runs, files)
    found = views.table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3 and l_orderkey % 10 <> 0").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count(F.lit(1)).alias("total_candidates"), F.max("l_partkey").alias("best"))
    candidates = found.select("run_id", F.struct("total_candidates").alias("summary"))
    followed = found.filter("best % 4 <> 0").select("run_id", F.struct("best").alias("summary"))
    described = tracking_descriptors(spark, sf_dir).filter("problem is null").select(F.col("id").alias("run_id"), F.struct("schema_version", "scorer_id").alias("descriptor"))
    out = reports.analyses(runs, videos, clips, candidates, followed, described).join(clips.select("run_id", F.col("clip.size_mb").alias("size_mb")), "run_id", "left")
    text = lambda part: F.to_json(f"report.{part}", {"ignoreNullFields": "false"}).alias(part)
    return out.select("run_id", "problem", "report.tracking.scorer_id", "report.generated_at", F.when(F.col("report").isNotNull(), F.col("size_mb")).alias("size_mb"), text("source"), text("clip"), F.col("report.candidates.total_candidates").cast("double").alias("total_candidates"), F.col("report.tracks_probe.best").cast("double").alias("best"))


# Points name candidates that may not be there; some come twice; some metrics are off by one, absent or left over.
FAULTS = """pts AS (SELECT 'clip_' || (user_id % 3) AS clip_id, user_id AS track_id, event_id - CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS point_index, format('f{:06d}_c{:02d}', event_id // 4, 1 + event_id % 3) AS candidate_id FROM events),
tm AS (SELECT clip_id, track_id + CASE WHEN track_id % 19 = 0 THEN 1000000 ELSE 0 END AS track_id, count(*) + max(CASE WHEN track_id % 7 = 0 THEN 1 ELSE 0 END) AS point_count FROM pts GROUP BY clip_id, pts.track_id),
cm AS (SELECT clip_id, count(*) + CASE WHEN clip_id = 'clip_1' THEN 1 ELSE 0 END AS total FROM candidates GROUP BY clip_id),
faults AS (SELECT 'candidates' AS artifact, 'repeated' AS problem, (SELECT count(*) FROM candidates) - (SELECT count(*) FROM (SELECT DISTINCT clip_id, candidate_id FROM candidates)) AS n
 UNION ALL SELECT 'tracks', 'repeated', (SELECT count(*) FROM pts) - (SELECT count(*) FROM (SELECT DISTINCT clip_id, track_id, point_index FROM pts))
 UNION ALL SELECT 'tracks', 'unknown candidate', (SELECT count(*) FROM pts WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.clip_id = pts.clip_id AND c.candidate_id = pts.candidate_id))
 UNION ALL SELECT 'candidate_metrics', 'other count', (SELECT count(*) FROM (SELECT clip_id, count(*) AS k FROM candidates GROUP BY clip_id) FULL JOIN cm USING (clip_id) WHERE coalesce(k, 0) <> coalesce(total, -1))
 UNION ALL SELECT 'track_metrics', 'other count', (SELECT count(*) FROM (SELECT clip_id, track_id, count(*) AS k FROM pts GROUP BY ALL) FULL JOIN tm USING (clip_id, track_id) WHERE coalesce(k, 0) <> coalesce(point_count, -1)))"""


@query(sql("SELECT * FROM faults WHERE n > 0", CAND, FAULTS))
def artifact_checks(spark, sf_dir):
    """How many rows of a tracking job's tables contradict the others."""
    ranked = views.candidates(spark, sf_dir)
    at = F.col("event_id")
    points = views.table(spark, sf_dir, "events").select(
        F.concat(F.lit("clip_"), (F.col("user_id") % 3).cast("string")).alias("clip_id"), F.col("user_id").alias("track_id"), (at - F.when(at % 97 == 0, 1).otherwise(0)).alias("point_index"), F.format_string("f%06d_c%02d", F.expr("event_id div 4"), 1 + at % 3).alias("candidate_id")
    )
    per = points.groupBy("clip_id", "track_id").agg(F.count(F.lit(1)).alias("n"))
    off = F.when(F.col("track_id") % 19 == 0, 1_000_000).otherwise(0)
    followed = per.select("clip_id", (F.col("track_id") + off).alias("track_id"), (F.col("n") + F.when(F.col("track_id") % 7 == 0, 1).otherwise(0)).alias("point_count"))
    total = ranked.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).select("clip_id", F.struct((F.col("n") + F.when(F.col("clip_id") == "clip_1", 1).otherwise(0)).alias("total_candidates")).alias("summary"))
    return jobs.row_problems(ranked, total, points, followed)
