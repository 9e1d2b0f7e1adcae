"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Input partitions are dealt to groups. How many rows of each group go to each shard is drawn from the
multivariate hypergeometric law, so the counts are those of a uniform random permutation and the shard sizes
come out exact. Each group is permuted, cut by its row of the matrix, exchanged, and permuted again. A
permutation is the order of a random number for each row, sorted in ranges of that number; the ranges'
counts give the places. The driver sees the counts of at most `max_groups` groups.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, rows_in, text_of


def draw_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """One row for each group: exact counts to each shard; columns sum to sizes at most one apart."""
    total, rng = sum(counts), np.random.default_rng(seed)
    left = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    out = np.zeros((len(counts), n_shards), dtype=np.int64)
    for b, n in enumerate(counts):
        others, need = sum(left), n
        for s in range(n_shards):
            others -= left[s]
            out[b, s] = hypergeometric(rng, left[s], others, need)
            need -= int(out[b, s])
            left[s] -= int(out[b, s])
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int, deviations: int = 12) -> int:
    """How many of `draws` out of good + bad are good, by inversion, in one way at every size.

    Probabilities are built up from the mode by the exact ratio of neighbours. What lies beyond twelve deviations,
    where the law is wider than that, has a probability below 1e-30; the work grows as the square root of the draws.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    share = good / (good + bad)
    reach = int(deviations * (draws * share * (1 - share)) ** 0.5) + 64
    low, high = max(low, mode - reach), min(high, mode + reach)

    def ratios(k: np.ndarray) -> np.ndarray:
        """p(k + 1) / p(k)."""
        return (good - k) / (k + 1.0) * ((draws - k) / (bad - draws + k + 1.0))

    up = np.cumprod(ratios(np.arange(mode, high, dtype=np.float64)))
    down = np.cumprod(1 / ratios(np.arange(mode - 1, low - 1, -1, dtype=np.float64)))
    sums = np.cumsum(np.r_[down[::-1], 1.0, up])
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver table as a literal in the plan."""
    text = F.lit(json.dumps(rows))
    return spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))


def _places(rows: DataFrame, group: str, number: Column, parts: int, name: str, broadcast_rows: int) -> DataFrame:
    """Number the rows of each group from 0 in the order of `number`, a random long, in `parts` ranges of it."""
    rows = rows.withColumn("__number", number)
    upper = F.shiftright("__number", 32).cast("long") + (1 << 31)  # from 0 to 2 ** 32 - 1, in the order of the number
    rows = rows.withColumn("__range", F.shiftright(upper * parts, 32).cast("int"))
    counts = stored(rows.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n")), "counts")
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(group, "__range", F.coalesce(before, F.lit(0)).alias("__first"))
    starts = F.broadcast(starts) if rows_in(counts) <= broadcast_rows else starts
    local = F.row_number().over(Window.partitionBy(group, "__range").orderBy("__number", "row_id"))
    return rows.withColumn("__local", local).join(starts, [group, "__range"]).withColumn(name, F.col("__first") + F.col("__local") - 1).drop("__number", "__range", "__local", "__first")


def sharded(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 8, seed: int = 20, rows_per_range: int = 100_000, max_groups: int = 256, broadcast_rows: int = 400_000
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law `rows`.

    size is the text's UTF-8 bytes (null: none) plus 1; slot is gapless from 0 in each shard; grown_shard
    is null, as rows are dealt by count. A null key is a key like any other. A row is told apart by its place in the
    input, so repeated rows spread like others; another partitioning of the input gives another shuffle. Fewer
    rows than shards leave shards empty. An empty table gives an empty result.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    body = text_of(text)
    own = [F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")]
    # Written once: row numbers, whose upper bits are the partition, stay as they are when a task runs again.
    slim = stored(docs.select(*own, F.monotonically_increasing_id().alias("row_id"), (F.spark_partition_id() % max_groups).alias("group")), "slim")
    counts = {r["group"]: r["n"] for r in slim.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups, total = sorted(counts), sum(counts.values())
    matrix = draw_matrix([counts[g] for g in groups], n_shards, seed)
    ends = _table(spark, [{"group": g, "ends": np.cumsum(row).tolist()} for g, row in zip(groups, matrix, strict=True)], "`group` int, ends array<bigint>")
    draw = lambda salt: F.xxhash64(F.lit(f"{seed}/{salt}"), "row_id")
    ranges = lambda rows: max(1, -(-rows // rows_per_range))
    dealt = _places(slim, "group", draw("first"), ranges(max(counts.values(), default=0)), "place", broadcast_rows)
    dealt = dealt.join(F.broadcast(ends), "group").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
    dealt = stored(dealt.select("doc_id", "size", "text_crc32", "row_id", "shard"), "dealt")
    placed = _places(dealt, "shard", draw("second"), ranges(-(-total // n_shards)), "slot", broadcast_rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
