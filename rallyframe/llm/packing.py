"""Bulk-synchronous best-fit packing of documents into sequences of a fixed number of tokens.

Equal documents are interchangeable, and so are equal gaps: both are kept as runs (a value, a first number, a
count) in tables of the shared folder. A round sorts the runs of documents and of gaps into ranges of their
value and sweeps every range on its own from the smallest value up: a gap takes the largest document below it
that no smaller gap took, as often as it holds it. What a range leaves goes to one sweep over all ranges.
Conflicts are resolved by rank, as larger documents are taken first. Documents that no gap holds open new
sequences, for half of their volume, by rank again; gaps are updated, and rounds repeat until no document is
left. A round takes documents from half of the largest open size up, so that small ones stay for late gaps.

How many runs there are is bounded by `capacity` and the rounds and not by the documents: a step of a sweep uses
up a run of documents (one for each size) or one of gaps, so a round adds at most three runs a size. Ranking
and assignment run on all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import coder, slices
from .common import rows_in, stored

RUNS = "kind string, value int, first long, count long, sequence long, offset int, per int"
Run = tuple[str, int, int, int, int, int, int]


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int) -> tuple[list[Run], list[list[int]], list[Run]]:
    """One sweep over runs (value, first, count): what is placed and its new gaps, the documents left from the
    smallest up, and the gaps left."""
    waiting: list[list[int]] = []
    done: list[Run] = []
    idle: list[Run] = []
    for value, is_gap, first, count in sorted([(v, 0, f, n) for v, f, n in docs] + [(v, 1, f, n) for v, f, n in gaps]):
        if not is_gap:
            waiting.append([value, first, count])
            continue
        while count and waiting:
            size, rank, left = waiting[-1]
            per = min(value // size, left)
            used = min(left // per, count)
            done.append(("placed", size, rank, per * used, first, capacity - value, per))
            if value > per * size:
                done.append(("new", value - per * size, first, used, 0, 0, 0))
            first, count = first + used, count - used
            waiting[-1][1:] = rank + per * used, left - per * used
            if left == per * used:
                waiting.pop()
        if count:
            idle.append(("gap", value, first, count, 0, 0, 0))
    return done, waiting, idle


def opened(waiting: list[list[int]], capacity: int, first: int, share: float) -> tuple[list[Run], list[list[int]]]:
    """New sequences for `share` of the volume that no gap holds, at least one for each document above half of
    the capacity; each takes one document, the largest first. What is placed with its gaps, and what is left."""
    large = sum(n for v, _, n in waiting if 2 * v > capacity)
    volume = sum(v * n for v, _, n in waiting)
    wanted = max(1, large, int(share * -(-volume // capacity)))
    done: list[Run] = []
    left: list[list[int]] = []
    for size, rank, count in sorted(waiting, reverse=True):
        used = min(count, wanted)
        if used:
            done.append(("placed", size, rank, used, first, 0, 1))
            if capacity > size:
                done.append(("new", capacity - size, first, used, 0, 0, 0))
        if count > used:
            left.append([size, rank + used, count - used])
        first, wanted = first + used, wanted - used
    return done, left


def planned(sizes: DataFrame, capacity: int, ranges: int = 16, floor: float = 0.5, share: float = 0.5, most_rounds: int = 400) -> DataFrame:
    """Runs (value, first, count, sequence, offset, per) of placed documents for a table (value, count) of sizes.

    The document of rank r (from 0) in its size lies in the run with first <= r < first + count: in sequence
    `sequence` + (r - first) div per, at `offset` + (r - first) mod per * value. The driver sees three numbers a round.
    """
    width = -(-capacity // ranges)

    def frame(rows: list[Run]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RUNS.split(", ")])

    def runs_of(pdf: pd.DataFrame, kind: str) -> list[tuple[int, int, int]]:
        return list(pdf.loc[pdf["kind"] == kind, ["value", "first", "count"]].astype("int64").itertuples(index=False, name=None))

    def in_range(pdf: pd.DataFrame) -> pd.DataFrame:
        done, waiting, idle = sweep(runs_of(pdf, "doc"), runs_of(pdf, "gap"), capacity)
        return frame([*done, *(("doc", *w, 0, 0, 0) for w in waiting), *idle])

    def over_ranges(first: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            done, waiting, idle = sweep(runs_of(pdf, "doc"), runs_of(pdf, "gap"), capacity)
            more, waiting = opened(waiting, capacity, first, share) if waiting else ([], [])
            return frame([*done, *more, *(("doc", *w, 0, 0, 0) for w in waiting), *idle])

        return run

    none = [F.lit(0).cast(t).alias(c) for c, t in (("sequence", "long"), ("offset", "int"), ("per", "int"))]
    state = stored(sizes.select(F.lit("doc").alias("kind"), F.col("value").cast("int").alias("value"), F.lit(0).cast("long").alias("first"), F.col("count").cast("long").alias("count"), *none), "sizes")
    placed, opened_so_far = [state.filter("kind = 'placed'")], 0
    for round_ in range(most_rounds + 1):
        end = F.max(F.when(F.col("kind") == "placed", F.col("sequence") + F.ceil(F.col("count") / F.col("per"))))
        seen = state.agg(F.max(F.when(F.col("kind") == "doc", F.col("value"))).alias("top"), end.alias("end")).first()
        opened_so_far = max(opened_so_far, seen["end"] or 0)
        if seen["top"] is None:
            break
        if round_ == most_rounds:
            raise RuntimeError(f"documents are left after {most_rounds} rounds")
        rows = state.filter("kind in ('doc', 'gap')")
        later = (F.col("kind") == "doc") & (F.col("value") < floor * seen["top"])
        swept = rows.filter(~later).groupBy(F.floor((F.col("value") - 1) / width).alias("range")).applyInPandas(in_range, RUNS)
        swept = stored(swept, f"ranges{round_}")
        rest = swept.filter("kind in ('doc', 'gap')").groupBy(F.lit(0).alias("all")).applyInPandas(over_ranges(opened_so_far), RUNS)
        whole = swept.filter("kind in ('placed', 'new')").union(rest).union(rows.filter(later))
        state = stored(whole.withColumn("kind", F.when(F.col("kind") == "new", "gap").otherwise(F.col("kind"))), f"round{round_}")
        placed.append(state.filter("kind = 'placed'"))
    out = placed[0]
    for more in placed[1:]:
        out = out.union(more)
    return out.drop("kind")


def packed(pieces: DataFrame, capacity: int, length: str = "length", keys: tuple[str, ...] = ("doc_id", "piece"), rows_per_bucket: int = 50_000, broadcast_runs: int = 400_000) -> DataFrame:
    """Add `sequence_id` and `offset` to rows with a length of 1 to `capacity`.

    A size may hold a third of all rows: it is ranked in hashed buckets whose offsets come from their
    counts. Ties and repeated rows are interchangeable. Lengths out of range raise an error when the
    plan runs. Columns sequence_id and offset in `pieces` are replaced. An empty table gives an empty result. Up to
    `broadcast_runs` runs (some 40 bytes each) are broadcast; beyond, they are joined by size.
    """
    size = F.when(F.col(length).between(1, capacity), F.col(length).cast("int")).otherwise(F.raise_error(F.lit(f"length outside 1..{capacity}")).cast("int"))
    buckets = max(8, -(-rows_in(pieces) // rows_per_bucket))
    rows = pieces.withColumn("__size", size).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    by_bucket = rows.groupBy("__size", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    counts = stored(by_bucket, "counts")
    before = Window.partitionBy("__size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__size", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    local = Window.partitionBy("__size", "__bucket").orderBy(*keys)
    ranked = rows.withColumn("__row", F.row_number().over(local)).join(starts, ["__size", "__bucket"]).withColumn("__rank", F.col("__first") + F.col("__row") - 1)
    # The runs of a size lie in one array, so each document is matched by its rank.
    runs = planned(counts.groupBy(F.col("__size").alias("value")).agg(F.sum("__n").alias("count")), capacity)
    struct = F.struct((F.col("first") + F.col("count")).alias("end"), "first", "sequence", "offset", "per")
    plan = stored(runs.groupBy(F.col("value").alias("__size")).agg(F.array_sort(F.collect_list(struct)).alias("runs")), "plan")
    small = plan.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("n")).first()["n"] <= broadcast_runs
    run = F.get("runs", F.size(F.filter("runs", lambda r: r["end"] <= F.col("__rank"))))
    placed = ranked.join(F.broadcast(plan) if small else plan, "__size").withColumn("__run", run).withColumn("__in", F.col("__rank") - F.col("__run.first"))
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    sequence = F.col("__run.sequence") + F.expr("__in div __run.per")
    offset = F.col("__run.offset") + F.col("__in") % F.col("__run.per") * F.col("__size")
    return placed.select(*own, sequence.alias("sequence_id"), offset.cast("long").alias("offset"))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of each text, then `end_id`, cut at `capacity`.

    Only documents longer than `capacity` are cut, into pieces of `capacity` tokens, the first the shorter.
    Null text counts as empty: one piece with `end_id` alone. Ids are those of the tokenizers library.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache = coder(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                doc, piece, start, length, crc = [], [], [], [], []
                flat, begin = cache.ids(batch.column("text"))
                raw, begin = flat.tobytes(), begin.tolist()
                for i in range(batch.num_rows):
                    ids = raw[4 * begin[i] : 4 * begin[i + 1]] + end
                    n, at = len(ids) // 4, 0
                    for p in range(-(-n // capacity)):
                        to = n - capacity * (-(-n // capacity) - 1 - p)
                        doc.append(i)
                        piece.append(p)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                        at = to
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """`token_pieces` of all documents, packed. The pieces are written once: encoding runs once."""
    pieces = stored(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    return packed(pieces, capacity, keys=("doc_id", "piece", "ids_crc32"))
