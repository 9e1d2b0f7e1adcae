"""Competing tracklets: beam search from seeds, then greedy suppression of overlaps."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut

FIELDS = ("x", "y", "score", "area", "bright", "size")


@dataclass(frozen=True)
class TrackConfig:
    """The search's limits and weights."""

    max_gap_frames: int = 2
    max_jump_per_frame: float = 58.0
    prediction_error_limit: float = 26.0
    max_acceleration: float = 24.0
    max_turn_degrees: float = 115.0
    max_span_frames: int = 45
    beam_width: int = 4
    branch_factor: int = 2
    seeds_per_frame: int = 6
    seed_stride: int = 3
    min_points: int = 5
    max_tracks: int = 24
    overlap: float = 0.65

    def __post_init__(self) -> None:
        positive = {k: v for k, v in asdict(self).items() if k != "max_gap_frames"}
        if not 0 <= self.max_gap_frames <= 6 or min(positive.values()) <= 0 or self.max_turn_degrees > 180 or self.max_span_frames < 5 or self.min_points < 2 or self.overlap > 1:
            raise ValueError(f"track configuration out of range: {self}")


class _Frames:
    """Candidates of some blocks of frames as arrays, sorted by clip, block, frame and then in the order of rank.

    Blocks lie so far apart in `frame` that no path leaves one; `number` is the frame's own number. Without `block` all
    are one block of a clip.
    """

    def __init__(self, pdf: pd.DataFrame, block: int = 0, config: TrackConfig = TrackConfig()):
        self.ids, self.number, self.segment = pdf["candidate_id"].to_numpy(), pdf["frame"].to_numpy(np.int64), pdf["segment"].to_numpy(np.int64)
        self.data = pdf[list(FIELDS)].to_numpy(np.float64)
        if not block:
            self.frame = self.number
            return
        self.clip, part = pdf["clip_id"].to_numpy(), pdf["__part"].to_numpy(np.int64)
        fresh = np.r_[True, (self.clip[1:] != self.clip[:-1]) | (part[1:] != part[:-1])]
        ahead = self.number - part * block
        self.frame = ahead + (np.cumsum(fresh) - 1) * (2 * block + config.max_span_frames + config.max_gap_frames + 1)
        self.place = _places(self.frame)
        self.seeds = np.flatnonzero((ahead < block) & (self.number % config.seed_stride == 0) & (self.place < config.seeds_per_frame))


@dataclass(frozen=True)
class _Beams:
    """Paths of equal length from many seeds, in the order of their seeds and of their beams: a line of each table for a path."""

    seed: np.ndarray
    rows: np.ndarray
    gain: np.ndarray
    errors: np.ndarray
    accelerations: np.ndarray

    def taken(self, which: np.ndarray) -> _Beams:
        return _Beams(self.seed[which], self.rows[which], self.gain[which], self.errors[which], self.accelerations[which])

    def with_points(self, which: np.ndarray, row: np.ndarray, gain: np.ndarray, error: np.ndarray, acceleration: np.ndarray) -> _Beams:
        grown = lambda table, column: np.column_stack([table[which], column])
        return _Beams(self.seed[which], grown(self.rows, row), self.gain[which] + gain, grown(self.errors, error), grown(self.accelerations, acceleration))


def _places(groups: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... inside each run of equal numbers."""
    fresh = np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))


def _grown(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far two sizes differ, as a logarithm of 2 at most; 0 where one is unknown."""
    both = (new > 0) & (old > 0)
    return np.where(both, np.minimum(2.0, np.abs(np.log(np.where(both, new, 1.0) / np.where(both, old, 1.0)))), 0.0)


def _extensions(frames: _Frames, beams: _Beams, config: TrackConfig) -> tuple[np.ndarray, ...]:
    """Allowed next points of all paths, by path and the best first: path, row, score change, prediction error, acceleration."""
    here = beams.rows[:, -1]
    now = frames.frame[here]
    until = np.minimum(now + config.max_gap_frames + 1, frames.frame[beams.rows[:, 0]] + config.max_span_frames - 1)
    a, b = np.searchsorted(frames.frame, now, "right"), np.searchsorted(frames.frame, until, "right")
    count = np.maximum(b - a, 0)
    path = np.repeat(np.arange(len(here)), count)
    row = _places(path) + a[path]
    dt = (frames.frame[row] - now[path]).astype(np.float64)
    step = frames.data[row, :2] - frames.data[here[path], :2]
    jump = np.sqrt(step[:, 0] ** 2 + step[:, 1] ** 2)
    near = np.flatnonzero((frames.segment[row] == frames.segment[here[path]]) & (jump <= config.max_jump_per_frame * dt))
    path, row, dt, step, jump = path[near], row[near], dt[near], step[near], jump[near]
    error = acceleration = np.zeros(near.size)
    if beams.rows.shape[1] > 1:
        back = beams.rows[:, -2]
        velocity = ((frames.data[here, :2] - frames.data[back, :2]) / np.maximum(1, now - frames.frame[back])[:, None])[path]
        new = step / dt[:, None]
        miss, change = step - velocity * dt[:, None], new - velocity
        error, acceleration = np.hypot(miss[:, 0], miss[:, 1]), np.hypot(change[:, 0], change[:, 1])
        old_speed, new_speed = np.hypot(velocity[:, 0], velocity[:, 1]), jump / dt
        still = (new_speed < 1e-6) | (old_speed < 1e-6)
        cosine = np.where(still, 1.0, (new * velocity).sum(1) / np.where(still, 1.0, old_speed * new_speed))
        turn = np.degrees(np.arccos(np.clip(cosine, -1, 1)))
        ok = (error <= config.prediction_error_limit + 4.0 * (dt - 1)) & (acceleration <= config.max_acceleration) & (turn <= config.max_turn_degrees)
        path, row, dt, jump, error, acceleration = path[ok], row[ok], dt[ok], jump[ok], error[ok], acceleration[ok]
    old, new = frames.data[here[path]], frames.data[row]
    light = np.where((old[:, 4] > 0) & (new[:, 4] > 0), np.abs(new[:, 4] - old[:, 4]) / 255.0, 0.0)
    look = _grown(old[:, 3], new[:, 3]) + light + 0.5 * _grown(old[:, 5], new[:, 5])
    gain = 1.65 * new[:, 2] - 0.035 * error - 0.022 * acceleration - 0.010 * jump - 0.24 * look - 0.10 * (dt - 1)
    order = np.lexsort((row, -new[:, 2], -gain, path))
    best = order[_places(path[order]) < config.branch_factor]
    return path[best], row[best], gain[best], error[best], acceleration[best]


#: Pairs of a path and a point that are looked at in one go; a path alone may have more.
PAIRS = 1 << 18


def _ended(frames: _Frames, seeds: np.ndarray, config: TrackConfig) -> Iterator[tuple[_Beams, np.ndarray]]:
    """All paths that end, with their numbers, a table for each length: no point follows, or the span is used up. Pruned
    ones vanish.

    The beams of all seeds grow by one point at a time, as tables; a path's number counts those of its seed that ended
    before it. A round holds beam_width paths of each seed at most, and about PAIRS pairs at once.
    """
    none = np.zeros((len(seeds), 0))
    beams = _Beams(np.arange(len(seeds)), np.asarray(seeds, np.int64)[:, None], 1.2 * frames.data[seeds, 2], none, none)
    ended = np.zeros(len(seeds), np.int64)
    while len(beams.seed):
        now = frames.frame[beams.rows[:, -1]]
        wide = np.searchsorted(frames.frame, now + config.max_gap_frames + 1, "right") - np.searchsorted(frames.frame, now, "right")
        cuts = np.flatnonzero(np.diff(np.cumsum(wide) // PAIRS)) + 1
        parts = []
        for chunk in np.split(np.arange(len(now)), cuts):
            path, *found = _extensions(frames, beams.taken(chunk), config)
            parts.append((chunk[path], *found))
        path, row, gain, error, acceleration = (np.concatenate(c) for c in zip(*parts, strict=True))
        done = np.flatnonzero(~np.isin(np.arange(len(now)), path))
        numbers = ended[beams.seed[done]] + _places(beams.seed[done])
        ended += np.bincount(beams.seed[done], minlength=len(seeds))
        yield beams.taken(done), numbers
        beams = beams.with_points(path, row, gain, error, acceleration)
        length = beams.rows.shape[1]
        span = frames.frame[beams.rows[:, -1]] - frames.frame[beams.rows[:, 0]] + 1
        order = np.lexsort((-(beams.gain + 0.16 * length + 0.25 * length / span), beams.seed))  # stable, and all are equally long
        beams = beams.taken(order[_places(beams.seed[order]) < config.beam_width])


@dataclass(frozen=True)
class _Path:
    rows: tuple[int, ...]
    errors: tuple[float, ...] = ()
    accelerations: tuple[float, ...] = ()


def _grow(frames: _Frames, seeds: np.ndarray, config: TrackConfig) -> Iterator[tuple[int, int, _Path]]:
    """(seed, number, path) of the paths of `_ended`, one by one."""
    for paths, numbers in _ended(frames, seeds, config):
        for seed, number, *tables in zip(paths.seed.tolist(), numbers.tolist(), paths.rows.tolist(), paths.errors.tolist(), paths.accelerations.tolist(), strict=True):
            yield seed, number, _Path(*map(tuple, tables))


def _means(table: np.ndarray) -> np.ndarray:
    """Means of lines, 0 for empty ones, of sums that carry what rounding drops."""
    total = lost = np.zeros(len(table))
    for value in table.T:
        new = total + value
        lost = lost + np.where(np.abs(total) >= np.abs(value), (total - new) + value, (value - new) + total)
        total = new
    return (total + lost) / max(table.shape[1], 1)


def _scores(frames: _Frames, paths: _Beams) -> np.ndarray:
    """Scores of paths of equal length."""
    rows, length = paths.rows, paths.rows.shape[1]
    span = frames.frame[rows[:, -1]] - frames.frame[rows[:, 0]] + 1
    moves = np.diff(frames.data[rows, :2], axis=1)
    speed = np.hypot(moves[..., 0], moves[..., 1]).mean(axis=1) if length > 1 else np.zeros(len(rows))
    gaps = np.maximum(np.diff(frames.frame[rows], axis=1) - 1, 0).sum(axis=1)
    return 1.8 * frames.data[rows, 2].mean(axis=1) + 0.55 * length / span + 0.32 * math.log1p(length) + 0.25 * np.minimum(1.0, speed / 18.0) - 0.030 * _means(paths.errors) - 0.018 * _means(paths.accelerations) - 0.025 * gaps


def _whole_blocks(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in tables that end where a block ends; each holds a table's rows and one block's more at most."""
    held: list[pd.DataFrame] = []
    for pdf in pdfs:
        if pdf.empty:
            continue
        clip, part = pdf["clip_id"].to_numpy(), pdf["__part"].to_numpy()
        last = np.flatnonzero((clip != clip[-1]) | (part != part[-1]))
        at = int(last[-1]) + 1 if last.size else 0
        if held and (at or clip[-1] != held[-1]["clip_id"].iloc[-1] or part[-1] != held[-1]["__part"].iloc[-1]):
            yield pd.concat([*held, pdf.iloc[:at]], ignore_index=True)
            held = [pdf.iloc[at:]]
        elif at:
            yield pdf.iloc[:at]
            held = [pdf.iloc[at:]]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


#: Neighbouring blocks of a clip that go to one task.
TOGETHER = 8


def _blocks(config: TrackConfig, block: int) -> tuple[int, Column]:
    """Frames of a block, and the blocks that get a frame."""
    reach = max(block, config.max_span_frames)
    own = F.floor(F.col("frame") / reach)
    reached = F.when(F.col("frame") - own * reach < config.max_span_frames - 1, own - 1)
    return reach, F.array_compact(F.array(own, reached))


def together(rows: DataFrame, config: TrackConfig = TrackConfig(), block: int = 64) -> DataFrame:
    """Rows of a table with clip_id and frame, sent to the tasks that search them, with the number of their blocks'
    group in `__together`. Frames at its ends are there twice, so ranks and the like are found by `__together` too."""
    groups = F.array_distinct(F.transform(_blocks(config, block)[1], lambda part: F.floor(part / TOGETHER)))
    return rows.withColumn("__together", F.explode(groups)).repartition("clip_id", "__together")


def hypotheses(candidates: DataFrame, config: TrackConfig = TrackConfig(), block: int = 64) -> DataFrame:
    """Finished paths of all seeds: (clip_id, seed_frame, seed_rank, path, score, candidate_ids, frames, xs, ys, errors).

    A path spans at most max_span_frames, so a clip is cut into blocks of frames. A block owns its seeds and also gets
    the frames that they may reach. Blocks follow one another in a task, which searches as many of them at once as a
    batch of rows holds: short clips cost no call each, and a task never holds a long one. TOGETHER neighbouring blocks
    go to one task, where the frames that two of them get are copied; only those at its ends are sent twice. Candidates
    that come out of `together`, with the same settings, lie there already.
    """
    reach, blocks = _blocks(config, block)
    extra = {"segment": F.lit(0), "area": F.lit(0.0), "bright": F.lit(0.0), "size": F.lit(0.0)}
    columns = ["clip_id", "candidate_id", F.col("frame").cast("long").alias("frame"), "rank", *[c for c in ("segment",) if c in candidates.columns], *[F.col(c).cast("double").alias(c) for c in FIELDS if c in candidates.columns]]
    if "__together" in candidates.columns:
        sent = candidates.select(*columns, "__together").repartition("clip_id", "__together")  # no second shuffle where they lie so
    else:
        sent = together(candidates.select(*columns), config, block)
    parts = sent.withColumn("__part", F.explode(F.filter(blocks, lambda part: F.floor(part / TOGETHER) == F.col("__together")))).withColumns({name: value for name, value in extra.items() if name not in candidates.columns})

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_blocks(pdfs):
            frames = _Frames(pdf, reach, config)
            for paths, numbers in _ended(frames, frames.seeds, config):
                if not len(numbers) or paths.rows.shape[1] < config.min_points:
                    continue
                seed, rows = frames.seeds[paths.seed], paths.rows
                listed = {"candidate_ids": frames.ids[rows], "frames": frames.number[rows], "xs": frames.data[rows, 0], "ys": frames.data[rows, 1], "errors": np.column_stack([np.zeros(len(rows)), paths.errors])}
                yield pd.DataFrame({"clip_id": frames.clip[seed], "seed_frame": frames.number[seed], "seed_rank": frames.place[seed], "path": numbers, "score": _scores(frames, paths)} | {name: table.tolist() for name, table in listed.items()})

    schema = "clip_id string, seed_frame long, seed_rank long, path long, score double, candidate_ids array<string>, frames array<long>, xs array<double>, ys array<double>, errors array<double>"
    order = ["clip_id", "__part", "frame", F.col("rank").asc_nulls_last(), (-F.col("score")).asc_nulls_last(), "candidate_id"]
    slim = parts.select("clip_id", "__part", "candidate_id", "frame", "rank", "segment", *FIELDS)
    return slim.sortWithinPartitions(*order).mapInPandas(run, schema)


PATH_KEY = ("seed_frame", "seed_rank", "path")


def suppressed(ranked: DataFrame, edges: DataFrame, group: str, most: int | None = None) -> DataFrame:
    """(group, id) of the ids that a greedy pass over each group keeps: best first, none that has an edge to one kept
    before it; with `most`, at least the first `most` of them.

    `ranked` has one row for each (group, id); lesser ids are better. `edges` (group, better, worse) are pairs of it.
    In every round an id without an open better neighbour is kept and its worse neighbours go, which is what the
    sequential pass decides. Only open edges are held, and what comes after a group's `most` kept ids is left out.
    """
    ends = lambda e: e.select(group, F.explode(F.array(F.struct(F.col("better").alias("id"), F.lit(False).alias("below")), F.struct(F.col("worse").alias("id"), F.lit(True).alias("below")))).alias("v")).select(group, "v.*")
    alone = ranked.select(group, "id").join(ends(edges).select(group, "id").distinct(), [group, "id"], "left_anti")
    kept, edges = cut(alone), cut(edges.select(group, "better", "worse"))
    while not edges.isEmpty():
        flags = ends(edges).groupBy(group, "id").agg(F.max("below").alias("below"))
        gone = edges.join(flags.where("not below").select(group, F.col("id").alias("better")), [group, "better"]).select(group, F.col("worse").alias("id"), F.lit(True).alias("gone")).distinct()
        state = cut(flags.join(gone, [group, "id"], "left").select(group, "id", "below", F.coalesce("gone", F.lit(False)).alias("gone")))
        held = kept.union(state.where("not below").select(group, "id"))
        left = state.where("below and not gone").select(group, "id")
        if most:
            last = held.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy("id"))).where(F.col("__n") == most).select(group, F.col("id").alias("__last"))
            left = left.join(last, group, "left").where(F.col("__last").isNull() | (F.col("id") < F.col("__last"))).drop("__last")
        for end in ("better", "worse"):
            edges = edges.join(left.withColumnRenamed("id", end), [group, end], "left_semi")
        edges = cut(edges)
        freed = left.join(ends(edges).select(group, "id").distinct(), [group, "id"], "left_anti")
        kept = cut(held.union(freed))
    return kept


#: Paths of a clip that are looked at first, how many times as many are when these don't decide it, and the parts of a
#: clip in which the best of so many are found.
LOOKED, WIDER, PARTS = 999, 8, 64


def _kept(batches: Iterator[pa.RecordBatch], most: int, config: TrackConfig) -> Iterator[pa.RecordBatch]:
    """Of paths by clip and the best first (`__n`), those that overlap none kept before them, with `track_rank`. Of a clip
    that `most` paths don't decide the next one follows, as track_rank 0. Kept paths of one clip are held."""
    clip, sizes, places = None, [], defaultdict(list)
    for batch in batches:
        rows, ranks = [], []
        for row, (name, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("clip_id", "__n", "candidate_ids")), strict=True)):
            if name != clip:
                clip, sizes, places = name, [], defaultdict(list)
            if len(sizes) >= config.max_tracks:
                continue
            own = {x for x in ids or () if x is not None}
            shared = Counter(k for x in own for k in places.get(x, ()))
            if n > most:
                rows.append(row)
                ranks.append(0)
            elif all(round(both / min(len(own), sizes[k]), 6) < config.overlap for k, both in shared.items()):
                for x in own:
                    places[x].append(len(sizes))
                sizes.append(len(own))
                rows.append(row)
                ranks.append(len(sizes))
        taken = batch.take(pa.array(rows, pa.int64()))
        columns = {name: taken.column(name) for name in batch.schema.names if name != "__n"}
        yield pa.RecordBatch.from_pydict(columns | {"track_rank": pa.array(ranks, pa.int64())})


def selected(paths: DataFrame, config: TrackConfig = TrackConfig()) -> DataFrame:
    """The best paths of each clip that overlap none kept before them; `track_rank` from 1.

    (clip_id, seed_frame, seed_rank, path) is unique; a path without candidates overlaps nothing. Whether a path is kept
    depends on better ones only, and a clip ends with max_tracks kept ones: so its best paths decide it, and pairs of
    paths are neither listed nor stored. A task sees the LOOKED best of a clip one after the other and holds the kept
    ones. Clips that these don't decide are seen again with WIDER times as many, found in PARTS parts.
    """
    best = F.struct((-F.col("score")).alias("loss"), *PATH_KEY)
    columns = ["clip_id", *PATH_KEY, "score", "candidate_ids", "frames", "xs", "ys", "errors"]
    schema = StructType([*paths.select(columns).schema.fields, StructField("track_rank", LongType())])
    paths = cut(paths.select(columns).where(F.col("clip_id").isNotNull()))
    first = lambda rows, most, *part: rows.withColumn("__n", F.row_number().over(Window.partitionBy("clip_id", *part).orderBy(best))).where(F.col("__n") <= most + 1)
    done, rows, most = [], paths, LOOKED
    while True:
        look = lambda batches, most=most: _kept(batches, most, config)
        found = cut(first(rows, most).sortWithinPartitions("clip_id", "__n").mapInArrow(look, schema))
        open_ = found.where("track_rank = 0").select("clip_id")
        kept = found.where("track_rank > 0")
        if open_.isEmpty():
            done.append(kept)
            break
        done.append(kept.join(open_, "clip_id", "left_anti"))
        most *= WIDER
        part = F.pmod(F.xxhash64(*PATH_KEY), F.lit(PARTS)).alias("__part")
        rows = first(paths.join(open_, "clip_id", "left_semi").select("*", part), most, "__part").drop("__n", "__part")
    out = reduce(DataFrame.unionByName, done)
    return out.select("clip_id", "track_rank", *PATH_KEY, "score", "candidate_ids", "frames", "xs", "ys", "errors")


def track_points(tracks: DataFrame, fps: float = 30.0) -> DataFrame:
    """One row for each point, numbered from 1; ids are T001, T002, ..."""
    parts = F.posexplode(F.arrays_zip("candidate_ids", "frames", "xs", "ys", "errors")).alias("at", "p")
    rows = tracks.select("clip_id", F.format_string("T%03d", "track_rank").alias("track_id"), "track_rank", parts)
    return rows.select("clip_id", "track_id", "track_rank", (F.col("at") + 1).alias("point_index"), F.col("p.candidate_ids").alias("candidate_id"), F.col("p.frames").alias("frame"), F.round(F.col("p.frames") / fps, 6).alias("time_s"), F.col("p.xs").alias("x"), F.col("p.ys").alias("y"), F.round("p.errors", 3).alias("prediction_error"))
