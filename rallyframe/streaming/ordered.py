"""Keyed streams in the order of their frames: late frames wait in state, and what follows sees them sorted.

A key's own frames are its clock. A frame is released once a frame `slack` further on has arrived, so input that is
shuffled by no more than `slack` frames gives the rows of ordered input. A frame at or before the last one released
is too late and is left out. State holds at most `slack` frames that wait, and what a step keeps.

What still waits when a clip ends comes out with an end marker, a row with a null frame, or after `idle_ms` without
a row. All of it is in Spark's state store, so a query goes on from its checkpoint as if it hadn't stopped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(value: Any) -> Any:
    """A value as state takes it."""
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, np.generic):
        value = value.item()
    return None if isinstance(value, float) and math.isnan(value) else value


@dataclass
class InOrder(StatefulProcessor):
    """Releases a key's rows by frame and hands each to `step`, which gives output rows; `columns` is the rows'
    schema beside key and frame, `out` the names of the output's columns behind the key."""

    key: str
    columns: dict[str, str]
    out: list[str]
    slack: int = 0
    idle_ms: int = 0
    ttl_ms: int | None = None
    handle: Any = field(default=None, repr=False)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "frame long", ", ".join(f"{n} {t}" for n, t in self.columns.items()), self.ttl_ms)
        self.clock = handle.getValueState("clock", "top long, released long")
        self.prepare()

    def prepare(self) -> None:
        """Get the step's own state."""

    def step(self, frame: int, row: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def _released(self, key: tuple, until: int | None) -> pd.DataFrame:
        """Step through what waits up to a frame, or through all of it."""
        due = sorted(f for (f,) in self.waiting.keys() if until is None or f <= until) if self.waiting.exists() else []
        rows = []
        for frame in due:
            rows += [(*key, *r) for r in self.step(frame, tuple(self.waiting.getValue((frame,))))]
            self.waiting.removeKey((frame,))
        if due:
            top = self.clock.get()[0]
            self.clock.update((top, due[-1]))
        return pd.DataFrame(rows, columns=[self.key, *self.out])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        top, released = self.clock.get() if self.clock.exists() else (None, None)
        ended = False
        for pdf in rows:
            for frame, *values in pdf[["frame", *self.columns]].itertuples(index=False, name=None):
                frame = _plain(frame)
                if frame is None:
                    ended = True
                elif released is None or frame > released:
                    self.waiting.updateValue((int(frame),), tuple(map(_plain, values)))
                    top = int(frame) if top is None else max(top, int(frame))
        if top is None:
            return
        self.clock.update((top, released))
        yield self._released(key, None if ended else top - self.slack)
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if self.waiting.exists() and next(iter(self.waiting.keys()), None) is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._released(key, None)

    def close(self) -> None:
        pass


class Triples(InOrder):
    """Each frame between the one before and the one after it; the three are held, then the oldest goes."""

    def prepare(self) -> None:
        self.held = self.handle.getListState("held", "frame long, value " + self.columns["value"])

    def step(self, frame: int, row: tuple) -> Iterator[tuple]:
        held = [*self.held.get(), (frame, row[0])] if self.held.exists() else [(frame, row[0])]
        if len(held) == 3:
            (_, before), (at, value), (_, after) = held
            yield at, list(before), list(value), list(after)
        self.held.put([(f, list(v)) for f, v in held[-2:]])


@dataclass
class Sessions(InOrder):
    """Exponential smoothing that gaps and jumps restart, with the trail of the session's last `age` frames."""

    max_gap: int = 4
    max_jump: float = 230.4
    alpha: float = 0.72
    age: int | None = None

    def prepare(self) -> None:
        self.last = self.handle.getValueState("last", "frame long, x double, y double, sx double, sy double, session long")
        self.trail = self.handle.getMapState("trail", "frame long", "x double, y double", self.ttl_ms)

    def step(self, frame: int, row: tuple) -> Iterator[tuple]:
        x, y = row
        last = self.last.get() if self.last.exists() else None
        fresh = last is None or frame - last[0] > self.max_gap or math.hypot(x - last[1], y - last[2]) > self.max_jump
        session = 1 if last is None else last[5] + fresh
        sx, sy = (x, y) if fresh else (self.alpha * x + (1 - self.alpha) * last[3], self.alpha * y + (1 - self.alpha) * last[4])
        self.last.update((frame, x, y, sx, sy, session))
        if self.age is None:
            yield frame, session, round(sx, 6), round(sy, 6)
            return
        if fresh:
            self.trail.clear()
        else:
            for (at,) in list(self.trail.keys()):
                if frame - at > self.age:
                    self.trail.removeKey((at,))
        self.trail.updateValue((frame,), (sx, sy))
        points = sorted((at, round(px, 6), round(py, 6)) for (at,), (px, py) in self.trail.iterator())
        yield frame, session, round(sx, 6), round(sy, 6), points


def _stateful(rows: DataFrame, processor: InOrder, schema: str) -> DataFrame:
    key = processor.key
    rows.sparkSession.conf.set(STORE, ROCKS)  # the only store of this kind of state
    timed = "processingTime" if processor.idle_ms or processor.ttl_ms else "none"
    return rows.select(key, "frame", *processor.columns).groupBy(key).transformWithStateInPandas(processor, f"{key} {dict(rows.dtypes)[key]}, {schema}", "append", timed)


def live_triples(frames: DataFrame, value: str = "gray", key: str = "clip_id", slack: int = 0, idle_ms: int = 0) -> DataFrame:
    """(key, frame, before, value, after) of every inner frame, one frame late; equal to `pixels.triples` on a table.

    Of rows of one frame the last that arrives before its release counts.
    """
    kind = dict(frames.dtypes)[value]
    rows = frames.withColumnRenamed(value, "value")
    out = _stateful(rows, Triples(key, {"value": kind}, ["frame", "before", "value", "after"], slack, idle_ms), f"frame long, before {kind}, value {kind}, after {kind}")
    return out.withColumnRenamed("value", value)


def live_sessions(points: DataFrame, max_gap: int = 4, max_jump: float = 230.4, alpha: float = 0.72, key: str = "track_id", slack: int = 0, idle_ms: int = 0) -> DataFrame:
    """Smoothed points with their sessions, equal to `tracks.smoothed` on a table; the state of a track is its last
    point and what waits, not its history."""
    processor = Sessions(key, {"x": "double", "y": "double"}, ["frame", "session", "smooth_x", "smooth_y"], slack, idle_ms, max_gap=max_gap, max_jump=max_jump, alpha=alpha)
    return _stateful(points, processor, "frame long, session long, smooth_x double, smooth_y double")


def live_trails(points: DataFrame, age: int, max_gap: int = 4, max_jump: float = 230.4, alpha: float = 0.72, key: str = "track_id", slack: int = 0, idle_ms: int = 0, ttl_ms: int | None = None) -> DataFrame:
    """`live_sessions` with the trail: the session's smoothed points that are at most `age` frames old. Equal to
    `tracks.smoothed_trails` on a table. `ttl_ms` lets an abandoned track's trail expire."""
    processor = Sessions(key, {"x": "double", "y": "double"}, ["frame", "session", "smooth_x", "smooth_y", "trail"], slack, idle_ms, ttl_ms, max_gap=max_gap, max_jump=max_jump, alpha=alpha, age=age)
    return _stateful(points, processor, "frame long, session long, smooth_x double, smooth_y double, trail array<struct<frame: long, x: double, y: double>>")
