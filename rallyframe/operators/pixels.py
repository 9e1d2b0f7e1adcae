"""Frames as arrays: cuts, motion components, crops and decoded heat maps.

Differences and means are array functions; labelling components needs NumPy inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import ComponentLimits, heuristic_score
from .scan import with_neighbours

# Smoothing kernels by size.
KERNELS = {1: (1.0,), 3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625), 7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)}


def scene_cuts(frames: DataFrame, threshold: float = 30.0, key: str = "clip_id") -> DataFrame:
    """Frames whose mean absolute difference from the previous one reaches the threshold."""
    rows = with_neighbours(frames.select(key, "frame", "gray"), key, "gray", after=False).filter("__before is not null")
    total = F.aggregate(F.zip_with("gray", "__before", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, v: s + v)
    return rows.select(key, "frame", F.round(total / F.size("gray"), 6).alias("difference")).filter(F.col("difference") >= threshold)


def triples(frames: DataFrame, value: str = "gray", key: str = "clip_id") -> DataFrame:
    """(key, frame, before, value, after) of every inner frame: its value between its neighbours' in the clip's order.
    Clips are cut into spans, so no task holds a clip."""
    rows = with_neighbours(frames.select(key, "frame", value), key, value)
    return rows.select(key, "frame", F.col("__before").alias("before"), value, F.col("__after").alias("after")).filter("before is not null and after is not null")


def motion_of(inner: DataFrame, threshold: int = 18, key: str = "clip_id") -> DataFrame:
    """Symmetric motion of frames with their neighbours, from a table (`triples`) or a stream (`live_triples`):
    pixels above the threshold in the lesser of both differences, and their mean."""
    diff = lambda c: F.zip_with("gray", c, lambda x, y: F.abs(x - y))
    rows = inner.withColumn("__m", F.zip_with(diff("before"), diff("after"), lambda x, y: F.least(x, y)))
    above = rows.withColumn("__over", F.filter("__m", lambda v: v > threshold))
    mean = F.try_divide(F.aggregate("__over", F.lit(0), lambda s, v: s + v).cast("double"), F.size("__over"))
    return above.select(key, "frame", F.size("__over").cast("bigint").alias("moving_pixels"), F.round(F.coalesce(mean, F.lit(0.0)), 6).alias("mean_motion"), F.array_max("__m").cast("bigint").alias("peak_motion"))


def motion_means(frames: DataFrame, threshold: int = 18, key: str = "clip_id") -> DataFrame:
    """Symmetric motion of a clip's inner frames."""
    return motion_of(triples(frames, key=key), threshold, key)


def blurred(gray: np.ndarray, size: int) -> np.ndarray:
    """Separable smoothing with mirrored edges, rounded to whole values."""
    kernel, pad = np.array(KERNELS[size]), size // 2
    if not pad:
        return gray
    out = gray.astype(np.float64)
    for axis in (0, 1):
        wide = np.pad(out, [(pad, pad) if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
        out = sum(w * np.take(wide, np.arange(i, i + gray.shape[axis]), axis) for i, w in enumerate(kernel))
    return np.floor(out + 0.5).astype(np.int16)


def _shifted(mask: np.ndarray, fill: bool) -> np.ndarray:
    """The mask and its four neighbours, stacked: the 3 x 3 ellipse is a cross."""
    wide = np.pad(mask, 1, constant_values=fill)
    return np.stack([wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components, numbered in the order in which scanning meets them."""
    height, width = mask.shape
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:  # spread the least number of each neighbourhood
        wide = np.pad(np.where(mask, label, mask.size + 1), 1, constant_values=mask.size + 1)
        least = np.min([wide[i : i + height, j : j + width] for i in range(3) for j in range(3)], axis=0)
        new = np.where(mask, least, 0)
        if np.array_equal(new, label):
            break
        label = new
    values = np.unique(label[mask])
    return np.searchsorted(values, label) * mask + mask, len(values)


def circularity(mask: np.ndarray) -> float:
    """4 pi area / perimeter ** 2 of the outline through the border pixels' centres, within 0 and 1.

    Area and perimeter follow the border as a polygon of pixel centres, traced clockwise. The length of each straight
    run is a root in single precision, as image libraries take it.
    """
    ys, xs = np.nonzero(mask)
    if len(ys) < 3:
        return 0.0
    inside = set(zip(ys.tolist(), xs.tolist(), strict=True))
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    start = here = min(inside)
    turn, path = 0, [start]
    while True:
        for step in range(8):
            d = (turn + 6 + step) % 8
            there = (here[0] + around[d][0], here[1] + around[d][1])
            if there in inside:
                break
        else:
            return 0.0
        if here == start and len(path) > 1 and there == path[1]:
            break
        path.append(there)
        here, turn = there, d
        if len(path) > 4 * len(inside) + 8:
            break
    if path[-1] == start:
        path = path[:-1]
    p = np.array(path, float)
    step = np.roll(p, -1, axis=0) - p
    p = p[(step != np.roll(step, 1, axis=0)).any(1)]  # corners
    q = np.roll(p, -1, axis=0)
    perimeter, area = float(np.sqrt(((q - p) ** 2).sum(1).astype(np.float32)).astype(float).sum()), abs((p[:, 1] * q[:, 0] - q[:, 1] * p[:, 0]).sum()) / 2
    return float(min(1.0, max(0.0, 4 * np.pi * area / perimeter**2))) if perimeter else 0.0


def components(previous: np.ndarray, current: np.ndarray, following: np.ndarray, limits: ComponentLimits) -> list[dict]:
    """Moving blobs of a frame that keep the limits, with their features but no score."""
    if not previous.shape == current.shape == following.shape:
        raise ValueError("frames differ in shape")
    motion = np.minimum(np.abs(current.astype(np.int16) - previous), np.abs(current.astype(np.int16) - following))
    mask = _shifted(_shifted(motion > limits.motion_threshold, False).any(0), True).all(0)
    label, n = labelled(mask)
    out = []
    for i in range(1, n + 1):
        own = label == i
        ys, xs = np.nonzero(own)
        area, w, h = len(ys), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
        if not limits.min_area <= area <= limits.max_area or max(w, h) > limits.max_dimension or area / (w * h) < limits.min_fill:
            continue
        out.append({"label": i, "x": round(float(xs.mean()), 3), "y": round(float(ys.mean()), 3), "bbox_x": int(xs.min()), "bbox_y": int(ys.min()), "bbox_w": w, "bbox_h": h, "area": area,
                    "mean_brightness": float(current[own].mean()), "motion_strength": float(motion[own].mean()), "fill_ratio": area / (w * h), "circularity": circularity(own)})
    return out


COMPONENT = "label int, x double, y double, bbox_x int, bbox_y int, bbox_w int, bbox_h int, area int, mean_brightness double, motion_strength double, fill_ratio double, circularity double"


def detected(frames: DataFrame, height: int, width: int, limits: ComponentLimits = ComponentLimits(), fps: float = 30.0, key: str = "clip_id", scorer: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Ranked candidates of every inner frame; the first and the last frame of a clip have none.

    Neighbours come from spans of the clip, so batches of frames go to Python and never a clip.
    Scoring and the choice of the best `per_frame` are columns and a window again.
    """
    rows = triples(frames.select(F.col(key).cast("string").alias("clip_id"), "frame", "gray"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = lambda v: blurred(np.asarray(v, np.int16).reshape(height, width), limits.blur)
        for pdf in batches:
            out = [{"clip_id": r.clip_id, "frame": r.frame, **c} for r in pdf.itertuples() for c in components(shape(r.before), shape(r.gray), shape(r.after), limits)]
            yield pd.DataFrame(out, columns=["clip_id", "frame", *[c.split()[0] for c in COMPONENT.split(", ")]])

    found = rows.mapInPandas(run, f"clip_id string, frame long, {COMPONENT}")
    score = scorer(found) if scorer else heuristic_score(*[F.col(c) for c in ("motion_strength", "mean_brightness", "fill_ratio", "circularity", "area")])
    place = F.row_number().over(Window.partitionBy("clip_id", "frame").orderBy(F.desc("score"), F.desc("motion_strength"), "label"))
    best = found.withColumn("score", F.round(score, 6)).withColumn("rank", place).filter(F.col("rank") <= limits.per_frame)
    rounded = [F.round(c, d).alias(c) for c, d in (("mean_brightness", 3), ("motion_strength", 3), ("fill_ratio", 4), ("circularity", 4))]
    return best.select("clip_id", F.format_string("f%06d_c%02d", "frame", "rank").alias("candidate_id"), "frame", "rank", F.round(F.col("frame") / fps, 6).alias("time_s"), "x", "y", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "area", *rounded, "score")


def crop_box(x: Column, y: Column, size: Column, width: int, height: int) -> dict[str, Column]:
    """A square crop about a rounded centre: its corner, the padding on each side, and the padded share."""
    left, top = F.floor(x + 0.5) - F.floor(size / 2), F.floor(y + 0.5) - F.floor(size / 2)
    zero = F.lit(0).cast("bigint")
    pads = {"pad_left": F.greatest(zero, -left), "pad_top": F.greatest(zero, -top), "pad_right": F.greatest(zero, left + size - width), "pad_bottom": F.greatest(zero, top + size - height)}
    pads = {k: F.least(v, size).cast("bigint") for k, v in pads.items()}
    inner = F.greatest(zero, size - pads["pad_left"] - pads["pad_right"]) * F.greatest(zero, size - pads["pad_top"] - pads["pad_bottom"])
    return {"crop_x": left, "crop_y": top, **pads, "padded_fraction": F.round(1 - inner / (size * size), 6)}


def cropped(image: np.ndarray, x: float, y: float, size: int) -> np.ndarray:
    """Zero-padded square crop of an H x W x 3 image, blue-green-red turned to red-green-blue."""
    left, top = int(np.floor(x + 0.5)) - size // 2, int(np.floor(y + 0.5)) - size // 2
    wide = np.pad(image, ((size, size), (size, size), (0, 0)))
    top, left = min(max(top + size, 0), image.shape[0] + size), min(max(left + size, 0), image.shape[1] + size)
    return np.ascontiguousarray(wide[top : top + size, left : left + size, ::-1])


def heat_peaks(frames: DataFrame, column: str = "gray", key: str = "clip_id") -> DataFrame:
    """First position of the maximum along an axis, and its value."""
    return frames.select(key, "frame", (F.array_position(column, F.array_max(column)) - 1).alias("peak_at"), F.array_max(column).cast("bigint").alias("peak"))


def axis_peaks(rows: DataFrame, source_width: Column, source_height: Column, x_axis: str = "x_axis", y_axis: str = "y_axis") -> DataFrame:
    """Add pred_x and pred_y, the first maximum of each axis scaled to the source, and the smaller maximum as confidence."""
    at = lambda c, n: (F.array_position(c, F.array_max(c)) - 1) * n / F.size(c)
    return rows.withColumns({"pred_x": at(x_axis, source_width), "pred_y": at(y_axis, source_height), "confidence": F.least(F.array_max(x_axis), F.array_max(y_axis))})


def target_position(visible: Column, x: Column, y: Column, source_width: Column, source_height: Column, width: int = 320, height: int = 128) -> tuple[Column, Column]:
    """The place in the network's input; (-1, -1) if the ball isn't visible. A visible one needs both coordinates."""
    def scaled(v, n, source):
        known = F.when(x.isNull() | y.isNull(), F.raise_error(F.lit("a visible position is missing")).cast("double")).otherwise(v * n / source)
        return F.when(visible, known).otherwise(F.lit(-1.0))

    return scaled(x, width, source_width), scaled(y, height, source_height)


def crop_margins(rows: DataFrame, by: str = "size") -> DataFrame:
    """For each crop size: boxes that reach out of the crop, and the least, 5 % and median margin of a box inside its crop."""
    box = crop_box(F.col("x"), F.col("y"), F.col(by), 1, 1)
    left, top = F.col("bbox_x") - box["crop_x"], F.col("bbox_y") - box["crop_y"]
    margin = F.least(left, F.col(by) - left - F.col("bbox_w"), top, F.col(by) - top - F.col("bbox_h"))
    per = rows.select(by, margin.alias("margin")).groupBy(by)
    return per.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("margin") < 0).alias("bbox_outside"), F.min("margin").alias("min_margin"), F.percentile("margin", 0.05).alias("p05_margin"), F.percentile("margin", 0.5).alias("median_margin"))


def compression_summary(crops: DataFrame, total_rows: int, by: str = "size", candidate: str = "candidate_id", data: str = "data") -> DataFrame:
    """Bytes of a candidate's encoded crops for each size: mean, median, 95 %, and the mean carried on to all rows."""
    per = crops.groupBy(by, candidate).agg(F.sum(F.octet_length(data)).alias("bytes"))
    out = per.groupBy(by).agg(F.count(F.lit(1)).alias("sample_rows"), F.avg("bytes").alias("mean_bytes"), F.percentile("bytes", 0.5).alias("median_bytes"), F.percentile("bytes", 0.95).alias("p95_bytes"))
    total = F.col("mean_bytes") * F.lit(float(total_rows))
    return out.withColumns({"estimated_total_bytes": total, "estimated_total_mib": total / 2**20})
