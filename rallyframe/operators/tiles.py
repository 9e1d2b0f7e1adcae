"""Components of frames that come in tiles: labelled tile by tile, joined over the tiles' borders.

A task holds one tile. What a component adds up to is a row for each tile that it touches; rows are merged after the
pieces that touch across borders are found by a join of border pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import components
from .pixels import labelled

PIECE = "x0 long, y0 long, piece long, y long, x long, first_y long, first_x long, area long, sum_x long, sum_y long, min_x long, max_x long, min_y long, max_y long, brightness double, motion double"


def tiled(frames: DataFrame, height: int, width: int, size: int, key: str = "clip_id", columns: tuple[str, ...] = ("mask", "gray", "motion")) -> DataFrame:
    """Whole frames (row-major arrays) as tiles (x0, y0, width, height) of at most size x size pixels."""
    corners = F.array(*[F.struct(F.lit(x).cast("long").alias("x0"), F.lit(y).cast("long").alias("y0")) for y in range(0, height, size) for x in range(0, width, size)])
    rows = frames.select(key, "frame", *columns, F.inline(corners))
    w, h = F.least(F.lit(size), width - F.col("x0")), F.least(F.lit(size), height - F.col("y0"))
    part = lambda c: F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), h.cast("long") - 1), lambda i: F.slice(c, ((F.col("y0") + i) * width + F.col("x0") + 1).cast("int"), w.cast("int")))).alias(c)
    return rows.select(key, "frame", "x0", "y0", w.alias("width"), h.alias("height"), *[part(c) for c in columns])


def _pieces(key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "frame", *[c.split()[0] for c in PIECE.split(", ")]]
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                shape = int(r.height), int(r.width)
                mask = np.asarray(r.mask).reshape(shape).astype(bool)
                label, n = labelled(mask)
                if not n:
                    continue
                ys, xs = np.nonzero(mask)
                of = label[ys, xs] - 1
                gray, motion = (np.asarray(v, np.float64).reshape(shape)[ys, xs] for v in (r.gray, r.motion))
                gy, gx = ys + r.y0, xs + r.x0
                first = np.full(n, len(ys))
                np.minimum.at(first, of, np.arange(len(ys)))
                low, high = np.full((2, n), np.iinfo(np.int64).max), np.full((2, n), np.iinfo(np.int64).min)
                for i, v in enumerate((gx, gy)):
                    np.minimum.at(low[i], of, v)
                    np.maximum.at(high[i], of, v)
                total = lambda v, of=of, n=n: np.bincount(of, v, n)
                sums = [total(None), total(gx), total(gy), low[0], high[0], low[1], high[1], total(gray), total(motion)]
                out += [(getattr(r, key), r.frame, r.x0, r.y0, i, None, None, gy[first[i]], gx[first[i]], *[s[i] for s in sums]) for i in range(n)]
                edge = (ys == 0) | (ys == shape[0] - 1) | (xs == 0) | (xs == shape[1] - 1)
                out += [(getattr(r, key), r.frame, r.x0, r.y0, i, y, x, *[None] * 11) for i, y, x in zip(of[edge], gy[edge], gx[edge], strict=True)]
            yield pd.DataFrame(out, columns=names).astype(object)

    return run


def tile_components(tiles: DataFrame, key: str = "clip_id") -> DataFrame:
    """(key, frame, label, x, y, bbox_x, bbox_y, bbox_w, bbox_h, area, mean_brightness, motion_strength) of the
    8-connected components of each frame, labelled from 1 in the order in which scanning the whole frame meets them.

    Tiles (x0, y0, width, height, with mask, gray and motion row by row) cover a frame without overlap.
    """
    kind = dict(tiles.dtypes)[key]
    rows = tiles.select(key, F.col("frame").cast("long").alias("frame"), "x0", "y0", "width", "height", "mask", "gray", "motion").mapInPandas(_pieces(key), f"{key} {kind}, frame long, {PIECE}")
    where = [key, "frame"]
    piece = F.struct("y0", "x0", "piece")
    pieces = rows.where("y is null").withColumn("node", piece)
    border = rows.where("y is not null").select(*where, "y", "x", piece.alias("a"))
    around = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (-1, 0, 1) for i in (-1, 0, 1) if (j, i) > (0, 0)])
    beside = border.select(*where, "y", "x", F.col("a").alias("b"), F.inline(around)).select(*where, (F.col("y") + F.col("j")).alias("y"), (F.col("x") + F.col("i")).alias("x"), "b")
    touching = border.join(beside, [*where, "y", "x"]).where("a <> b").select(*where, "a", "b").distinct()
    roots = components(touching, tuple(where))
    whole = pieces.join(roots, [*where, "node"], "left").withColumn("root", F.coalesce("root", "node"))
    total = lambda c: F.sum(c)
    merged = whole.groupBy(*where, "root").agg(
        F.min(F.struct("first_y", "first_x")).alias("first"), total("area").alias("area"), total("sum_x").alias("sx"), total("sum_y").alias("sy"), F.min("min_x").alias("bbox_x"), F.min("min_y").alias("bbox_y"),
        F.max("max_x").alias("right"), F.max("max_y").alias("bottom"), total("brightness").alias("b"), total("motion").alias("m"),
    )
    label = F.row_number().over(Window.partitionBy(*where).orderBy("first"))
    return merged.select(
        *where, label.alias("label"), F.round(F.col("sx") / F.col("area"), 3).alias("x"), F.round(F.col("sy") / F.col("area"), 3).alias("y"), "bbox_x", "bbox_y", (F.col("right") - F.col("bbox_x") + 1).alias("bbox_w"), (F.col("bottom") - F.col("bbox_y") + 1).alias("bbox_h"),
        "area", (F.col("b") / F.col("area")).alias("mean_brightness"), (F.col("m") / F.col("area")).alias("motion_strength"),
    )
