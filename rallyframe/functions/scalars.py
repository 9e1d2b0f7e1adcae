"""Scalar building blocks: casts that don't raise, ratios, identifiers, bounds."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The frame rates that a measured rate is matched to.
FRAME_RATES = (24, 25, 30, 50, 60, 120)


def to_double(text: Column) -> Column:
    """A finite number or null; blank, NaN and infinite texts are null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def to_double_comma(text: Column) -> Column:
    """As `to_double`, with a comma as the decimal mark too."""
    return to_double(F.replace(text, F.lit(","), F.lit(".")))


def to_int_exact(text: Column, tolerance: float = 1e-6) -> Column:
    """A whole number or null: a value further than the tolerance from one is no integer."""
    value = to_double(text)
    return F.when(F.abs(value - F.bround(value)) <= tolerance, F.bround(value).try_cast("bigint"))


def to_int_truncated(text: Column) -> Column:
    return F.coalesce(to_double(text).try_cast("bigint"), F.lit(0).cast("bigint"))


def rate(text: Column) -> Column:
    """`30000/1001` or a plain number; blank, N/A and a zero divisor are null."""
    parts = F.split(F.trim(text), "/")
    over = F.coalesce(to_double(F.get(parts, 1)), F.when(F.size(parts) == 1, F.lit(1.0)))
    return F.try_divide(to_double(F.get(parts, 0)), over)


def ratio(part: Column, whole: Column, digits: int = 9) -> Column:
    """0 for a whole that isn't positive."""
    return F.coalesce(F.when(whole > 0, F.round(part / whole, digits)), F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    """Weighted harmonic mean; null if either is null, 0 if both are."""
    b = beta * beta
    return F.when((b * precision + recall) > 0, (1 + b) * precision * recall / (b * precision + recall)).when(precision.isNotNull() & recall.isNotNull(), F.lit(0.0))


def fixed(value: Column, digits: int = 6) -> Column:
    """Fixed digits without closing zeros; null is the empty text."""
    shown = F.format_string(f"%.{digits}f", value.cast("double"))
    return F.when(value.isNull(), "").otherwise(F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", ""))


def stable_id(path: Column) -> Column:
    """The first 16 hex digits of the lower-cased POSIX path's SHA-1."""
    return F.substring(F.sha1(F.lower(F.replace(path, F.lit("\\"), F.lit("/")))), 1, 16)


@F.pandas_udf(T.StringType())
def ascii_folded(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without what isn't ASCII; Spark has no built-in for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def slug(text: Column, fallback: str = "run", most: int = 48, fold: bool = True) -> Column:
    """Lower-case words joined by hyphens. `fold` takes accents off first; ASCII texts don't need it."""
    words = F.regexp_replace(F.lower(ascii_folded(text) if fold else text), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(words, "^-+|-+$", ""), 1, most), "-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit(fallback)).otherwise(cut)


def nominal_rate(fps: Column, rates: Iterable[int] = FRAME_RATES, within: float = 2.0) -> Column:
    """The nearest known rate as text, the first on ties; `other` beyond the tolerance, `unknown` for null."""
    near = F.array_min(F.array(*[F.struct(F.abs(fps - r).alias("d"), F.lit(i).alias("i"), F.lit(str(r)).alias("name")) for i, r in enumerate(rates)]))
    return F.when(fps.isNull(), "unknown").when(near["d"] <= within, near["name"]).otherwise("other")


def source_split(match: Column) -> Column:
    return F.when(match <= 21, "train").otherwise("test")


def corpus_split(match: Column) -> Column:
    return F.when(match <= 19, "train").when(match <= 21, "validation").otherwise("test")


def inside(x: Column, y: Column, width: Column | int, height: Column | int) -> Column:
    """Half-open image bounds; null for a null coordinate."""
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def strictly_inside(x: Column, y: Column, width: Column | int, height: Column | int) -> Column:
    """Bounds that exclude 0, as training data selection has them."""
    return (x > 0) & (x < width) & (y > 0) & (y < height)


def same_value(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Null-safe equality with an absolute tolerance."""
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def is_hit(distance: Column, radius: float = 20.0) -> Column:
    """Within the radius, its edge included; a missing distance is a miss."""
    return F.coalesce(distance <= radius, F.lit(False))


def wall_time(text: Column) -> Column:
    """ISO time as `dd/MM/yyyy HH:mm:ss` in its own offset; an unreadable text stays as it is."""
    local = F.substring(F.replace(text, F.lit("T"), F.lit(" ")), 1, 19)
    return F.coalesce(F.date_format(F.try_to_timestamp(local, F.lit("yyyy-MM-dd HH:mm:ss")), "dd/MM/yyyy HH:mm:ss"), text)


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out
