"""Associative scans over long keys: what lies before a row in its key, without a task that holds the key.

Rows of a key are cut into spans of a numeric order column. Windows run inside (key, span). What a span adds up to
is one value of a monoid (a last row, a count, an affine map); values are combined over the spans before, in chunks
of spans and then over the chunks, and joined back by span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SPAN = "__span"
#: Units of the order column in a span, and spans in a chunk.
SIZE, FAN = 4096, 512

Plus = Callable[[Column, Column], Column]


def with_span(rows: DataFrame, order: str = "frame", size: int = SIZE) -> DataFrame:
    """Add the span of each row; rows without an order go to the first one, as nulls come first in a window."""
    return rows.withColumn(SPAN, F.coalesce(F.floor(F.col(order) / size), F.lit(-(2**62))))


def with_halo(rows: DataFrame, before: int = 0, after: int = 0, order: str = "frame", size: int = SIZE) -> DataFrame:
    """Rows by span, each span also with the rows of the neighbour spans that lie at most `before` units ahead of it
    or `after` behind it; `__own` tells a span's rows from its halo. Both are at most the span's size."""
    if not 0 <= max(before, after) <= size:
        raise ValueError("a halo can't be wider than a span")
    own = F.coalesce(F.floor(F.col(order) / size), F.lit(-(2**62)))
    at = F.coalesce(F.pmod(F.floor(F.col(order)), F.lit(size)), F.lit(size))
    places = F.array(own, F.when((at >= size - before) & (at < size), own + 1), F.when(at < after, own - 1))
    return rows.withColumn(SPAN, F.explode(F.array_compact(places))).withColumn("__own", F.col(SPAN) == own)


def inside(key: str, *order: str) -> WindowSpec:
    return Window.partitionBy(key, SPAN).orderBy(*order)


def _running(items: Column, zero: Column, plus: Plus) -> Column:
    """[zero, i0, i0 + i1, ...]; the arrays are as long as a chunk."""
    return F.aggregate(items, F.array(zero), lambda sums, x: F.array_append(sums, plus(F.element_at(sums, -1), x)))


def before_spans(totals: DataFrame, key: str, value: str, zero: Column, plus: Plus, fan: int = FAN) -> DataFrame:
    """(key, span, before): the sum of `value` over all earlier spans of the key.

    `totals` has one row for each key and span that has rows; `plus` is associative with the neutral `zero`, whose
    type is that of `value`. A row here stands for a span: chunks hold `fan` of them, a key one for each chunk.
    """
    kind = totals.schema[value].dataType
    zero = zero.cast(kind)
    chunks = totals.groupBy(key, F.floor(F.col(SPAN) / fan).alias("__chunk")).agg(F.array_sort(F.collect_list(F.struct(F.col(SPAN).alias("s"), F.col(value).alias("v")))).alias("__items"))
    chunks = chunks.withColumn("__sums", _running(F.transform("__items", lambda i: i["v"]), zero, plus))
    tops = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("__chunk").alias("c"), F.element_at("__sums", -1).alias("v")))).alias("__tops"))
    tops = tops.withColumn("__sums", _running(F.transform("__tops", lambda i: i["v"]), zero, plus))
    ahead = tops.select(F.col(key).alias("__key"), F.inline(F.transform("__tops", lambda t, i: F.struct(t["c"].alias("__at"), F.get("__sums", i).alias("__ahead")))))
    both = chunks.join(ahead, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__chunk") == F.col("__at")))
    return both.select(key, F.inline(F.transform("__items", lambda t, i: F.struct(t["s"].alias(SPAN), plus(F.col("__ahead"), F.get("__sums", i)).alias("before")))))


def joined(rows: DataFrame, carries: DataFrame, key: str) -> DataFrame:
    """Rows with the `before` of their span; every span has one."""
    right = carries.select(F.col(key).alias("__key"), F.col(SPAN).alias("__of"), F.col("before").alias("__before"))
    return rows.join(right, F.col(key).eqNullSafe(F.col("__key")) & (F.col(SPAN) == F.col("__of"))).drop("__key", "__of")


def _last_two(a: Column, b: Column) -> Column:
    """Of two spans in a row: the last row and the one before it."""
    return F.when(b["one"].isNull(), a).when(b["two"].isNull(), F.struct(b["one"].alias("one"), a["one"].alias("two"))).otherwise(b)


def with_previous(rows: DataFrame, key: str, columns: tuple[str, ...], order: tuple[str, ...] = ("frame",), size: int = SIZE) -> DataFrame:
    """Add `__one` and `__two`: structs of `columns` of the row before and of the one before that, null where there
    is none. Rows are ordered by `order`, whose first column is numeric; rows that tie may come in any order."""
    held = with_span(rows, order[0], size).withColumn("__row", F.struct(*columns))
    w = inside(key, *order)
    held = held.withColumn("__in1", F.lag("__row").over(w)).withColumn("__in2", F.lag("__row", 2).over(w)).withColumn("__place", F.row_number().over(inside(key, *[F.col(c).desc_nulls_last() for c in order])))
    last = held.where("__place <= 2").groupBy(key, SPAN).agg(F.struct(F.max(F.when(F.col("__place") == 1, F.col("__row"))).alias("one"), F.max(F.when(F.col("__place") == 2, F.col("__row"))).alias("two")).alias("__v"))
    kind = last.schema["__v"].dataType
    carries = before_spans(last, key, "__v", F.struct(F.lit(None).alias("one"), F.lit(None).alias("two")).cast(kind), _last_two)
    out = joined(held, carries, key)
    one = F.coalesce("__in1", F.col("__before.one"))
    two = F.when(F.col("__in1").isNull(), F.col("__before.two")).when(F.col("__in2").isNull(), F.col("__before.one")).otherwise(F.col("__in2"))
    return out.withColumn("__one", one).withColumn("__two", two).drop(SPAN, "__row", "__in1", "__in2", "__place", "__before")


def with_neighbours(rows: DataFrame, key: str, value: str, order: str = "frame", size: int = 512, after: bool = True) -> DataFrame:
    """Add `__before` and, unless told not to, `__after`: `value` of the row before and behind in the key's order, null
    where there is none. For wide values such as frames: only the first and last of a span leave it.

    Inside a span these are lag and lead. Each span also gets the last value of the nearest earlier span that has rows
    and the first one of the nearest later span, which are found among bare numbers; so wide values are shuffled once.
    Rows that tie may come in any order.
    """
    held = with_span(rows, order, size).withColumn("__side", F.lit(0))
    ends = held.groupBy(key, SPAN).agg(F.min_by(value, F.struct(order)).alias("__first"), F.max_by(value, F.struct(order)).alias("__last"))
    spans = Window.partitionBy(key).orderBy(SPAN)
    near = held.select(key, SPAN).distinct().select(F.col(key).alias("__key"), F.col(SPAN).alias("__of"), F.lag(SPAN).over(spans).alias("__low"), F.lead(SPAN).over(spans).alias("__high"))

    def from_span(span: str, end: str, side: int) -> DataFrame:
        found = near.join(ends, F.col("__key").eqNullSafe(F.col(key)) & (F.col(span) == F.col(SPAN)))
        return found.select(F.col("__key").alias(key), F.col("__of").alias(SPAN), F.col(end).alias(value), F.lit(side).alias("__side"))

    every = held.unionByName(from_span("__low", "__last", -1), allowMissingColumns=True)
    if after:
        every = every.unionByName(from_span("__high", "__first", 1), allowMissingColumns=True)
    w = inside(key, "__side", order)
    every = every.withColumn("__before", F.lag(value).over(w))
    if after:
        every = every.withColumn("__after", F.lead(value).over(w))
    return every.filter("__side = 0").drop(SPAN, "__side")


def with_running(rows: DataFrame, key: str, sums: dict[str, Column], order: tuple[str, ...] = ("frame",), size: int = SIZE) -> DataFrame:
    """Add running sums (the row included) of the given columns: counts as longs, exact numbers as decimals."""
    held = with_span(rows, order[0], size)
    w = inside(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    for name, value in sums.items():
        held = held.withColumn(f"__x_{name}", value)
    totals = held.groupBy(key, SPAN).agg(F.struct(*[F.coalesce(F.sum(f"__x_{n}"), F.lit(0)).alias(n) for n in sums]).alias("__v"))
    kind = totals.schema["__v"].dataType
    zero = F.struct(*[F.lit(0).cast(kind[n].dataType).alias(n) for n in sums])
    carries = before_spans(totals, key, "__v", zero, lambda a, b: F.struct(*[(a[n] + b[n]).cast(kind[n].dataType).alias(n) for n in sums]))
    out = joined(held, carries, key)
    for name in sums:
        out = out.withColumn(name, (F.coalesce(F.sum(f"__x_{name}").over(w), F.lit(0)) + F.col(f"__before.{name}")).cast(kind[name].dataType))
    return out.drop(SPAN, "__before", *[f"__x_{n}" for n in sums])


def with_smoothed(rows: DataFrame, key: str, fresh: str, values: tuple[str, ...], alpha: float, order: tuple[str, ...] = ("frame",), reach: int = 60, size: int = SIZE) -> DataFrame:
    """Add `session`, the number of fresh rows up to each row, and `smooth_<value>`: exponential smoothing that takes
    over the value itself at a fresh row, s = alpha * v + (1 - alpha) * s elsewhere.

    Such a step is an affine map of s, and so is a whole span: s -> a * s + b, with a = 0 once a row is fresh. A row
    adds its span's map so far to what the spans before end with. Inside a span b is folded over `reach` rows, which
    hold all that a double can: (1 - alpha) ** reach is below 1e-17. A null value leaves s as it is.
    """
    if not 0 < alpha <= 1 or (1 - alpha) ** reach > 1e-17:
        raise ValueError("reach is too short for this alpha")
    w = inside(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    held = with_span(rows, order[0], size).withColumn("__session", F.count_if(fresh).over(w))
    back = Window.partitionBy(key, SPAN, "__session").orderBy(*order).rowsBetween(-(reach - 1), 0)
    started = F.col("__session") > 0
    for v in values:
        listed = F.collect_list(v).over(back)
        fold = lambda c: F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.get(c, 0) * F.when(started, 1.0).otherwise(alpha), lambda s, x: alpha * x + (1 - alpha) * s)
        held = held.withColumn(f"__list_{v}", listed).withColumn(f"__b_{v}", F.coalesce(fold(F.col(f"__list_{v}")), F.lit(0.0)))
        held = held.withColumn(f"__a_{v}", F.when(started, 0.0).otherwise(F.pow(F.lit(1 - alpha), F.count(v).over(w)))).drop(f"__list_{v}")
    maps = [f(v) for v in values for f in (lambda v: f"__a_{v}", lambda v: f"__b_{v}")]
    state = F.struct(F.col("__session").alias("n"), *[F.col(m).alias(m[2:]) for m in maps])
    totals = held.groupBy(key, SPAN).agg(F.max_by(state, F.struct(*order)).alias("__v"))

    def then(f: Column, g: Column) -> Column:
        parts = [c for v in values for c in ((g[f"a_{v}"] * f[f"a_{v}"]).alias(f"a_{v}"), (g[f"a_{v}"] * f[f"b_{v}"] + g[f"b_{v}"]).alias(f"b_{v}"))]
        return F.struct((f["n"] + g["n"]).alias("n"), *parts)

    zero = F.struct(F.lit(0).cast("long").alias("n"), *[c for v in values for c in (F.lit(1.0).alias(f"a_{v}"), F.lit(0.0).alias(f"b_{v}"))])
    out = joined(held, before_spans(totals, key, "__v", zero, then), key)
    for v in values:
        out = out.withColumn(f"smooth_{v}", F.col(f"__a_{v}") * F.col(f"__before.b_{v}") + F.col(f"__b_{v}"))
    return out.withColumn("session", F.col("__session") + F.col("__before.n")).drop(SPAN, "__session", "__before", *maps)
