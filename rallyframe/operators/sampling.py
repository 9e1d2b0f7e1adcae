"""Deterministic selections: every order ends in a unique key, so no result depends on partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

ORDER = ("clip_id", "frame", "rank", "candidate_id")


def _starts(sums: DataFrame, level: str) -> DataFrame:
    """(level, __more): the sum of all earlier levels. Levels are dealt by range; what the ranges before add up to is
    one number for each partition, which passes the driver."""
    ranged = cut(sums.repartitionByRange(level).withColumn("__range", F.spark_partition_id()))
    starts, before = [], 0
    for r in sorted(ranged.groupBy("__range").agg(F.sum("__sum").alias("n")).collect()):
        starts.append((r["__range"], before))
        before += r["n"]
    ahead = F.element_at(F.create_map(*[F.lit(v).cast("bigint") for pair in starts for v in pair]), F.col("__range").cast("bigint")) if starts else F.lit(0).cast("bigint")
    earlier = Window.partitionBy("__range").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.select(level, (F.coalesce(F.sum("__sum").over(earlier), F.lit(0)) + ahead).alias("__more"))


def numbered(rows: DataFrame, order: tuple[str, ...], name: str, parts: tuple[str, ...], within: tuple[str, ...] = ()) -> DataFrame:
    """Number rows 0..n-1 in each `within`, over a total order that begins with `parts`, without a task for all rows.

    Rows are numbered inside their part, and the counts of earlier parts are added level by level: parts under the
    same leading columns, then these under theirs. A last part that is a number gets a level of 1000 of them, so
    no window holds the parts of a large group; without `within`, the leading parts are dealt by range. Parts aren't
    null.
    """
    keys = [*within, *parts]
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in order if c not in keys])) - 1
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    levels = list(parts)
    if dict(counts.dtypes)[parts[-1]] in ("int", "bigint"):
        counts = counts.withColumn("__thousand", F.expr(f"`{parts[-1]}` div 1000"))
        levels.insert(len(parts) - 1, "__thousand")
    before = counts.withColumn("__before", F.lit(0).cast("bigint"))
    for i, level in enumerate(levels):
        lead = [*within, *levels[:i]]
        sums = counts.groupBy(*lead, level).agg(F.sum("__n").alias("__sum"))
        if lead:
            earlier = Window.partitionBy(*lead).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
            more = sums.select(*lead, level, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__more"))
        else:
            more = _starts(sums, level)
        before = before.join(more, [*lead, level]).withColumn("__before", F.col("__before") + F.col("__more")).drop("__more")
    before = before.select(*keys, "__before")
    return rows.withColumn("__local", local).join(before, keys).withColumn(name, F.col("__before") + F.col("__local")).drop("__local", "__before")


def lowest_per_frame(rows: DataFrame, keys: DataFrame, per_frame: int) -> DataFrame:
    """The first rows of every key frame; a frame with too few of them raises an error."""
    if per_frame <= 0:
        raise ValueError("per_frame must be positive")
    w = Window.partitionBy("clip_id", "frame")
    place = rows.join(keys.select("clip_id", "frame").distinct(), ["clip_id", "frame"], "right").withColumn("__n", F.count("rank").over(w)).withColumn("place", F.row_number().over(w.orderBy("rank", "candidate_id")))
    enough = F.when(F.col("__n") >= per_frame, True).otherwise(F.raise_error(F.concat(F.lit("too few candidates in frame "), F.col("frame").cast("string"))).cast("boolean"))
    return place.filter(enough & (F.col("place") <= per_frame)).drop("__n")


def round_robin(rows: DataFrame, budget: int) -> DataFrame:
    """One row of each frame in turn, by depth and then frame, until the budget is used.

    A row's depth is its place in its frame, found once and stored. Depths are counted first; all rows of the depths
    that fit go, and only the last depth is ordered to be cut.
    """
    depth = F.row_number().over(Window.partitionBy("clip_id", "frame").orderBy("rank", "candidate_id")) - 1
    deep = cut(rows.withColumn("depth", depth))
    # A row for each depth: as many as the fullest frame has rows.
    left = budget
    for r in sorted(deep.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()):
        if r["n"] > left:
            last = deep.filter(F.col("depth") == r["depth"]).orderBy("clip_id", "frame").limit(left)
            return deep.filter(F.col("depth") < r["depth"]).union(last)
        left -= r["n"]
    return deep


def bucketed_round_robin(rows: DataFrame, bucket: str, order: tuple[str, ...], buckets: tuple[str, ...], budget: int) -> DataFrame:
    """One row of each bucket a pass, buckets in the given order. A task sorts no more of a bucket than the budget."""
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    at = F.array_position(F.array(*[F.lit(b) for b in buckets]), F.col(bucket))
    some = rows.filter(F.col(bucket).isin(*buckets)).withColumn("__place", place).filter(F.col("__place") <= budget)
    return some.withColumn("pass", F.col("__place") - 1).orderBy("pass", at).limit(budget).drop("__place")


def even_indices(n: Column, k: int, to_nearest: bool = False) -> Column:
    """k indices spread over 0..n-1; all of them if k >= n. `to_nearest` rounds half to even, else down."""
    if k <= 0:
        return F.expr("cast(array() as array<bigint>)")
    every = F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)
    if k == 1:
        some = F.array(F.floor(n / 2).cast("bigint"))
    else:
        steps = F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))
        cut = (lambda v: F.bround(v).cast("bigint")) if to_nearest else (lambda v: F.floor(v).cast("bigint"))
        some = F.transform(steps, lambda i: cut(i * (n - 1) / (k - 1)))
    return F.when(n == 0, F.expr("cast(array() as array<bigint>)")).when(n <= k, every).otherwise(some)


def _lead_counts(rows: DataFrame, within: tuple[str, ...], lead: str) -> DataFrame:
    """(within, __lead, __c): how many rows have each leading value, stored. Nothing is ranked for it."""
    return cut(rows.groupBy(*within, F.col(lead).alias("__lead")).agg(F.count(F.lit(1)).alias("__c")))


def _placed(rows: DataFrame, within: tuple[str, ...], order: tuple[str, ...], name: str, counts: DataFrame, wanted: DataFrame, late: Callable[[DataFrame], DataFrame] | None = None, span: int = 4096) -> DataFrame:
    """Rows with the columns of `wanted` and their number in each `within` by `order`, but only those rows whose leading
    value holds a wanted number; `__at` in `wanted` (within, ...) lists these, null means all.

    Where a leading value starts follows from `counts` of `_lead_counts`: by spans of it if it is a number. So only the
    rows of the values that are wanted are sorted. `late` may add columns, such as others of `order`, to the rows of whole
    leading values.
    """
    number = dict(counts.dtypes)["__lead"] in ("int", "bigint", "smallint", "tinyint")
    part = F.coalesce(F.floor(F.col("__lead") / span), F.lit(-(2**62))) if number else F.coalesce(F.col("__lead").cast("string"), F.lit(""))
    held = counts.withColumn("__part", part)
    before = lambda of, by: Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy(*within, "__part").agg(F.sum("__c").alias("__s")).withColumn("__ahead", F.coalesce(F.sum("__s").over(before(within, "__part")), F.lit(0))).drop("__s")
    starts = held.withColumn("__start", F.coalesce(F.sum("__c").over(before((*within, "__part"), "__lead")), F.lit(0))).join(parts, [*within, "__part"]).withColumn("__start", F.col("__start") + F.col("__ahead"))
    holds = F.col("__at").isNull() | F.exists("__at", lambda i: (i >= F.col("__start")) & (i < F.col("__start") + F.col("__c")))
    some = cut(starts.join(wanted, list(within)).where(holds).drop("__part", "__ahead", "__c"))
    keys = some.select(*[F.col(k).alias(f"__of{i}") for i, k in enumerate(within)], F.col("__lead").alias("__of"))
    same = F.col(order[0]).eqNullSafe(F.col("__of"))
    for i, k in enumerate(within):
        same = same & (F.col(k) == F.col(f"__of{i}"))
    few = rows.join(keys.hint("shuffle_hash"), same, "left_semi")
    few = (late(few) if late else few).withColumn("__part", F.col(order[0]))
    few = few.withColumn("__local", F.row_number().over(Window.partitionBy(*within, "__part").orderBy(*(order[1:] or order))) - 1)
    known = some.select(*[F.col(k).alias(f"__of{i}") for i, k in enumerate(within)], F.col("__lead").alias("__of"), *[c for c in some.columns if c not in (*within, "__lead")])
    out = few.join(known, same).withColumn(name, F.col("__start") + F.col("__local"))
    return out.drop("__part", "__local", "__start", "__of", *[f"__of{i}" for i in range(len(within))])


def even_samples(rows: DataFrame, k: int, per: str, order: tuple[str, ...], kinds: dict[str, bool], late: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`even_sample` for every kind, a name and whether it rounds to nearest, as rows with `kind`. Rows are numbered
    once; few of them are then repeated. `late` is that of `_placed`."""
    counts = _lead_counts(rows, (per,), order[0])
    some = {kind: even_indices(F.col("__n"), k, nearest) for kind, nearest in kinds.items()}
    every = F.array_distinct(F.concat(*some.values()))
    sizes = counts.groupBy(per).agg(F.sum("__c").alias("__n")).withColumn("__at", F.when(F.col("__n") > k, every))
    placed = _placed(rows, (per,), order, "index", counts, sizes, late)
    chosen = [F.when(F.array_contains(indices, F.col("index")), F.lit(kind)) for kind, indices in some.items()]
    return placed.withColumn("kind", F.explode(F.array_compact(F.array(*chosen)))).drop("__n", "__at")


def even_sample(rows: DataFrame, k: int, per: str, order: tuple[str, ...], to_nearest: bool = False) -> DataFrame:
    """k evenly spread rows of each `per`. More than k rows give k different indices, so none is filled up."""
    return even_samples(rows, k, per, order, {"": to_nearest}).drop("kind")


def stratified_sample(rows: DataFrame, flag: str, per: str, order: tuple[str, ...], total: int = 32, most: int = 8, least: int = 0, late: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`total` rows of each `per` that has `least` of them: up to `most` flagged ones, the others unflagged, each part
    evenly spread.

    A group that can't give `total` rows is an error. `late` is that of `_placed`.
    """
    held = rows.withColumn("__flag", F.coalesce(F.col(flag), F.lit(False)))
    counts = _lead_counts(held, (per, "__flag"), order[0])
    sizes = counts.groupBy(per).agg(F.coalesce(F.sum(F.when(F.col("__flag"), F.col("__c"))), F.lit(0)).alias("__a"), F.coalesce(F.sum(F.when(~F.col("__flag"), F.col("__c"))), F.lit(0)).alias("__b"))
    few = F.least(F.col("__a"), F.lit(most))
    short = F.raise_error(F.concat(F.lit("too few rows to sample: "), F.col(per).cast("string"))).cast("bigint")
    rest = F.when(F.col("__b") < total - few, short).otherwise(total - few)
    kinds = F.inline(F.array(F.struct(F.lit(True).alias("__flag"), F.col("__a").alias("__n"), few.alias("__k")), F.struct(F.lit(False).alias("__flag"), F.col("__b").alias("__n"), rest.alias("__k"))))
    parts = sizes.where(F.col("__a") + F.col("__b") >= least).select(per, kinds).where("__k > 0")
    n, k = F.col("__n"), F.col("__k")
    spread = F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("bigint"))
    at = F.when(n <= k, F.lit(None)).when(k == 1, F.array(F.floor(n / 2).cast("bigint"))).otherwise(spread)
    placed = _placed(held, (per, "__flag"), order, "__i", counts, parts.select(per, "__flag", at.alias("__at")), late)
    return placed.where(F.col("__at").isNull() | F.array_contains("__at", F.col("__i"))).drop("__flag", "__i", "__at")


def oversampled(rows: DataFrame, flag: str, share: float, order: tuple[str, ...]) -> DataFrame:
    """Repeat flagged rows until they are `share` of the others, rounded up.

    Stands in for sampling with a generator: every row repeats equally often, and the rows of least hash
    once more. Only the two counts reach the driver.
    """
    sizes = rows.agg(F.count_if(flag).alias("a"), F.count_if(~F.col(flag)).alias("b")).first()
    have, wanted = sizes["a"], max(sizes["a"], math.ceil(sizes["b"] * share))
    flagged = rows.filter(F.col(flag))
    if not have:
        return rows.withColumn("copy", F.lit(1))
    whole = flagged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(wanted // have))))
    hashed = flagged.withColumn("__hash", F.xxhash64(*order)).withColumn("__part", F.shiftright("__hash", 44))
    turns = numbered(hashed, ("__part", "__hash", *order), "__turn", ("__part",))
    more = turns.filter(F.col("__turn") < wanted % have).drop("__hash", "__part", "__turn").select(*rows.columns).withColumn("copy", F.lit(wanted // have + 1))
    return rows.filter(~F.col(flag)).withColumn("copy", F.lit(1)).unionByName(whole).unionByName(more)


def keyed_number(*parts: Column) -> Column:
    """60 random-looking bits that depend on the parts alone, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("bigint")


def by_number(rows: DataFrame, number: Column, order: tuple[str, ...], name: str) -> DataFrame:
    """Number rows 0..n-1 by a column of `keyed_number` and then `order`, range by range of the numbers."""
    held = rows.withColumn("__number", number).withColumn("__part", F.shiftright("__number", 44))
    return numbered(held, ("__part", "__number", *order), name, ("__part",)).drop("__part", "__number")


def drawn(rows: DataFrame, n: int, order: tuple[str, ...], seed: int) -> DataFrame:
    """Exactly n draws with replacement, as rows with `copies` >= 1, each row as likely as any other at every draw.

    Draw j takes the row numbered keyed_number(seed, j) modulo the rows' count. Nothing depends on partitions or on the
    generator's earlier values: draws are made where they are needed, and a retried task draws the same. `order` is a
    unique key. Fewer rows than one are an error if draws are wanted.
    """
    total = rows.count()
    if n and not total:
        raise ValueError("there are no rows to draw from")
    number = F.pmod(keyed_number(F.lit(str(seed)), F.col("id").cast("string")), F.lit(max(total, 1)))
    draws = rows.sparkSession.range(n).groupBy(number.alias("__index")).agg(F.count(F.lit(1)).alias("copies"))
    indexed = by_number(rows, keyed_number(*[F.col(c).cast("string") for c in order]), order, "__index")
    return indexed.join(draws, "__index").drop("__index")


def training_rows(rows: DataFrame, flag: str, share: float, order: tuple[str, ...], seed: int) -> DataFrame:
    """All rows once (copy 0), and flagged ones drawn with replacement until they are `share` of all, rounded up; in a
    random order, `place` from 0. Without rows of either kind nothing is drawn. Rows with a null flag stay out."""
    if not 0 <= share < 1:
        raise ValueError("share must be at least 0 and below 1")
    sizes = rows.agg(F.count_if(F.col(flag)).alias("a"), F.count_if(~F.col(flag)).alias("b")).first()
    more = max(0, math.ceil(sizes["b"] * share / (1 - share)) - sizes["a"]) if sizes["a"] and sizes["b"] else 0
    again = drawn(rows.filter(F.col(flag)), more, order, seed).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    every = rows.filter(F.col(flag).isNotNull()).withColumn("copy", F.lit(0)).unionByName(again)
    return by_number(every, keyed_number(F.lit(str(seed)), *[F.col(c).cast("string") for c in order], F.col("copy").cast("string")), (*order, "copy"), "place")


REASONS = ("all_positive", "all_hard_negative", "top_rank_same_frame", "round_robin_visible_missing", "round_robin_invisible")


def fold_plan(rows: DataFrame, holdouts: list[str], same_frame: int = 4, missing_times: int = 2, invisible_times: int = 1) -> DataFrame:
    """The training selection of every holdout clip at once.

    All positives and hard negatives; of frames with a positive the first `same_frame` other candidates; and
    round-robin shares of the visible-missing and invisible ones, as multiples of the positives. Rows of the holdout
    and ignored rows never enter. sample_order numbers each fold.

    Rows are classed and numbered once, over all clips. A row's number in a fold is that number less the holdout's
    rows before it, which follow from the holdout's counts by class and depth: rows are multiplied by the folds only
    where they are chosen, and nothing of that is stored.
    """
    c = F.col("category")
    has = F.max(c == "positive").over(Window.partitionBy("clip_id", "frame"))
    place = F.row_number().over(Window.partitionBy("clip_id", "frame", "category").orderBy("rank", "candidate_id"))
    classed = rows.filter(c != "ignore").withColumn("__has", has).withColumn("__place", place)
    group = (F.when(c == "positive", 1).when(c == "hard_negative", 2).when((c == "same_frame") & F.col("__has") & (F.col("__place") <= same_frame), 3)
             .when(c == "visible_missing", 4).when(c == "invisible", 5))
    deep = F.when(F.col("__group") > 3, F.col("__place")).otherwise(F.lit(0))
    classed = cut(classed.withColumn("__group", group).filter("__group is not null").withColumn("__depth", deep).withColumn("__span", F.expr("frame div 256")))
    turned = numbered(classed, ("__depth", "clip_id", "__span", "frame", "rank", "candidate_id"), "__turn", ("__depth", "clip_id", "__span"), ("__group",))
    counts = cut(classed.groupBy("__group", "clip_id", "__depth").agg(F.count(F.lit(1)).alias("n")))
    # A row for each holdout and class; its list is as long as the fullest frame.
    folds = rows.sparkSession.createDataFrame([(h, g) for h in holdouts for g in range(1, 6)], "holdout_clip string, __group int")
    held = counts.groupBy(F.col("clip_id").alias("holdout_clip"), "__group").agg(F.collect_list(F.struct("__depth", "n")).alias("__held"), F.sum("n").alias("__mine"))
    totals = counts.groupBy("__group").agg(F.sum("n").alias("__total"))
    sizes = folds.join(held, ["holdout_clip", "__group"], "left").join(F.broadcast(totals), "__group", "left")
    sizes = sizes.withColumn("__rows", F.coalesce("__total", F.lit(0)) - F.coalesce("__mine", F.lit(0)))
    fold = Window.partitionBy("holdout_clip")
    positives = F.max(F.when(F.col("__group") == 1, F.col("__rows"))).over(fold)
    most = F.when(F.col("__group") == 4, missing_times * positives).when(F.col("__group") == 5, invisible_times * positives).otherwise(F.col("__rows"))
    sizes = sizes.withColumn("__most", F.least(most, "__rows"))
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__most").over(fold.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = turned.join(F.broadcast(sizes.select("holdout_clip", "__group", "__held", "__most", "__base")), "__group").filter("holdout_clip <> clip_id")
    ahead = F.filter("__held", lambda x: (x["__depth"] < F.col("__depth")) | ((x["__depth"] == F.col("__depth")) & (F.col("holdout_clip") < F.col("clip_id"))))
    before = F.coalesce(F.aggregate(ahead, F.lit(0).cast("bigint"), lambda s, x: s + x["n"]), F.lit(0))
    chosen = each.withColumn("__turn", F.col("__turn") - before).filter(F.col("__turn") < F.col("__most"))
    reason = F.get(F.array(*[F.lit(r) for r in REASONS]), F.col("__group") - 1)
    return chosen.withColumn("selection_reason", reason).withColumn("sample_order", F.col("__base") + F.col("__turn")).drop("__has", "__place", "__group", "__depth", "__span", "__turn", "__held", "__most", "__base")


def last_wins(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The last row of each key by the given columns; each task first keeps its own last rows."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("__last")).select(key, "__last.*")


def tree_digest(rows: DataFrame, key: str, number: str, digest: str, fan: int = 1000) -> DataFrame:
    """One ordered digest for each key. Digests of `fan` numbers in a row are joined and hashed, level by level, so
    no group grows with the data. Numbers are 0 or more; there are four levels, and more where they reach `fan` ** 4."""
    top = rows.agg(F.max(number)).first()[0] or 0
    levels = 4
    while fan**levels <= top:
        levels += 1
    for _ in range(levels):
        listed = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(digest).alias("d"))))
        text = F.array_join(F.transform(listed, lambda r: F.concat_ws(":", r["n"].cast("string"), r["d"])), ",")
        rows = rows.groupBy(key, F.floor(F.col(number) / fan).alias("__up")).agg(F.sha2(text, 256).alias(digest)).withColumnRenamed("__up", number)
    return rows.select(key, digest)
