"""Order MinHash fingerprints, sensitive to edit distance, in built-in functions.

A text's k-mers are windows of k pieces, numbered by occurrence. A selection takes, under each of two
permutations of its own, the minimal one of all numbered k-mers, puts the two in text order and hashes the
tuple: two texts agree in a selection only if they share both k-mers and their order. Pieces are words with the
white space behind them, and ideographs, so that every character belongs to one. A longer piece is cut by its
content, where a hash of two neighbouring characters says so: in every script, an edit in a text without spaces
changes only the k-mers around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

# Fixed values of the method: from U+2E80 on every character is a piece; a piece of more than LONG characters is cut
# where one in CUT_IN pairs of neighbours is met, and after CHUNK characters at the latest.
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D\x{2E80}-\x{10FFFF}]"
PIECE = rf"(?:[\x{{2E80}}-\x{{10FFFF}}]|{_WORD}++){_SPACE}*+|{_SPACE}++"
LONG, CUT_IN, CHUNK = 24, 8, 32
#: A place takes the bits that any array's index needs.
PLACE_BITS = 31


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`: inside a lambda, a plain column may be inlined and computed for each element."""
    return F.transform(F.array(value), body)[0]


def _by_content(piece: Column) -> Column:
    """A long piece as an array of shorter ones."""

    def parts(chars: Column) -> Column:
        n = F.size(chars)
        cut = lambda j: (j == n) | (F.pmod(F.xxhash64(F.get(chars, j - 2), F.get(chars, j - 1)), F.lit(CUT_IN)) == 0)
        ends = F.filter(F.sequence(F.lit(2), n), cut)
        start = lambda e, r: F.coalesce(F.when(r > 0, F.get(e, r - 1)), F.lit(0))
        return _let(ends, lambda e: F.transform(e, lambda j, r: F.array_join(F.slice(chars, start(e, r) + 1, j - start(e, r)), "")))

    whole = _let(F.regexp_extract_all(piece, F.lit("(?s)."), F.lit(0)), parts)
    return F.flatten(F.transform(whole, lambda p: F.regexp_extract_all(p, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))


def with_kmers(df: DataFrame, text: str, out: str, k: int = 3) -> DataFrame:
    """Replace the text by an array of the hashes of its occurrence-numbered k-mers in text order.

    A text of fewer than k pieces counts as one k-mer, one without pieces has none. Only texts with a repeated
    k-mer sort, to number it.
    """
    own = [F.col(f"`{c}`") for c in df.columns if c not in (out, text)]
    empty = F.expr("cast(array() as array<bigint>)")
    step = df.select(*own, F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)).alias("__w"))
    long = lambda w: F.length(w) > LONG
    cut = F.flatten(F.transform("__w", lambda w: F.when(long(w), _by_content(w)).otherwise(F.array(w))))
    step = step.select(*own, F.when(F.exists("__w", long), cut).otherwise(F.col("__w")).alias("__w"))
    n = F.size("__w")
    word = lambda i: F.get("__w", i)
    kmers = F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[word(i + j) for j in range(k)])))
    step = step.select(*own, kmers.when(n > 0, F.array(F.xxhash64(F.array_join("__w", "")))).otherwise(empty).alias("__g"))
    pairs = F.sort_array(F.transform("__g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    step = step.select(*own, "__g", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), pairs).alias("__s"))
    ends = F.filter(F.sequence(F.lit(1), F.size("__s")), lambda j: (j == F.size("__s")) | (F.get("__s", j)["x"] != F.get("__s", j - 1)["x"]))
    step = step.select(*own, "__g", "__s", F.when(F.col("__s").isNotNull(), ends).alias("__e"))
    before = lambda r: F.coalesce(F.when(r > 0, F.get("__e", r - 1)), F.lit(0))
    run = lambda e, r: F.slice("__s", before(r) + 1, e - before(r))
    numbered = F.flatten(F.transform("__e", lambda e, r: F.transform(run(e, r), lambda p, o: F.struct(p["i"].alias("i"), F.when(o > 0, F.xxhash64(p["x"], o)).otherwise(p["x"]).alias("h")))))
    return step.select(*own, F.when(F.col("__s").isNull(), F.col("__g")).otherwise(F.transform(F.sort_array(numbered), lambda p: p["h"])).alias(out))


def signatures(df: DataFrame, keys: list[str], kmers: str, out: str, selections: int = 32) -> DataFrame:
    """(keys, out): an array of ints, one for each selection, null for a text without k-mers.

    A minimum is one long, the upper 33 bits of the permuted hash over the k-mer's place, so the aggregate runs
    on primitive values. Of k-mers whose 33 bits are equal the earlier one counts. If `df` is partitioned by some of
    the keys, nothing moves.
    """
    place = (1 << PLACE_BITS) - 1
    rows = df.select(*keys, F.posexplode_outer(kmers).alias("__at", "__h"))
    drawn = lambda i: F.xxhash64("__h", F.lit(i)).bitwiseAND(F.lit(~place)).bitwiseOR(F.col("__at").cast("long"))
    least = rows.groupBy(*keys).agg(*[F.min(F.when(F.col("__h").isNotNull(), drawn(i))).alias(f"__m{i}") for i in range(2 * selections)])

    def tuple_of(i: int) -> Column:
        a, b = F.col(f"__m{2 * i}"), F.col(f"__m{2 * i + 1}")
        in_order = a.bitwiseAND(F.lit(place)) <= b.bitwiseAND(F.lit(place))
        return F.when(a.isNotNull(), F.hash(F.shiftrightunsigned(a, PLACE_BITS), F.shiftrightunsigned(b, PLACE_BITS), in_order))

    return least.select(*keys, F.array(*[tuple_of(i) for i in range(selections)]).alias(out))


def shown(signature: Column) -> Column:
    """The fingerprint as text: 8 hex digits a selection, dashes for a text without k-mers."""
    return F.array_join(F.transform(signature, lambda v: F.coalesce(F.lower(F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), F.lit("-" * 8))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal selections; 1 if neither text has k-mers, 0 if one has none."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int"))
    return _let(same, lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + x) / F.size(v))


def with_next(df: DataFrame, key: str, column: str, rows_per_bucket: int = 20_000, most_buckets: int = 100_000) -> DataFrame:
    """Add bucket, row, is_copy and next_<column> from the row with the next key; after the last comes the first.

    No task sees the whole order. Rows fall into ranges of the numeric key, cut at its approximate quantiles and
    evenly between them; a key of a thousandth of all rows or more has ranges of its own, cut by a number that
    is random for each row, as the order of equal keys is free. The first row of a range is also sent to the range
    before, as a copy behind its last row. Null keys come first. One row for each range, `most_buckets` of them or
    so, reaches the driver and is broadcast. `row` numbers a range in order.
    """
    spark = df.sparkSession
    coarse = 1000
    spread = F.xxhash64(F.monotonically_increasing_id())
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("known"), F.percentile_approx(F.col(key), [i / coarse for i in range(coarse + 1)], 10_000).alias("q")).first()
    marks, rows_ = list(stats["q"] or []), stats["n"]
    buckets = min(most_buckets, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows_ // rows_per_bucket))
    hot = sorted({a for a, b in zip(marks, marks[1:], strict=False) if a == b}) if rows_ >= 4 * coarse else []  # a repeat then means repeated keys
    df = df.withColumn("__spread", spread)
    told: set = set()
    if hot or stats["known"] < rows_ - 1:  # rows of one key are told apart by numbers that mustn't change between jobs
        df = stored(df, "spread_rows")
        told = {*hot, None}
    cuts = sorted({*marks[:: max(1, coarse // 50)], *hot})
    fine = max(1, buckets // max(1, len(cuts)))
    bucket = F.lit(0)
    for c, low in enumerate(cuts):
        width = max(1, (cuts[c + 1] if c + 1 < len(cuts) else low + 1) - low)
        inside = F.least(F.floor((F.col(key).cast("double") - F.lit(float(low))) * (fine / width)), F.lit(fine - 1))
        first = 1 + 2 * c * fine
        bucket = F.when(F.col(key) >= low, F.lit(first + fine) + F.greatest(inside, F.lit(0))).otherwise(bucket)
        if low in hot:
            share = F.shiftright((F.shiftright("__spread", 32).cast("long") + (1 << 31)) * fine, 32)
            bucket = F.when(F.col(key) == low, F.lit(first) + share).otherwise(bucket)
    rows = df.withColumn("__bucket", bucket.cast("long"))
    order = [F.col(key).asc_nulls_first(), F.col("__spread")]
    least = F.min(F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("k"), F.col("__spread").alias("s")))
    firsts = sorted(((r["__bucket"], r["first"]["k"], r["first"]["s"]) for r in rows.groupBy("__bucket").agg(least.alias("first")).collect()), key=lambda f: f[0])
    kind = df.schema[key].dataType.simpleString()
    seam = spark.createDataFrame([(k, s if k in told else None, firsts[i - 1][0]) for i, (_, k, s) in enumerate(firsts)], f"__k {kind}, __s long, __before long")
    rows = rows.join(F.broadcast(seam), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__s").isNull() | (F.col("__spread") == F.col("__s"))), "left")
    place = F.array(F.struct(F.col("__bucket").alias("bucket"), F.lit(False).alias("is_copy")), F.when(F.col("__before").isNotNull(), F.struct(F.col("__before").alias("bucket"), F.lit(True).alias("is_copy"))))
    rows = rows.select(*df.columns, F.inline(F.array_compact(place)))
    line = Window.partitionBy("bucket").orderBy("is_copy", *order)
    following = F.coalesce(F.lead(column).over(line), F.first(column).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("*", F.row_number().over(line).alias("row"), following.alias(f"next_{column}")).drop("__spread")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last floor(n/2) code points replaced by the first as many, or all, of the next
    document. Null text counts as empty. A single document is its own next. The key is numeric; rows of equal or
    null keys follow each other in a free order. Texts move once, to the range of their key; their k-mers
    are selected where they lie.
    """
    rows = with_next(docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")), "doc_id", "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(~F.col("is_copy"), F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half)))
    rows = rows.select("bucket", "row", "is_copy", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("sha", F.sha2("edited", 256))
    keys = ["bucket", "row", "is_copy", "doc_id", "n_chars", "sha"]
    bodies = F.array_compact(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.when(~F.col("is_copy"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))))
    kmers = with_kmers(rows.select(*keys, F.inline(bodies)), "body", "kmers")
    each = signatures(kmers, [*keys, "which"], "kmers", "sig")
    of = lambda w: F.max(F.when(F.col("which") == w, F.col("sig")))
    both = each.groupBy(*keys).agg(of(0).alias("sig"), of(1).alias("edited_sig"))
    line = Window.partitionBy("bucket").orderBy("row")
    following = F.coalesce(F.lead("sig").over(line), F.first("sig").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("next_sig", following).filter(~F.col("is_copy"))
    return both.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), shown(F.col("sig")).alias("fingerprint"), shown(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
