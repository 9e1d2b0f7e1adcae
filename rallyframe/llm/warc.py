"""Not-modified revisits of web captures, resolved by an as-of join on the canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

# Headers that a 304 response may update (RFC 9110 and RFC 9111), lower-cased.
MERGED_HEADERS = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")


def canonical_url(url: Column) -> Column:
    """Host lower-cased, scheme, `www.`, fragment, `utm_` parameters and a closing slash dropped; null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, "^[^:/?#]*://", ""), "#.*$", "")
    host, tail = F.regexp_extract(rest, "^([^/?]*)", 1), F.regexp_replace(rest, "^[^/?]*", "")
    tail = F.regexp_replace(tail, r"([?&])utm_[^&]*(&|$)", "$1")
    tail = F.regexp_replace(F.regexp_replace(tail, "[?&]+$", ""), r"/+(\?|$)", "$1")
    return F.concat(F.regexp_replace(ascii_lower(host), r"^www\.", ""), tail)


def opaque_tag(tag: Column) -> Column:
    """An entity tag without its mark of weakness: a not-modified answer compares tags weakly."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def latest_response(records: DataFrame, width: int) -> DataFrame:
    """Add `__prior`, the struct of the latest earlier full response with the same canonical URL.

    A URL may hold a third of all rows: its records fall into time ranges of `width`. A window runs in each
    range, and what a range inherits comes from a second window over one row a range.
    """
    fields = ("ts", "record_id", "etag", "last_modified", "digest")
    own = F.struct(*[F.col(c) for c in fields], F.map_entries("headers").alias("headers"))
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200), own)
    ranges = records.withColumn("__range", F.floor(F.col("ts") / width)).withColumn("__full", full)
    last = ranges.groupBy("canonical", "__range").agg(F.max("__full").alias("m"))
    before = Window.partitionBy("canonical").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("canonical", "__range", F.last("m", ignorenulls=True).over(before).alias("__carried"))
    here = Window.partitionBy("canonical", "__range").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    joined = ranges.withColumn("__local", F.max("__full").over(here)).join(carried, ["canonical", "__range"])
    found = F.coalesce("__local", "__carried")
    prior = F.when(found.isNotNull(), F.struct(*[found[c].alias(c) for c in fields], F.map_from_entries(found["headers"]).alias("headers")))
    return joined.withColumn("__prior", prior).drop("__range", "__full", "__local", "__carried")


def resolved(records: DataFrame, width: int = 86_400, merged: tuple[str, ...] = MERGED_HEADERS) -> DataFrame:
    """Resolve every revisit with status 304 to the latest earlier full response of its canonical URL.

    `records` has record_id, kind (response or revisit), url, ts (seconds), status, etag, last_modified, digest and
    headers (map<string,string>, names in lower case); other columns pass through. Added: canonical,
    outcome (`response`; `resolved`; `no_earlier`; `changed`, if a validator that both sides carry differs, where
    entity tags compare weakly;
    `unvalidated`, if they share none), resolved_id, resolved_digest and merged_headers: those of the full
    response, where a resolved revisit's own value of a permitted header wins. Records with a null URL or
    time are never matched. Of responses at one instant the greatest record_id counts.
    Columns of `records` named canonical, outcome, resolved_id, resolved_digest or merged_headers are replaced.
    """
    rows = records.withColumn("canonical", canonical_url(F.col("url")))
    usable = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    matched = latest_response(rows.filter(usable), width).unionByName(rows.filter(~usable), allowMissingColumns=True)
    is_revisit = (F.col("kind") == "revisit") & (F.col("status") == 304)
    pairs = [(opaque_tag(F.col("etag")), opaque_tag(F.col("__prior.etag"))), (F.col("last_modified"), F.col("__prior.last_modified"))]
    shared, equal = F.lit(False), F.lit(True)
    for mine, theirs in pairs:
        both = mine.isNotNull() & theirs.isNotNull()
        shared, equal = shared | both, equal & (~both | F.coalesce(mine == theirs, F.lit(False)))
    outcome = (F.when(~F.coalesce(is_revisit, F.lit(False)), F.col("kind")).when(F.col("__prior").isNull(), "no_earlier")
               .when(~equal, "changed").when(~shared, "unvalidated").otherwise("resolved"))
    out = matched.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    updates = F.map_filter(F.coalesce("headers", F.expr("cast(map() as map<string,string>)")), lambda k, v: F.lower(k).isin(*merged) & v.isNotNull())
    older = F.map_filter(F.coalesce("__prior.headers", F.expr("cast(map() as map<string,string>)")), lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    out = out.withColumn("resolved_id", F.when(ok, F.col("__prior.record_id"))).withColumn("resolved_digest", F.when(ok, F.col("__prior.digest")))
    return out.withColumn("merged_headers", F.when(ok, F.map_concat(older, updates)).otherwise(F.col("headers"))).drop("__prior")


def captures(pages: DataFrame) -> DataFrame:
    """A crawl of `pages`: each page is a full response at time 10 * page_id, and its URL is asked again 7 s and
    1000 s later, where the server answers 304. As in real crawls, of the first revisits every fifth carries another
    entity tag and every third the same one as a strong tag; every seventh page's late revisit carries none and every
    eleventh's a later date. Every fourth page has no date. Answers renew `cache-control` and `expires`, and name
    another `server` and type, which aren't theirs to change."""
    digest = F.sha1(F.coalesce("html", F.lit("")))
    base = pages.select("page_id", "url", digest.alias("digest"), F.explode(F.array(F.lit(0), F.lit(7), F.lit(1000))).alias("after"))
    page, after, first = F.col("page_id"), F.col("after"), F.col("after") == 0
    own = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit('"'))
    weak = F.concat(F.lit("W/"), own)
    tag = F.when(first, weak).when((after == 7) & (page % 5 == 0), F.lit('W/"other"')).when((after == 7) & (page % 3 == 0), own).when((after == 1000) & (page % 7 == 0), F.lit(None)).otherwise(weak)
    changed = F.concat(F.lit("day "), (page + F.when((after == 1000) & (page % 11 == 0), 1).otherwise(0)).cast("string"))
    rows = base.select(
        F.concat_ws("-", page.cast("string"), after.cast("string")).alias("record_id"), F.when(first, "response").otherwise("revisit").alias("kind"), "url",
        (10 * page + after).alias("ts"), F.when(first, 200).otherwise(304).alias("status"), tag.alias("etag"), F.when(page % 4 != 0, changed).alias("last_modified"), F.when(first, F.col("digest")).alias("digest"), "after",
    )
    headers = {"date": F.col("ts").cast("string"), "content-type": F.when(first, "text/html").otherwise("text/plain"), "server": F.when(first, "one").otherwise("two"), "cache-control": F.concat(F.lit("max-age="), after.cast("string")), "expires": F.when(after == 1000, F.col("ts").cast("string"))}
    return rows.withColumn("headers", F.map_filter(F.create_map(*[x for k, v in headers.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())).drop("after")
