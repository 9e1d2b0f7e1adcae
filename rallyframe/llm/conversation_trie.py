"""Prefix trie of conversations: which openings are shared, how often, and what sharing them saves.

A node is a distinct sequence of first turns (role, text); the root is the empty one. Nodes are keyed by a digest
of their prefix, edges lead from a prefix to the one shorter by a turn. Subtree sums come by pointer jumping:
each round every node hands its sum to the ancestor it points at and then points twice as far, so a tree of depth
d takes about log2(d) rounds, however long a conversation is.

Defined results: a null role or text counts as empty; rows without a conversation id take no part; null turns come
first; rows of equal turns are ordered by the digest of role and text, wholly equal rows stay as turns of their
own; no conversations give no nodes, not even a root. Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stored

#: Turns of a conversation that one sorted run holds; longer ones are chained run by run.
SPAN = 1024
#: Conversation ids of a node that are joined into one piece before they are hashed.
PIECE = 4096
ROOT = hashlib.sha256(b"").digest()


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place from 1, item digest, n_words) of each turn.

    Rows are dealt by range, so that a conversation with any share of all rows spreads. A range numbers its own
    rows; the only conversation that can have begun before it is its first one, so that the carried counts are at
    most as many as the ranges.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.array_remove(F.split(text, SPACE + "+"), "")).cast("long")
    slim = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("item"),
        words.alias("n_words"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("item"), F.col("tie")]
    ranged = slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    local = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order[1:])).cast("long")
    rows = stored(ranged.withColumn("local", local).drop("tie", "turn"), "numbered_turns")
    held = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = held.withColumn("before", before).where("before > 0").select("conv_id", "part", "before")
    return rows.join(F.broadcast(carried), ["conv_id", "part"], "left").select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("place"), "item", "n_words")


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of each row's prefix within its run; the rows come sorted by (conv_id, place)."""
    at, digest = None, b""
    for pdf in batches:
        after, before = [], []
        for run, item in zip(zip(pdf["conv_id"], pdf["run"], strict=True), pdf["item"], strict=True):
            if run != at:
                at, digest = run, ROOT
            before.append(digest)
            digest = hashlib.sha256(digest + bytes(item)).digest()
            after.append(digest)
        yield pdf.assign(digest=after, parent=before)


def prefixes(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """Add digest (of the first `place` items) and parent (of one item fewer); places count from 1 without gaps.

    A conversation is cut into runs of `span` places. Digests are chained within a run; the runs' last digests are
    items themselves, whose prefixes are computed in the same way, and each row's digest is that of the runs before
    it with its own. Equal beginnings are cut alike, so they get equal digests.
    """
    run = ((F.col("place") - 1) / span).cast("long")
    cut = rows.withColumn("run", run).repartition("conv_id", "run").sortWithinPartitions("conv_id", "place")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    within = cut.mapInPandas(_chained, f"{fields}, digest binary, parent binary")
    if not rows.where(F.col("place") > span).take(1):
        return within.drop("run")
    within = stored(within, "prefixes_within_runs")
    last = within.where((F.col("place") % span) == 0).select("conv_id", (F.col("run") + 1).alias("place"), F.col("digest").alias("item"))
    ahead = prefixes(last, span).select("conv_id", F.col("place").alias("run"), F.col("digest").alias("ahead"))
    joined = within.join(ahead, ["conv_id", "run"], "left")

    def behind(own: str) -> Column:
        whole = F.unhex(F.sha2(F.concat("ahead", own), 256))
        return F.when(F.col("ahead").isNull(), F.col(own)).otherwise(whole)

    # A run's first row hangs from the last row of the run before, whose own digest is chained in the same way.
    tail = within.where(((F.col("place") % span) == 0) & (F.col("run") >= 0)).join(ahead, ["conv_id", "run"], "left").select("conv_id", (F.col("run") + 1).alias("run"), behind("digest").alias("tail"))
    joined = joined.join(tail, ["conv_id", "run"], "left")
    first = (F.col("place") % span == 1) & F.col("tail").isNotNull()
    return joined.select(*rows.columns, behind("digest").alias("digest"), F.when(first, F.col("tail")).otherwise(behind("parent")).alias("parent"))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's pieces, joined by commas; the pieces come sorted by (digest, piece) and are streamed,
    so that a node's ids are never held together."""
    at, state = None, None
    for pdf in batches:
        done = []
        for key, ids in zip(map(bytes, pdf["digest"]), pdf["ids"], strict=True):
            if key != at:
                if at is not None:
                    done.append((at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["digest", "ends_sha256"])
    if at is not None:
        yield pd.DataFrame([(at, state.hexdigest())], columns=["digest", "ends_sha256"])


def _ends(ends: DataFrame, piece: int) -> DataFrame:
    """(digest, ends_sha256) over (digest, conv_id). A digest over all ids in order is sequential by nature: what is
    left for one task of a hot node is a stream of strings, each of `piece` ids."""
    pieces = ends.groupBy("digest", F.floor(F.col("conv_id") / piece).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return pieces.repartition("digest").sortWithinPartitions("digest", "piece").mapInPandas(_hashed, "digest binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, sums: list[str], deepest: int) -> DataFrame:
    """Replace each column of `sums` by its sum over a node's subtree, by pointer jumping along `parent`.

    Before round k a node holds the sum of its subtree down to 2**k - 1 levels below and points at its ancestor
    2**k levels above (null beyond the root); what points at a node is exactly what it still lacks at the next levels.
    """
    level = stored(nodes.select("digest", F.col("parent").alias("jump"), *sums), "subtree_sums")
    reach = 1
    while reach <= deepest:
        given = level.where("jump IS NOT NULL").groupBy(F.col("jump").alias("digest")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
        above = level.where("jump IS NOT NULL").select(F.col("digest").alias("jump"), F.col("jump").alias("next"))
        level = level.join(given, "digest", "left").join(above, "jump", "left").select("digest", F.col("next").alias("jump"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums])
        level = stored(level, "subtree_sums")
        reach *= 2
    return level.drop("jump")


def trie(rows: DataFrame, conversations: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, digest and parent.

    `rows` as `numbered` gives them: a row per turn with places from 1 without gaps. `conversations` names all
    conv_ids where some have no turn; these are members of the root alone.
    """
    known = rows.where("place = 1").select("conv_id") if conversations is None else conversations.select("conv_id").distinct()
    paths = stored(prefixes(rows).select("conv_id", "place", "digest", "parent", "n_words"), "trie_paths")
    root = F.lit(ROOT)
    lengths = paths.groupBy("conv_id").agg(F.max_by("digest", "place").alias("digest"))
    ends = known.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("digest", root).alias("digest"))
    members = paths.select("conv_id", F.col("place").alias("depth"), "digest", "parent", "n_words").unionByName(known.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_words")))
    nodes = members.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.min("n_words").alias("n_words"))
    below = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(below, "digest", "left").join(_ends(ends, piece), "digest", "left")
    own = ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens")
    leaf = F.col("n_children").isNull().cast("long").alias("n_leaves")
    nodes = stored(nodes.select("digest", "conv_id", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), own, leaf), "trie_nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = rolled_up(nodes, ["n_leaves", "saved_tokens"], deepest)
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.drop("n_leaves", "saved_tokens").join(sums, "digest").join(parents, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "digest", "parent")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    return trie(numbered(turns))


def spliced(rows: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: each conv_id c gets the first h turns of conversation c - c % group in the
    place of its own first h, h = crc32(c) % most. Returns the rows (places without gaps) and all conv_ids.

    At most `group` conversations share a base and take fewer than `most` rows of it.
    """
    taken = (F.crc32(F.col("conv_id").cast("string")) % most).alias("taken")
    known = rows.where("place = 1").select("conv_id", taken, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = rows.where((F.col("conv_id") % group == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), "place", "item", "n_words")
    opening = known.join(bases, "base").where("place <= taken").select("conv_id", "place", "item", "n_words")
    held = bases.groupBy("base").agg(F.count(F.lit(1)).alias("held"))
    gaps = known.join(held, "base", "left").select("conv_id", (F.col("taken") - F.coalesce("held", F.lit(0))).alias("gap")).where("gap > 0")
    rest = rows.where(F.col("place") > taken).join(gaps, "conv_id", "left").select("conv_id", (F.col("place") - F.coalesce("gap", F.lit(0))).alias("place"), "item", "n_words")
    return opening.unionByName(rest), known.select("conv_id")
