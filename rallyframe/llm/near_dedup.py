"""Near-duplicate documents by min-max hashing.

Each permutation gives two signature values, the least and the greatest hash of the set, so 80 hash
evaluations an element give 160 values. Documents of equal sets form a class. Bands of five values put
classes into buckets; a bucket's sets whose signatures look similar enough, and all sets of a very large
bucket, are joined to families by linearly many edges; inside a family, links are confirmed on the full shingle
sets. Pairs are looked at inside tasks and never become rows: what leaves a bucket or a family is a spanning
forest, found by comparing each reached set with those not yet reached. A large family is cut into blocks that
all see some of its members as representatives; what then isn't in the family's main component is compared with
the members that share one of its rarest shingles, which every alike set does, or with every member where that
is less work: no link is left out, alike members cost one comparison each and unlike ones, however much boilerplate
they have in common, about none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import SPACE, rows_in, stored

SEED = 0x5EED


class WordHashes(dict):
    """64-bit hash of each word; computed once while the word stays known."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All sorted sets one after the other, and their sizes.

    A set has the distinct k-word windows of the A-Z lower-cased text; with fewer words the whole sequence
    is the one shingle; without words or text it is empty.
    """
    counts = np.zeros(len(texts), np.int64)
    parts = []
    for i, text in enumerate(texts):
        if len(hashes) > 150_000:
            hashes.clear()
        found = (text or "").encode().lower().split()  # bytes: A-Z and the contract's white space only
        counts[i] = len(found)
        parts.append(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)))
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n_windows = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), n_windows)
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(n_windows.sum())
    length = np.minimum(counts, k)[owner]
    value = np.zeros(owner.size, np.uint64)
    for j in range(k):
        inside = j < length
        at = np.where(inside, first + j, 0)
        value = np.where(inside, _mix(value * np.uint64(0x9E3779B97F4A7C15) + words[at] if words.size else value), value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if value.size:
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
        value, owner = value[new], owner[new]
    return value, np.bincount(owner, minlength=len(texts))


def signatures(values: np.ndarray, sizes: np.ndarray, permutations: int, seed: int = 7) -> np.ndarray:
    """[min, max] of each permutation for each non-empty set: uint64 of shape (sets, 2 * permutations)."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((starts.size, 2 * permutations), np.uint64)
    for p in range(permutations if starts.size else 0):
        h = values ^ shifts[p]
        h *= factors[p]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, 2 * p] = np.minimum.reduceat(h, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(h, starts)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` signature values; the band's number is hashed in."""
    bands = signature.shape[1] // rows
    out = np.empty((signature.shape[0], bands), np.uint64)
    for b in range(bands):
        key = np.full(signature.shape[0], b + 1, np.uint64)
        for r in range(rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * rows + r])
        out[:, b] = key
    return out


def compact(signature: np.ndarray) -> np.ndarray:
    """The last byte of every signature value: enough to estimate a similarity."""
    return (signature & np.uint64(255)).astype(np.uint8)


def _reached(left: np.ndarray, roots: list[int], alike) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph `alike(i, others) -> bool array`. A reached member is compared with the
    members not reached yet, and only with these. `roots` are taken first."""
    edges: list[tuple[int, int]] = []
    waiting = list(roots)
    left = np.setdiff1d(left, roots)
    while left.size or waiting:
        if not waiting:
            waiting, left = [int(left[0])], left[1:]
        i = waiting.pop()
        if not left.size:
            break
        found = alike(i, left)
        edges += [(i, int(j)) for j in left[found]]
        waiting += left[found].tolist()
        left = left[~found]
    return edges


def _likely(sig: np.ndarray, least: float):
    return lambda i, others: (sig[others] == sig[i]).mean(1) >= least


def _linked(sig: np.ndarray, sets: list[np.ndarray], least: float, percent: int):
    """Links on full sets; what the signatures and the sizes rule out isn't looked at."""
    sizes = np.array([len(x) for x in sets])
    likely = _likely(sig, least)

    def alike(i: int, others: np.ndarray) -> np.ndarray:
        n = sizes[others]
        out = likely(i, others) & (100 * np.minimum(n, sizes[i]) >= percent * np.maximum(n, sizes[i]))
        some = others[out]
        if some.size:
            shared = np.add.reduceat(np.isin(np.concatenate([sets[j] for j in some]), sets[i]), np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            out[np.flatnonzero(out)] = 100 * shared >= percent * (sizes[some] + sizes[i] - shared)
        return out

    return alike


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of a stream that is sorted by its key; a table of many small groups at once."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(key)[batch.num_rows - 1]
        at = pc.index(batch.column(key), last).as_py()
        if at == 0 and rest and rest[-1].column(key)[rest[-1].num_rows - 1] == last:
            rest.append(batch)
            continue
        if rest or at:
            yield pa.Table.from_batches([*rest, batch.slice(0, at)])
        rest = [batch.slice(at)]
    if rest:
        yield pa.Table.from_batches(rest)


def _bounds(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    ends = [*cuts.tolist(), len(keys)]
    yield from ((a, b) for a, b in zip([0, *ends], ends, strict=False) if b > a + 1)


@dataclass(frozen=True)
class NearDedup:
    """Parameters of the operator. `likely` prefilters by the signatures: five standard deviations below
    the threshold, so that a true link passes it but for some 1e-6 of cases; candidates meet in one of
    `bands` bands at least but for 3e-6 of the links of similarity 0.8. Buckets of more than `crowd` sets are
    families as they are; families of more than `block` members are confirmed in blocks of half as many, with `representatives` of them in each. An index row of a shingle costs as much as `index_pays` comparisons of signatures."""

    k: int = 5
    percent: int = 80
    permutations: int = 80
    band_rows: int = 5
    likely: float = 0.64
    block: int = 2048
    crowd: int = 256
    representatives: int = 16
    index_pays: int = 50

    @property
    def bands(self) -> int:
        return 2 * self.permutations // self.band_rows

    def profiles(self, docs: DataFrame, key: str = "doc_id", text: str = "text", sets: bool = False) -> DataFrame:
        """(doc_id, text_hash, n_shingles, node, keys, sig) of every row; `node` is a 128-bit digest of the
        set, null for the empty set. With `sets`: (node, shingles) instead."""
        body = F.coalesce(F.col(text), F.lit(""))
        rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
        kind = rows.schema["doc_id"].dataType.simpleString()
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for whole in batches:
                for batch in slices(whole, most_bytes=1 << 20):
                    values, sizes = shingle_sets(batch.column("text").to_pylist(), me.k, hashes)
                    ends = np.cumsum(sizes).tolist()
                    raw = values.tobytes()
                    cut = [raw[8 * (e - n) : 8 * e] for e, n in zip(ends, sizes.tolist(), strict=True)]
                    node = pa.array([xxhash.xxh3_128_digest(c) if c else None for c in cut], pa.binary())
                    if sets:
                        yield pa.RecordBatch.from_arrays([node, pa.array(cut, pa.binary())], ["node", "shingles"])
                        continue
                    full = np.flatnonzero(sizes > 0)
                    sig = signatures(values, sizes, me.permutations)
                    where: list[int | None] = [None] * len(cut)
                    for i, at in enumerate(full.tolist()):
                        where[at] = i
                    keys, small = band_keys(sig, me.band_rows).view(np.int64), compact(sig)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), node,
                         pa.array([None if i is None else keys[i] for i in where], pa.list_(pa.int64())),
                         pa.array([None if i is None else small[i].tobytes() for i in where], pa.binary())],
                        ["doc_id", "text_hash", "n_shingles", "node", "keys", "sig"],
                    )

        schema = "node binary, shingles binary" if sets else f"doc_id {kind}, text_hash long, n_shingles long, node binary, keys array<long>, sig binary"
        return rows.mapInArrow(run, schema)

    def families(self, classes: DataFrame) -> DataFrame:
        """Edges (a, b) between sets that share a band: in a bucket of up to `crowd` sets a spanning forest of the
        similar signatures, in a larger one all sets with its least, so edges are linear in the bucket."""
        bands = classes.select("node", F.explode("keys").alias("key"))
        shared = stored(bands.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first")).filter("members > 1"), "buckets")
        rows = stored(hub_join(bands, shared, "key", "members"), "bucketed")
        crowd = rows.filter((F.col("members") > self.crowd) & (F.col("node") != F.col("first"))).select(F.col("first").alias("a"), F.col("node").alias("b"))
        few = rows.filter(F.col("members") <= self.crowd).join(classes.select("node", "sig"), "node")
        likely = self.likely

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _groups(batches, "key"):
                nodes = table.column("node").to_pylist()
                sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(nodes), -1)
                edges: list[tuple[int, int]] = []
                for a, b in _bounds(table.column("key").to_numpy()):
                    edges += _reached(np.arange(a, b), [], _likely(sig, likely))
                yield _links(nodes, edges)

        return _by_group(few.select("key", "node", "sig"), "key").mapInArrow(run, "a binary, b binary").union(crowd).distinct()

    def confirmed(self, members: DataFrame) -> DataFrame:
        """Links (a, b) inside families, on full sets, as spanning forests. `members` has node, family, members (how
        many the family has), sig and shingles, and is read more than once."""
        small = members.filter(F.col("members") <= self.block).withColumn("group", F.xxhash64("family")).withColumn("role", F.lit(1))
        links = self._verified(small)
        if not members.filter(F.col("members") > self.block).limit(1).count():
            return links
        blocks = F.ceil(F.col("members") / (self.block // 2)).cast("int")
        large = members.filter(F.col("members") > self.block).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        first = large.filter(F.col("block") < self.representatives).groupBy("family", "block").agg(F.min("node").alias("node"))
        chosen = large.join(stored(first, "chosen").select("node"), "node", "left_semi")
        group = F.xxhash64("family", "block")
        rest = large.join(chosen.select("node"), "node", "left_anti").withColumn("group", group).withColumn("role", F.lit(1))
        every = chosen.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("group", group).withColumn("role", F.lit(0))
        near = stored(self._verified(rest.unionByName(every)), "near")
        part = large.select("node", "family").join(components(near), "node", "left").withColumn("label", F.coalesce("label", "node"))
        sizes = part.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("loose"))
        main = stored(main, "main")
        loose = stored(hub_join(part, main, "family", "members").filter(F.col("label") != F.col("main")).select("node"), "loose")
        if not loose.limit(1).count():
            return links.union(near)
        found = links.union(near)
        # Where comparing all signatures is more work than an index of the family's shingles, rare ones tell who can be alike at all.
        held = large.groupBy("family").agg((F.sum(F.octet_length("shingles")) / 8).alias("shingles"))
        indexed = stored(main.join(held, "family").filter(F.col("loose") * F.col("members") > self.index_pays * F.col("shingles")).select("family", F.col("members").alias("size")), "indexed")
        if indexed.limit(1).count():
            some = large.join(indexed, "family", "left_semi")
            prefixes, cheap = self._rare(some, loose, indexed)
            alike = self._sharing(some, prefixes.join(cheap, ["family", "id"], "left_semi"))
            if alike is not None:
                found = found.union(self._verified(alike))
            done = some.withColumn("id", _id("node")).join(cheap, ["family", "id"], "left_semi").select("node")
            loose = stored(loose.join(done, "node", "left_anti"), "scanning")
            if not loose.limit(1).count():
                return found
        # Every other loose set meets every set of its family: chunks of loose ones by blocks of all.
        left = large.join(loose, "node", "left_semi").groupBy("family").agg(F.ceil(F.count(F.lit(1)) / (self.block // 2)).cast("int").alias("chunks"))
        sized = large.join(left, "family")
        mine = sized.join(loose, "node", "left_semi")
        chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
        group = F.xxhash64("family", "block", "chunk")
        asking = mine.withColumn("chunk", chunk).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(2))
        asked = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("role", F.lit(1))
        return found.union(self._verified(asked.unionByName(asking).withColumn("group", group)))

    def _rare(self, members: DataFrame, loose: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(family, id, token) of each loose set's rarest shingles, and the (family, id) for which their posting lists
        are no longer than the family.

        A set of n shingles that is alike another shares at least ceil(percent * n / 100) with it, hence one of any
        n - ceil(...) + 1. The rarest are taken: what most of a family has in common asks for nobody.
        """
        asking = _tokens(members.join(loose, "node", "left_semi"))
        known = asking.select("family", "token").distinct()
        often = stored(_tokens(members).join(known, ["family", "token"], "left_semi").groupBy("family", "token").agg(F.count(F.lit(1)).alias("often")), "often")
        own = Window.partitionBy("family", "id")
        ranked = asking.join(often, ["family", "token"]).withColumn("n", F.count(F.lit(1)).over(own)).withColumn("at", F.row_number().over(own.orderBy("often", "token")))
        rare = stored(ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1).select("family", "id", "token", "often"), "rare")
        cost = rare.groupBy("family", "id").agg(F.sum(F.col("often") - 1).alias("cost")).join(sizes, "family")
        return rare, stored(cost.filter(F.col("cost") <= F.col("size")).select("family", "id", "cost"), "cheap")

    def _sharing(self, members: DataFrame, rare: DataFrame) -> DataFrame | None:
        """Groups of a loose set (role 2) with up to half a block of those that share one of its rarest shingles (role 1)."""
        lists = _tokens(members).join(rare.filter("often > 1").select("family", "token", F.col("id").alias("asks")), ["family", "token"])
        pairs = stored(lists.filter("id <> asks").select("family", "asks", "id").distinct(), "sharing")
        if not pairs.limit(1).count():
            return None
        sets = members.withColumn("id", _id("node")).select("family", "id", "node", "sig", "shingles")
        many = pairs.groupBy("family", "asks").agg(F.ceil(F.count(F.lit(1)) / (self.block // 2)).cast("int").alias("parts"))
        asked = pairs.join(many, ["family", "asks"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(sets, ["family", "id"]).withColumn("role", F.lit(1))
        mine = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("id", F.col("asks")).join(sets, ["family", "id"]).withColumn("role", F.lit(2))
        return asked.unionByName(mine, allowMissingColumns=True).withColumn("group", F.xxhash64("family", "asks", "part"))

    def _verified(self, rows: DataFrame) -> DataFrame:
        """Links inside groups. Rows of role 0 are compared first; where there are rows of role 2, they are compared
        with those of role 1, and these not with each other."""
        likely, percent = self.likely, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _groups(batches, "group"):
                nodes, sets = table.column("node").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
                sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(nodes), -1)
                role = table.column("role").to_numpy()
                edges: list[tuple[int, int]] = []
                for a, b in _bounds(table.column("group").to_numpy()):
                    alike = _linked(sig[a:b], sets[a:b], likely, percent)
                    mine = role[a:b]
                    if (mine == 2).any():
                        found = [(int(i), int(j)) for i in np.flatnonzero(mine == 2) for j in np.flatnonzero(mine == 1)[alike(i, np.flatnonzero(mine == 1))]]
                    else:
                        found = _reached(np.arange(b - a), np.flatnonzero(mine == 0).tolist(), alike)
                    edges += [(a + i, a + j) for i, j in _spanning(found)]
                yield _links(nodes, edges)

        return _by_group(rows.select("group", "role", "node", "sig", "shingles"), "group").mapInArrow(run, "a binary, b binary").distinct()

    def labelled(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, text_hash, n_shingles, node, class_size, label, component_id, kept) for every row.

        Rows of equal sets form a class, compared once. label names the component: its least node, null
        for the empty set. component_id is the smallest doc_id reachable over links. Rows with an empty set (null or blank text) are linked with nothing. Null keys take
        part and lose every comparison of keys. Repeated keys are all kept if their key is the component's.
        """
        profiles = stored(self.profiles(docs, key, text), "profiles")
        classes = stored(profiles.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("class_size"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "classes")
        family = components(stored(self.families(classes), "likely"))
        sizes = stored(family.groupBy("label").agg(F.count(F.lit(1)).alias("members")), "family_sizes")
        members = hub_join(family, sizes, "label", "members").select("node", F.col("label").alias("family"), "members")
        members = stored(members.join(classes.select("node", "least", "sig"), "node"), "members")
        wanted = members.select(F.col("least").alias("__least")).distinct()
        wanted = F.broadcast(wanted) if rows_in(members) <= 400_000 else wanted
        texts = docs.join(wanted, F.col(key).eqNullSafe(F.col("__least")), "left_semi")
        sets = self.profiles(texts, key, text, sets=True).dropDuplicates(["node"])
        links = stored(self.confirmed(stored(members.join(sets, "node"), "sets")), "links")
        joined = classes.select("node", "least", "class_size").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = stored(joined.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes")), "components")
        named = hub_join(joined, least, "label", "classes").select("node", "class_size", "label", "component_id")
        out = profiles.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
        out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    def kept_documents(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """One row of each component, with the columns of `docs`; rows with an empty set all stay, but of
        repeats (same key and text) one. Rows without a key aren't repeats of each other.
        """
        body = F.coalesce(F.col(text), F.lit(""))
        nameless = F.col(key).isNull() & ~body.rlike(f"[^{SPACE[1:]}")
        named = docs.filter(~nameless)
        rows = self.labelled(named, key, text).filter("kept")
        own = F.struct("doc_id", "text_hash")
        best = rows.groupBy("label", F.when(F.col("node").isNull(), own).alias("alone")).agg(F.min(own).alias("k"))
        best = stored(best.select(F.col("k.doc_id").alias("__doc"), F.col("k.text_hash").alias("__hash")), "kept")
        rows = named.withColumn("__own_hash", F.xxhash64(body))
        rows = rows.join(best, F.col(key).eqNullSafe(F.col("__doc")) & (F.col("__own_hash") == F.col("__hash")), "left_semi")
        return rows.dropDuplicates([key, "__own_hash"]).drop("__own_hash").union(docs.filter(nameless))


def _spanning(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The edges that join parts not joined by earlier ones."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for i, j in edges:
        a, b = top(i), top(j)
        if a != b:
            parent[b] = a
            out.append((i, j))
    return out


def _links(nodes: list[bytes], edges: list[tuple[int, int]]) -> pa.RecordBatch:
    ordered = [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in edges if nodes[i] != nodes[j]]
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in ordered], pa.binary()), pa.array([b for _, b in ordered], pa.binary())], ["a", "b"])


def _by_group(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(group).sortWithinPartitions(group)


def _id(node: str) -> Column:
    """A number for a set in its family; where two sets share one, both are looked at."""
    return F.conv(F.hex(F.substring(node, 1, 7)), 16, 10).cast("long")


def _tokens(members: DataFrame) -> DataFrame:
    """(family, token, id): a row for each shingle of each set."""
    kind = members.schema["family"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "shingles", 1 << 22):
                raw = batch.column("shingles").to_pylist()
                owner = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
                token = np.frombuffer(b"".join(raw), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("family").take(pa.array(owner)), pa.array(token), batch.column("id").take(pa.array(owner))], ["family", "token", "id"])

    return members.select("family", _id("node").alias("id"), "shingles").mapInArrow(run, f"family {kind}, token long, id long")


def hub_join(rows: DataFrame, facts: DataFrame, key: str, count: str, hub_rows: int = 2000, salts: int = 64, broadcast_rows: int = 400_000) -> DataFrame:
    """Inner join with one row of `facts` for each key, whose column `count` says how many rows have that key.

    Keys of more than `hub_rows` rows are dealt to `salts` tasks and their facts copied so often. Which keys these
    are is broadcast, if they are few enough; they are at most rows / hub_rows.
    """
    hubs = facts.filter(F.col(count) > hub_rows).select(key)
    n = rows_in(hubs)
    if not n or n > broadcast_rows:
        return rows.join(facts, key)
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(salts)).cast("int")
    dealt = rows.join(F.broadcast(hubs.withColumn("__hub", F.lit(True))), key, "left").withColumn("__salt", F.when(F.col("__hub"), spread).otherwise(0)).drop("__hub")
    copies = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > hub_rows, salts - 1).otherwise(0))))
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of the same components, fewer and flatter: each task joins the edges that it reads into
    stars around their least node. What a task holds is bounded by its split of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, kind = {}, None

        def top(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            kind = batch.column("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = sorted((top(a), top(b)))
                parent[b] = a
        stars = [(x, up) for x in parent if (up := top(x)) != x]
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in stars], kind) for i in (0, 1)], ["a", "b"])

    node_type = edges.schema["a"].dataType.simpleString()
    return edges.mapInArrow(run, f"a {node_type}, b {node_type}")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node with an edge; the label is the least node of its component.

    Alternating large-star and small-star steps on what `contracted` leaves; each keeps components and ends
    with stars. Every round is written to the shared folder, so a lost executor costs one round at most.
    """
    now, seen = edges.select("a", "b"), None
    for round_ in range(most_rounds):
        now = stored(contracted(now), f"contracted{round_}")
        both = now.union(now.select("b", "a"))
        least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("degree")), f"least{round_}")
        large = hub_join(both, least, "a", "degree").filter("b > a and b != m").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stored(small.select("e.a", "e.b").filter("a != b").distinct(), f"round{round_}")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == tuple(state):
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
