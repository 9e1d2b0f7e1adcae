"""Line dedup over a sharded minimal perfect hash.

The distinct frequent line keys are dealt into shards by hash. Each shard gets a minimal perfect hash that
indexes compact arrays: a fingerprint, the document count and the largest document id. Documents probe
the arrays and drop lines; lines are not joined. Tables up to a checked size are broadcast; beyond that,
hashed keys visit the shards' tables and only the dropped keys travel back.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import rows_in, stored

# Fixed value: the white space that is stripped from a line's ends.
ENDS = " \t\n\v\f\r"
NO_ID = -(1 << 63)


def line_keys(text: str | None, least_chars: int) -> list[tuple[int, int] | None]:
    """128 bits for each line's key, or None where the key is too short to count."""
    out: list[tuple[int, int] | None] = []
    for line in (text or "").split("\n"):
        line = line.strip(ENDS)
        if len(line) < least_chars:
            out.append(None)
        else:
            h = xxhash.xxh3_128_intdigest(line.encode().lower())
            out.append(((h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63)))
    return out


class MinimalHash:
    """Minimal perfect hash of distinct 64-bit keys: cascading bit arrays, a key's slot is the rank of its bit."""

    def __init__(self, keys: np.ndarray, load: float = 1.7):
        self.sizes, bits, left, level = [], [], keys.view(np.uint64), 0
        while left.size:
            size = max(64, int(load * left.size))
            at = self._place(left, level, size)
            one = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            bits.append(one)
            left = left[~one[at]]
            level += 1
            if level > 200:
                raise ValueError("keys are not distinct")
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.bits = np.packbits(flat)
        self.flat: np.ndarray | None = None

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for a key that isn't in the set."""
        if self.flat is None:
            flat = np.unpackbits(self.bits)[: sum(self.sizes)].astype(bool)
            self.flat = np.where(flat, np.cumsum(flat) - 1, -1).astype(np.int32)
        out, first = np.full(keys.size, -1, np.int64), 0
        keys = keys.view(np.uint64)
        for level, size in enumerate(self.sizes):
            open_ = np.flatnonzero(out < 0)
            if not open_.size:
                break
            out[open_] = self.flat[first + self._place(keys[open_], level, size)]
            first += size
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"flat": None}


def shard_table(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> bytes:
    """A shard's minimal hash and its arrays, in slot order."""
    table = MinimalHash(h1 ^ (h2 << np.int64(1)))
    order = np.argsort(table.slots(h1 ^ (h2 << np.int64(1))))
    return pickle.dumps((table, h2[order] ^ h1[order], counts[order].astype(np.int64), keep[order]))


def probe(table: tuple, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document count (0 for a key not in the set) and largest document id of each key."""
    index, fingerprint, counts, keep = table
    slot = index.slots(h1 ^ (h2 << np.int64(1)))
    known = slot >= 0
    slot = np.where(known, slot, 0)
    known &= (fingerprint[slot] == (h2 ^ h1)) if fingerprint.size else False
    return np.where(known, counts[slot] if counts.size else 0, 0), np.where(known, keep[slot] if keep.size else NO_ID, NO_ID)


def frequent_keys(docs: DataFrame, key: str, text: str, least_docs: int, least_chars: int) -> DataFrame:
    """(h1, h2, n_docs, keep) of the keys that at least `least_docs` rows hold; counted over all rows.

    A task sums up its batch before the shuffle, so a line that most documents hold costs one row a batch.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found: dict[tuple[int, int], list[int]] = {}
                for doc, text_ in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for k in set(line_keys(text_, least_chars)) - {None}:
                        if held := found.get(k):
                            held[0] += 1
                            held[1] = max(held[1], doc)
                        else:
                            found[k] = [1, doc]
                columns = [[k[0] for k in found], [k[1] for k in found], [v[0] for v in found.values()], [v[1] for v in found.values()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h1", "h2", "n", "keep"])

    each = rows.mapInArrow(run, "h1 long, h2 long, n long, keep long")
    return each.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.max("keep").alias("keep")).filter(F.col("n_docs") >= least_docs)


def _tables(keys: DataFrame, shards: int) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        table = shard_table(*[pdf[c].to_numpy(np.int64) for c in ("h1", "h2", "n_docs", "keep")])
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "table": [table]})

    return keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, table binary")


def _rewrite(docs: DataFrame, key: str, text: str, least_chars: int, verdicts) -> DataFrame:
    """Run `verdicts(batch, keys)`, the dropped keys of each row, and take their lines out of the text."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "__dropped")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own) + ", n_lines long, n_dropped long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                texts = [t or "" for t in batch.column(text).to_pylist()]
                keys = [line_keys(t, least_chars) for t in texts]
                kept, n_lines, n_dropped = [], [], []
                for t, ks, drop in zip(texts, keys, verdicts(batch, keys), strict=True):
                    lines = t.split("\n")
                    stay = [line for line, k in zip(lines, ks, strict=True) if k is None or k not in drop] if drop else lines
                    kept.append("\n".join(stay) if drop else t)
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                columns = [pa.array(kept, pa.string()) if c == text else batch.column(c) for c in own]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*own, "n_lines", "n_dropped"])

    return docs.mapInArrow(run, schema)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = 3, least_chars: int = 20, keys_per_shard: int = 50_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """`docs` with lines dropped from the text, and n_lines and n_dropped added.

    A key is the line without white space at its ends, A-Z lower-cased. Keys of `least_chars` code points
    in at least `least_docs` rows lose all lines but those of rows with the largest id that holds them; a
    null id is below all others. Null text counts as empty: one empty line. Repeated rows count as so many
    documents, and share an id, so they keep or lose lines alike. Columns n_lines and n_dropped in `docs`
    are replaced.
    The key is a number or text that reads as a whole number: ids are compared as longs, and other text raises.
    """
    keys = stored(frequent_keys(docs, key, text, least_docs, least_chars), "line_keys")
    shards = max(1, -(-rows_in(keys) // keys_per_shard))
    tables = stored(_tables(keys, shards), "line_tables")
    size = tables.agg(F.coalesce(F.sum(F.octet_length("table")), F.lit(0)).alias("n")).first()["n"]
    id_of = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))
    if size <= broadcast_bytes:
        shared = docs.sparkSession.sparkContext.broadcast({r["shard"]: r["table"] for r in tables.collect()})
        opened: dict[int, tuple] = {}

        def verdicts(batch: pa.RecordBatch, found: list) -> list[set]:
            flat = [(i, k) for i, ks in enumerate(found) for k in set(ks) - {None}]
            out: list[set] = [set() for _ in found]
            if not flat:
                return out
            h = np.array([k for _, k in flat], np.int64)
            docs_ = np.array([NO_ID if d is None else d for d in batch.column(key).to_pylist()], np.int64)[[i for i, _ in flat]]
            shard = h[:, 0] % shards
            for s in np.unique(shard).tolist():
                if s in shared.value:
                    if s not in opened:
                        opened[s] = pickle.loads(shared.value[s])
                    at = np.flatnonzero(shard == s)
                    n, keep = probe(opened[s], h[at, 0], h[at, 1])
                    for j in at[(n >= least_docs) & (keep != docs_[at])].tolist():
                        out[flat[j][0]].add(flat[j][1])
            return out

        return _rewrite(docs, key, text, least_chars, verdicts)

    # Many tables: hashed keys go to the tables, in salted groups of bounded size, and dropped keys come back.
    rows = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    probes = stored(_probes(rows.select(id_of.alias("doc"), "__hash", F.coalesce(F.col(text), F.lit("")).alias("text")), shards, least_chars), "line_probes")
    load = probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / 200_000).cast("int").alias("salts"))
    salted = probes.join(load, "shard").withColumn("salt", F.pmod(F.xxhash64("doc", "__hash", "h2"), F.col("salts")).cast("int")).drop("salts")
    copies = tables.join(load.withColumnRenamed("salts", "copies"), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")

    def visit(mine: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or table.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("doc", "__hash", "h1", "h2")})
        n, keep = probe(pickle.loads(table["table"].iloc[0]), mine["h1"].to_numpy(np.int64), mine["h2"].to_numpy(np.int64))
        return mine[(n >= least_docs) & (keep != mine["doc"].to_numpy())][["doc", "__hash", "h1", "h2"]]

    lost = salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(visit, "doc long, __hash long, h1 long, h2 long")
    lost = lost.groupBy(F.col("doc").alias("__doc"), F.col("__hash").alias("__text_hash")).agg(F.collect_set(F.struct("h1", "h2")).alias("__dropped"))
    joined = rows.join(lost, (id_of == F.col("__doc")) & (F.col("__hash") == F.col("__text_hash")), "left").drop("__doc", "__text_hash", "__hash")
    return _rewrite(joined, key, text, least_chars, lambda batch, found: [{(d["h1"], d["h2"]) for d in drop or ()} for drop in batch.column("__dropped").to_pylist()])


def _probes(rows: DataFrame, shards: int, least_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out = [(d, h, *k) for d, h, t in zip(*[batch.column(c).to_pylist() for c in ("doc", "__hash", "text")], strict=True) for k in set(line_keys(t, least_chars)) - {None}]
                columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "__hash", "h1", "h2"])

    found = rows.mapInArrow(run, "doc long, __hash long, h1 long, h2 long").distinct()
    return found.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
