"""Byte-level BPE as batched numpy merge rounds, and exact decoding.

The symbols of many words lie in one flat array. A round merges all occurrences of each word's lowest
ranked pair, looks up the pairs beside the merges by binary search over the sorted pair keys, and drops the
words that have no pair left. Long words take rounds by rank over linked symbols, where a round touches only
the pairs of its rank. Work on a table is `mapInArrow` over scan partitions: no shuffle, and a task holds one
Arrow batch and a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how this kind of tokenizer splits a text before merging.
SPLIT = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
NONE = np.int32((1 << 31) - 1)
# Fixed value: the white space of one byte.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# The class of each character of one or two bytes, as SPLIT tells them apart: letter, number, white space, other.
CLASS = np.array([next(i for i, p in enumerate((r"\p{L}", r"\p{N}", r"\p{White_Space}", ".|\n")) if regex.match(p, chr(c))) for c in range(0x800)], np.uint8)


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to, in valid UTF-8 without longer characters than two bytes."""
    kind = CLASS[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    if lead.size:
        kind[lead] = kind[lead + 1] = CLASS[(data[lead].astype(np.int32) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    return kind


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _cut(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    ends = (4 * np.cumsum(counts)).tolist()
    flat = ids.tobytes()
    return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def _left_first(hit: np.ndarray, touches: np.ndarray) -> np.ndarray:
    """Which merges of a round stay, where some touch the next one: in "aaa" the left pair merges."""
    if not touches.any():
        return np.ones(hit.size, bool)
    runs = np.flatnonzero(np.r_[True, ~touches])
    return (np.arange(hit.size) - np.repeat(runs, np.diff(np.r_[runs, hit.size]))) % 2 == 0


class ByteBPE:
    """A vocabulary file of the tokenizers library with byte-level BPE, read into arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of_char()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            tokens[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.of_byte = np.zeros(256, np.int64)
        for c, b in byte.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte_rank = self.ranks_of(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))
        self.stop = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, NONE where it never merges."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_flat(self, data: np.ndarray, owner: np.ndarray, long_word: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie one after the other, and the word (an ascending number for each byte) of each id."""
        if not data.size:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        rank = np.full(data.size, NONE, np.int32)
        rank[:-1] = np.where(owner[1:] == owner[:-1], self.byte_rank[data[:-1].astype(np.int32) << 8 | data[1:]], NONE)
        long = (np.bincount(owner) > long_word)[owner]
        parts = [merge(self.of_byte[data[m]], owner[m], rank[m]) for merge, m in ((self._by_word, ~long), (self._by_rank, long)) if m.any()]
        symbols, owners = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(owners, kind="stable")
        return symbols[order].astype(np.uint32), owners[order]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        ids, owners = self.encode_flat(np.frombuffer(b"".join(words), np.uint8), owner)
        return _cut(ids, np.bincount(owners, minlength=len(words)))

    def encode_plain(self, data: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Little-endian ids of pieces without an apostrophe, with the class of each byte's character: a match of
        SPLIT ends where the class changes, but not after the space at a piece's start."""
        new = np.zeros(data.size, bool)
        new[1:] = kind[1:] != kind[:-1]
        new[starts] = True
        second = starts[data[starts] == 32] + 1
        second = second[second < data.size]
        new[second[~np.isin(second, starts, assume_unique=True)]] = False
        word = np.cumsum(new, dtype=np.int32) - 1
        ids, owners = self.encode_flat(data, word)
        piece = np.searchsorted(starts, np.flatnonzero(new), side="right") - 1
        return _cut(ids, np.bincount(piece[owners], minlength=starts.size))

    def _by_word(self, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, words) when all pairs are merged. A round is one merge rank of every word."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while symbol.size:
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, word.size]))
            over = best == NONE
            if over.any():
                done.append((symbol[over], word[over]))
                symbol, word, rank, best = (a[~over] for a in (symbol, word, rank, best))
            hit = np.flatnonzero(rank == best)
            hit = hit[_left_first(hit, np.diff(hit) == 1)]
            symbol[hit] = self.merged[rank[hit]]
            stays = np.ones(symbol.size, bool)
            stays[hit + 1] = False
            symbol, word, rank = symbol[stays], word[stays], rank[stays]
            hit = hit - np.arange(hit.size)
            near = np.concatenate([hit, hit[hit > 0] - 1])
            after = np.minimum(near + 1, symbol.size - 1)
            rank[near] = np.where((word[near] == word[after]) & (after > near), self.ranks_of(symbol[near], symbol[after]), NONE)
        return tuple(np.concatenate([d[i] for d in done]) for i in (0, 1))

    def _by_rank(self, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for long words. A round takes the lowest rank that any word has: it is the lowest of every
        word that has it. Its places are listed, so the work is linear in the merges and not in the rounds."""
        n = symbol.size
        symbol = np.r_[symbol, -1]  # place n stands for the end of a word
        after = np.r_[np.where(np.r_[word[1:] == word[:-1], False], np.arange(1, n + 1), n), n]
        before = np.r_[np.where(np.r_[False, word[1:] == word[:-1]], np.arange(-1, n - 1), n), n]
        rank = np.r_[rank, NONE]
        listed: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def enlist(places: np.ndarray) -> None:
            ranks = rank[places]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]).tolist()
            for r, i, j in zip(ranks[cuts].tolist(), cuts, [*cuts[1:], len(places)], strict=True):
                if r in listed:
                    listed[r].append(places[i:j])
                else:
                    listed[r] = [places[i:j]]
                    heappush(waiting, r)

        enlist(np.flatnonzero(rank != NONE))
        while waiting:
            r = heappop(waiting)
            places = listed.pop(r)
            hit = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
            hit = hit[rank[hit] == r]
            if not hit.size:
                continue
            if hit.size > 1:
                hit = hit[_left_first(hit, after[hit[:-1]] == hit[1:])]
            gone = after[hit]
            symbol[hit] = self.merged[r]
            symbol[gone], rank[gone] = -1, NONE
            after[hit] = after[gone]
            before[after[hit]] = hit
            near = np.concatenate([hit, before[hit]])
            near = near[near != n]
            rank[near] = self.ranks_of(symbol[near], symbol[after[near]])
            near = near[rank[near] != NONE]
            if near.size:
                enlist(near)
        left = np.flatnonzero(symbol[:n] >= 0)
        return symbol[left], word[left]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Little-endian ids of texts that are split and encoded each for itself."""
        special = self.special
        parts = [split_piece(p) if not (special and "<" in p) else self._around_special(p) for p in pieces]
        plain = list({t for x in parts for t in x if t not in special})
        ids = dict(zip(plain, self.encode_words([t.encode() for t in plain]), strict=True)) if plain else {}
        ids |= {t: np.uint32(i).tobytes() for t, i in special.items()}
        return [ids[x[0]] if len(x) == 1 else b"".join([ids[t] for t in x]) for x in parts]

    def _around_special(self, piece: str) -> list[str]:
        out: list[str] = []
        for j, part in enumerate(self.stop.split(piece)):
            out += [part] if j % 2 else SPLIT.findall(part)
        return out

    def decode(self, ids: np.ndarray, start: np.ndarray) -> Iterator[bytes]:
        """UTF-8 of each text, with U+FFFD where the bytes aren't UTF-8. Text i has the ids from start[i] to start[i + 1]."""
        sizes = self.length[ids]
        ends = np.r_[0, np.cumsum(sizes)]
        index = np.repeat(self.start[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        flat, cuts = self.flat[index].tobytes(), ends[start].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield flat[a:b].decode("utf-8", "replace").encode()


def split_piece(piece: str) -> list[str]:
    """Matches of SPLIT. The usual case, a word with its space and maybe a mark, needs no pattern."""
    core = piece[1:] if piece[:1] == " " else piece
    if core.isalpha():
        return [piece]
    if core[-1:] in (".", ",") and core[:-1].isalpha():
        return [piece[:-1], core[-1]]
    return SPLIT.findall(piece)




def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts that lie one after the other. No match of SPLIT crosses these places.

    Of a run of white space before another character the last one stands alone, or belongs to what follows
    if it is a space; the rest of the run is a match of its own, as is a run at the end of a text.
    """
    white = WHITE[data]
    head = np.zeros(data.size + 1, bool)
    head[starts] = True
    head = head[:-1]
    was = np.r_[False, white[:-1]] & ~head
    ends = white & np.r_[~white[1:], False] & ~np.r_[head[1:], True]
    after_mark = was & ~white & (np.r_[np.uint8(0), data[:-1]] != 32)
    return np.flatnonzero(head | ends | (white & ~was) | after_mark)


class PieceCache:
    """Ids of texts by their pieces: a word with the space before it, or white space. Each is encoded once.

    Arrow numbers the pieces of a batch, so Python sees the distinct ones only. A text with a special token, or
    with other than one-byte white space at a piece's end, is encoded whole. When the pieces held exceed
    `limit_bytes` the cache starts anew: that costs time and changes no result.
    """

    def __init__(self, bpe: ByteBPE, limit_bytes: int = 48 << 20, long_piece: int = 256):
        self.bpe, self.limit_bytes, self.long_piece = bpe, limit_bytes, long_piece
        self.known: dict[str, bytes | None] = {}
        self.held = 0

    def _odd(self, piece: str) -> bool:
        return not piece.isascii() and (piece[-1].isspace() or piece.lstrip(" ")[:1].isspace()) or any(s in piece for s in self.bpe.special)

    def _learn(self, pieces: list[str]) -> dict[str, bytes | None]:
        """The ids of each piece, None for odd ones."""
        joined = pa.array(pieces, pa.string())
        ends = np.frombuffer(joined.buffers()[1], np.int32)[: len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(joined.buffers()[2], np.uint8)[: ends[-1]]
        kind = byte_classes(data)
        mixed = np.bitwise_or.reduceat((data >= 0xE0) | (data == ord("'")) | (data == ord("<")) | (kind == 2) & (data >= 0x80), ends[:-1])
        plain, others = np.flatnonzero(~mixed), [pieces[i] for i in np.flatnonzero(mixed).tolist()]
        found: dict[str, bytes | None] = {}
        if plain.size:
            size = np.diff(ends)[plain]
            own = np.repeat(~mixed, np.diff(ends))
            found = dict(zip([pieces[i] for i in plain.tolist()], self.bpe.encode_plain(data[own], kind[own], np.cumsum(size) - size), strict=True))
        odd = {p for p in others if self._odd(p)}
        rest = [p for p in others if p not in odd]
        return found | dict(zip(rest, self.bpe.encode_pieces(rest), strict=True)) | dict.fromkeys(odd)

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) one after the other, and where each text's begin; its end at last."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not data.size:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        at = piece_starts(data, offsets[:-1])
        cuts = np.r_[at, data.size].astype(np.int32)
        coded = pa.StringArray.from_buffers(at.size, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        pieces, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if self.held > self.limit_bytes:
            self.known, self.held = {}, 0
        fresh = [p for p in pieces if p not in self.known]
        learned = self._learn(fresh) if fresh else {}
        short = {p: i for p, i in learned.items() if len(p) <= self.long_piece}
        self.known |= short
        self.held += sum(map(len, short)) + 200 * len(short)
        found = [learned[p] if p in learned else self.known[p] for p in pieces] if learned else [self.known[p] for p in pieces]
        first = np.searchsorted(at, offsets)  # the first piece of each text
        whole = np.zeros(0, np.int64)
        if None in found:
            odd = np.flatnonzero(np.array([f is None for f in found])[code])
            whole = np.unique(np.searchsorted(offsets, at[odd], side="right") - 1)
            found = [f or b"" for f in found]
        flat = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        count = size[code]
        start = np.r_[0, np.cumsum(count)][first]
        index = np.repeat((np.cumsum(size) - size)[code] - (np.cumsum(count) - count), count)
        ids = flat[index + np.arange(index.size)]
        if not whole.size:
            return ids, start
        again = dict(zip(whole.tolist(), self.bpe.encode_pieces([texts[i].as_py() for i in whole.tolist()]), strict=True))
        parts = [np.frombuffer(again[i], np.uint32) if i in again else ids[start[i] : start[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.r_[0, np.cumsum([p.size for p in parts])]


@lru_cache(maxsize=2)
def coder(path: str) -> tuple[ByteBPE, PieceCache]:
    """Kept by a Python worker for its next tasks."""
    bpe = ByteBPE(path)
    return bpe, PieceCache(bpe)


def coded(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of whole texts.

    Null text counts as empty: no ids. Repeated rows give repeated rows; an empty table an empty result;
    other columns aren't read. The vocabulary's path must exist on every executor.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = coder(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                ids, start = cache.ids(batch.column("text"))
                each = [ids[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
                ids_sha = [hashlib.sha256(x).hexdigest() for x in each]
                text_sha = [hashlib.sha256(x).hexdigest() for x in bpe.decode(ids, start)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(start), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def slices(batch: pa.RecordBatch, text: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a part hold some MB at most, or are one text."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(text)).fill_null(0), np.int64)
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if i > at and held + size > most_bytes:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if batch.num_rows > at:
        yield batch.slice(at)
