"""Every operator against a plain version, on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rallyframe.llm import bpe, fingerprints, line_dedup, near_dedup, packing, quality, secret_scan, sharding, url_filter, warc
from rallyframe.llm.queries import vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\v\f\r"
SCHEMA = "doc_id long, text string, n_words string, kept string, spans string, n_lines string, sequence_id string, node string, rules string, fingerprint string"
RNG = random.Random(5)
WORDS = [f"w{i}x" for i in range(300)] + ["the", "of", "and", "die", "der", "la", "de"]


def prose(n):
    return "\n".join(" ".join(RNG.choice(WORDS) for _ in range(12)) for _ in range(n // 12 + 1))


BASE = prose(200)
TEXTS = [
    None, "", " ", "\n\n", "one", "a b", BASE, BASE, BASE.replace("the", "teh", 1), prose(90), prose(60) + "\n" + "# $ % | " * 200, "word " * 400, "é ß 日本語 😀 " * 30,
    "common line of more than twenty\nx", " Common Line of more than TWENTY \ny", "common line of more than twenty", "common line of more than twenty\ncommon line of more than twenty\nz",
    'password: "hunter2hunter2" and token=abc and api_key = q1w2e3r4', "token: password: secretvalue123 passwd=abc", "AKIA" + "A1B2" * 5 + " deadbeef" * 6 + " " + "0af3" * 10, "ſecret=abcdefgh Ktoken=zzzzzzz",
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 9, prose(9000), "x" * 30000, "<|endoftext|> a<|endoftext|>b  c \n d", "a  b\u00a0c\u2003 d\x1c e\x85",
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id text " + BASE), (3, TEXTS[3]), (6, TEXTS[6])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *["z"] * 8) for i, t in ROWS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def same(got, wanted):
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))


def quality_row(i, t):
    w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j + o for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for o in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in t or "")
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    stop = sum(x.lower() in quality.STOP_WORDS for x in w)
    dup = len(lines) - len(set(lines))
    n = max(1, len(w))
    ok = 1.5 <= sum(map(len, w)) / n <= 20 and symbols / n <= 0.6 and (t or "").count("!") / n <= 0.6 and stop / n >= 0.03 and dup / max(1, len(lines)) <= 0.7
    return (i, len(w), sum(map(len, w)), symbols, dup, len(covered), failed, not failed and ok)


def test_quality(docs, empty):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    wanted = [quality_row(i, t) for i, t in ROWS]
    same([tuple(r) for r in quality.judged(docs).select(*columns).collect()], wanted)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    same([(r.doc_id, r.text) for r in kept.collect()], [row for row, w in zip(ROWS, wanted, strict=True) if w[-1]])
    assert quality.judged(empty).count() == 0
    passes, _ = quality.compiled(())
    assert docs.limit(1).select(passes.alias("p")).first().p


def test_sharding(docs, empty):
    for limit in (400_000, 0):
        out = sharding.sharded(docs, n_shards=4, rows_per_range=3, broadcast_rows=limit).collect()
        same([(r.doc_id, r.size, r.text_crc32) for r in out], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS])
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
            assert r.law == "rows" and r.grown_shard is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots[s]) for s in range(4)]
        assert max(sizes) - min(sizes) <= 1
    assert sharding.sharded(empty).count() == 0


def test_sharding_is_uniform(spark):
    """Shard and slot don't depend on the place in the input, and repeated rows spread like others."""
    n, shards = 24_000, 8
    frame = spark.range(0, n, 1, 6).selectExpr("id div 2 as doc_id", "'same' as text")
    rows = [(r.doc_id, r.shard, r.slot) for r in sharding.sharded(frame, rows_per_range=700).collect()]
    table = np.zeros((12, shards))
    for doc, shard, _ in rows:
        table[doc * 12 * 2 // n, shard] += 1
    wanted = n / 12 / shards
    chi = ((table - wanted) ** 2 / wanted).sum()
    assert 35 < chi < 130  # 77 degrees of freedom: 77 is the mean, 12.4 the deviation
    docs_, slots = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    assert abs(np.corrcoef(docs_, slots)[0, 1]) < 4 / n**0.5
    pairs = defaultdict(list)
    for doc, shard, _ in rows:
        pairs[doc].append(shard)
    assert abs(sum(a == b for a, b in pairs.values()) / len(pairs) - 1 / shards) < 0.02


def test_hypergeometric_draws():
    matrix = sharding.draw_matrix([1000, 0, 500, 3], 4, 1)
    assert matrix.sum(1).tolist() == [1000, 0, 500, 3] and np.ptp(matrix.sum(0)) <= 1
    rng = np.random.default_rng(2)
    for good, bad, draws in ((5, 7, 4), (300, 2000, 700), (3, 10**6, 10**5)):
        from math import comb

        got = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(4000))
        for k in range(max(0, draws - bad), min(good, draws) + 1):
            p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) if good + bad < 5000 else comb(good, k) * 0.1**k * 0.9 ** (good - k)
            assert abs(got[k] / 4000 - p) < 5 * (p * (1 - p) / 4000) ** 0.5 + 1e-3
    # One way at every size: mean and deviation of a huge population.
    good, bad, draws = 10**12, 7 * 10**12, 4 * 10**8
    got = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(200)], float)
    sd = (draws / 8 * 7 / 8) ** 0.5
    assert abs(got.mean() - draws / 8) < 5 * sd / 200**0.5 and 0.8 < got.std() / sd < 1.2
    assert sharding.hypergeometric(rng, 10, 0, 4) == 4 and sharding.hypergeometric(rng, 0, 10, 4) == 0


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    wanted = []
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    same([tuple(r) for r in bpe.coded(docs, vocabulary()).collect()], wanted)
    assert bpe.coded(empty, vocabulary()).count() == 0


def test_bpe_on_random_pieces():
    from tokenizers import Tokenizer

    tok, cache = Tokenizer.from_file(vocabulary()), bpe.PieceCache(bpe.ByteBPE(vocabulary()), limit_bytes=100_000)
    for alphabet in ("ab 1.\n\t'é 😀<|sS", "ab  \n", "aA9.' \r\u00a0\u2003"):
        texts = ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(0, 25))) for _ in range(2000)]
        texts += [f"{a}<|endoftext|>{b}" for a, b in zip(texts[:200], texts[200:400], strict=True)]
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            ids, start = cache.ids(pa.array(["left out", *part]).slice(1))
            for i, text in enumerate(part):
                assert ids[start[i] : start[i + 1]].tolist() == tok.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("kind", ["letters", "few", "one", "words", "marks", "wide"])
def test_bpe_on_long_words(kind):
    """A million characters without a space: equal to the library, in seconds."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    n = 1_000_000
    text = {
        "letters": lambda: "".join(map(chr, rng.integers(97, 123, n))), "few": lambda: "".join(map(chr, rng.integers(97, 100, n))), "one": lambda: "a" * n, "marks": lambda: "".join(rng.choice(list("=-_#*/"), n)),
        "words": lambda: "".join(rng.choice(["the", "ing", "straße", "tion", "un", "der", "mente"], n // 4)), "wide": lambda: "".join(rng.choice(list("日本語éß"), n // 3)),
    }[kind]()
    began = time.perf_counter()
    ids, _ = bpe.coder(vocabulary())[1].ids(pa.array([text]))
    assert time.perf_counter() - began < 10
    assert ids.tolist() == Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).ids


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok, capacity = Tokenizer.from_file(vocabulary()), 512
    out = packing.packed_documents(docs, vocabulary(), capacity).collect()
    wanted = []
    for i, t in ROWS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at, pieces = 0, -(-len(ids) // capacity)
        for p in range(pieces):
            to = len(ids) - capacity * (pieces - 1 - p)
            wanted.append((i, p, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())))
            at = to
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out], wanted)
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= capacity
    lengths = [r.length for r in out]
    assert len(held) == plain_rounds(lengths, capacity) and len(held) >= -(-sum(lengths) // capacity)
    assert packing.packed_documents(empty, vocabulary(), capacity).count() == 0


def plain_rounds(lengths, capacity):
    """The rounds on single documents and gaps, without runs and ranges: how many sequences there are."""
    left, gaps, opened = sorted(lengths), [], 0
    while left:
        taking = [n for n in left if 2 * n >= left[-1]]
        left = [n for n in left if 2 * n < left[-1]]
        stack, after = [], []
        for value, is_gap in sorted([(n, 0) for n in taking] + [(g, 1) for g in gaps]):
            if not is_gap:
                stack.append(value)
            elif not stack:
                after.append(value)
            else:
                size, gap = stack[-1], value
                while stack and stack[-1] == size and gap >= size:
                    stack.pop()
                    gap -= size
                after.append(gap)
        if stack:
            new = min(len(stack), max(1, sum(2 * n > capacity for n in stack), int(0.5 * -(-sum(stack) // capacity))))
            opened += new
            after += [capacity - stack.pop() for _ in range(new)]
        left, gaps = sorted(left + stack), [g for g in after if g]
    return opened


@pytest.mark.parametrize("shape", ["mixed", "one size", "tiny", "full"])
def test_packing_plan(spark, shape):
    rng = np.random.default_rng(4)
    lengths = {"mixed": np.minimum(rng.lognormal(4, 1.2, 6000), 512).astype(int) + 1, "one size": np.full(3000, 171), "tiny": np.full(5000, 1), "full": np.r_[np.full(50, 512), np.full(50, 300)]}[shape].clip(1, 512).tolist()
    frame = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    for limit in (400_000, 0):  # the plan broadcast, and joined
        out = packing.packed(frame, 512, broadcast_runs=limit).collect()
        assert sorted(r.doc_id for r in out) == list(range(len(lengths)))
        held = defaultdict(list)
        for r in out:
            held[r.sequence_id].append((r.offset, r.length))
        for parts in held.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 512
        assert len(held) == plain_rounds(lengths, 512)
        assert len(held) <= 1.01 * -(-sum(lengths) // 512) or shape in ("one size", "full")
    if shape == "one size":
        assert len(held) == -(-3000 // 2)


def test_packing_refuses_lengths(spark):
    with pytest.raises(Exception, match="length outside"):
        packing.packed(spark.createDataFrame([(1, 0, 600)], "doc_id long, piece int, length long"), 512).collect()


def spark_hash(*values):
    """Spark's xxhash64 of strings, ints and longs (L-marked), which chains its columns through the seed."""
    import struct

    import xxhash

    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q" if isinstance(v, tuple) else "<i", v[0] if isinstance(v, tuple) else v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def pieces_of(text):
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D\u2e80-\U0010ffff]"
    out = []
    for piece in re.findall(rf"(?:[\u2e80-\U0010ffff]|{word}+){space}*|{space}+", text):
        start, parts = 0, []
        for j in range(2, len(piece) + 1):
            if len(piece) <= 24 or j < len(piece) and spark_hash(piece[j - 2], piece[j - 1]) % 8:
                continue
            parts.append(piece[start:j])
            start = j
        out += [p[i : i + 32] for p in parts for i in range(0, len(p), 32)] or [piece]
    return out


def order_minhash(text, k=3, selections=32):
    """A plain version: for each selection the two minimal k-mers, their order, and where they come from."""
    w = pieces_of(text)
    grams = [spark_hash(*w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [spark_hash("".join(w))] if w else []
    seen, hashed = Counter(), []
    for g in grams:
        hashed.append(spark_hash((g,), seen[g]) if seen[g] else g)
        seen[g] += 1
    least = [min(((spark_hash((h,), i) >> 31), at) for at, h in enumerate(hashed)) for i in range(2 * selections)] if hashed else []
    return [(a[0], b[0], a[1] <= b[1]) for a, b in zip(least[::2], least[1::2], strict=True)] or [None] * selections


def test_fingerprints(spark, docs, empty):
    out = fingerprints.edited_fingerprints(docs).collect()
    assert len(out) == len(ROWS)
    ordered = sorted((i, t or "") for i, t in ROWS if i is not None)
    shown = {}
    by_id = defaultdict(list)
    for r in out:
        by_id[r.doc_id].append(r)
    for i in [i for i, n in Counter(i for i, _ in ordered).items() if n == 1]:
        at = [j for j, (d, _) in enumerate(ordered) if d == i][0]
        text = ordered[at][1]
        following = ordered[at + 1][1] if at + 1 < len(ordered) else "null id text " + BASE  # null ids come first
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        (r,) = by_id[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        shown.setdefault(text, set()).add(r.fingerprint)
        if len(text) < 20_000:  # the plain version takes long
            agree = sum(a == b for a, b in zip(order_minhash(text), order_minhash(edited), strict=True))
            assert r.near_edited == pytest.approx(agree / 32)
    assert all(len(v) == 1 for v in shown.values())
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    moved = spark.createDataFrame([(1, "m n o p q r s t"), (2, "s t m n o p q r")], "doc_id long, text string")
    assert 0 < fingerprints.edited_fingerprints(moved).orderBy("doc_id").first().near_next < 1
    clash = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("bucket", "row", "is_copy", "next_text", "which", "kmers", "sig")])
    assert fingerprints.edited_fingerprints(clash).count() == len(ROWS)


@pytest.mark.parametrize("kind", ["words", "letters", "ideographs"])
def test_fingerprints_follow_edit_distance(spark, kind):
    """Likeness falls as the edits grow, with and without spaces; a moved half costs more than an edit in place."""
    rng = random.Random(8)
    make = {"words": lambda: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(700)), "letters": lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000)), "ideographs": lambda: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(2500))}[kind]
    rows, of = [], {}
    for base in range(12):
        text = make()
        for edits in (0, 1, 8, 64, 600):
            chars = list(text)
            for _ in range(edits):
                at = rng.randrange(len(chars))
                chars[at : at + rng.randrange(2)] = rng.choice("abcxyz")  # changes and insertions
            of[len(rows)] = (base, edits)
            rows.append((len(rows), "".join(chars)))
        of[len(rows)] = (base, "moved")
        rows.append((len(rows), text[len(text) // 2 :] + " " + text[: len(text) // 2]))
    frame = fingerprints.with_kmers(spark.createDataFrame(rows, "doc_id long, text string"), "text", "kmers")
    sig = {r.doc_id: r.sig for r in fingerprints.signatures(frame, ["doc_id"], "kmers", "sig").collect()}
    mean = defaultdict(list)
    for i, (base, edits) in of.items():
        mean[edits].append(sum(a == b for a, b in zip(sig[6 * base], sig[i], strict=True)) / 32)
    mean = {e: sum(v) / len(v) for e, v in mean.items()}
    assert mean[0] == 1 and mean[1] > 0.93 and mean[1] > mean[8] > mean[64] > mean[600] and mean[8] > 0.7 and mean[600] < 0.2
    assert 0.3 < mean["moved"] < 0.75  # half of the pairs change their order


def test_neighbours_over_ranges(spark):
    rows = spark.range(0, 5000, 7).selectExpr("id as doc_id", "cast(id as string) as text").unionAll(spark.createDataFrame([(10**12, "far")], "doc_id long, text string"))
    out = {r.doc_id: r.next_text for r in fingerprints.with_next(rows, "doc_id", "text", rows_per_bucket=10).filter("not is_copy").collect()}
    ids = [*range(0, 5000, 7), 10**12]
    names = [*map(str, ids[:-1]), "far"]
    assert out == dict(zip(ids, [*names[1:], names[0]], strict=True))


def test_neighbours_with_a_hot_key(spark):
    """A third of the rows share a key: they spread over ranges, and every row follows another one once."""
    rows = spark.range(9000).selectExpr("case when id % 3 = 0 then 400 else id end as doc_id", "cast(id as string) as text")
    out = fingerprints.with_next(rows, "doc_id", "text", rows_per_bucket=10).filter("not is_copy").collect()
    assert sorted(r.next_text for r in out) == sorted(r.text for r in out)
    key = {r.text: r.doc_id for r in out}
    ordered = sorted(key.values())
    assert sorted((r.doc_id, key[r.next_text]) for r in out) == sorted(zip(ordered, [*ordered[1:], ordered[0]], strict=True))
    assert len({r.bucket for r in out if r.doc_id == 400}) > 1


def test_lines(docs, empty):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    held = defaultdict(list)
    for i, t in ROWS:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(-1 if i is None else i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 3}
    wanted = []
    for i, t in ROWS:
        lines = (t or "").split("\n")
        stay = [x for x in lines if gone.get(key(x), -1 if i is None else i) == (-1 if i is None else i)]
        wanted.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    assert sum(w[2] for w in wanted) > 2
    for limit in (64 << 20, 0):  # broadcast tables, and tables that the keys visit
        out = line_dedup.deduplicated(docs, keys_per_shard=2, broadcast_bytes=limit)
        same([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()], wanted)
        assert line_dedup.deduplicated(empty, broadcast_bytes=limit).count() == 0
    assert set(out.columns) == {*docs.columns, "n_dropped"}


def test_minimal_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000))
    table = line_dedup.MinimalHash(keys)
    assert np.array_equal(np.sort(table.slots(keys)), np.arange(keys.size))
    packed = line_dedup.shard_table(keys, keys[::-1].copy(), np.arange(keys.size), keys)
    import pickle

    n, keep = line_dedup.probe(pickle.loads(packed), keys, keys[::-1].copy())
    assert np.array_equal(n, np.arange(keys.size)) and np.array_equal(keep, keys)
    n, _ = line_dedup.probe(pickle.loads(packed), keys + 1, keys[::-1].copy())
    assert (n[~np.isin(keys + 1, keys)] == 0).all()


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_components(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and part[i] != part[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    ids = defaultdict(list)
    for p, (i, _) in zip(part, rows, strict=True):
        ids[p].append(i)
    least = {p: min((x for x in v if x is not None), default=None) for p, v in ids.items()}
    return [(i, len(s), i if not s else least[p], (i if not s else least[p]) == i) for (i, _), s, p in zip(rows, sets, part, strict=True)]


def test_near_dedup(spark, docs, empty):
    out = near_dedup.NearDedup(k=2).labelled(docs)
    same([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()], near_components(ROWS, 2))
    assert near_dedup.NearDedup().labelled(empty).count() == 0
    kept = near_dedup.NearDedup(k=2).kept_documents(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[6] == 1 and 7 not in ids and ids[0] == 1 and ids[3] == 1


def test_near_dedup_keeps_unrelated_rows_of_one_key(spark):
    """Components are told apart by their texts, not by a key that is null or repeated."""
    a, b, c, d, e = (" ".join(f"{name}{i}" for i in range(40)) for name in "abcde")
    rows = [(None, a), (None, b), (None, b), (None, b + " more"), (None, ""), (None, None), (None, " "), (1, c), (1, d), (1, d), (2, d + " more"), (3, e), (None, e), (4, "\n"), (4, "\n"), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [(r.doc_id, r.text) for r in near_dedup.NearDedup().kept_documents(frame).collect()]
    assert {t for i, t in out if i is None and t in (b, b + " more")} and len([t for _, t in out if t in (b, b + " more")]) == 1
    same([r for r in out if r[1] not in (b, b + " more")], [(None, a), (None, ""), (None, None), (None, " "), (1, c), (1, d), (3, e), (4, "\n"), (4, "")])


def test_near_dedup_family_in_blocks(spark):
    """A large family whose members are around the threshold, cut into small blocks: the same components."""
    base = [RNG.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(RNG.choice([1, 4, 6, 9])):
            w[RNG.randrange(len(w))] = f"own{RNG.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2048, 8):
        out = near_dedup.NearDedup(k=2, block=block).labelled(frame).collect()
        same([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out], near_components(rows, 2))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60) if i != 30], "a string, b string")
    out = {r.node: r.label for r in near_dedup.components(edges).collect()}
    assert out == {f"{i:03d}": "000" if i <= 30 else "031" for i in range(61)}


def spans_of(text):
    found = []
    for order, rule in enumerate(secret_scan.BASE_RULES + secret_scan.MORE_RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), order, m.end(), rule.kind))
    return sorted(found)


def test_secrets(docs, empty):
    for limit in (400_000, 0):  # candidates broadcast, and joined
        out = secret_scan.scanned(docs, broadcast_rows=limit).collect()
        same([(r.doc_id, r.text, [tuple(s) for s in r.spans]) for r in out], [(i, t, spans_of(t)) for i, t in ROWS])
    assert sum(len(spans_of(t)) for _, t in ROWS) >= 6
    digest = {r.doc_id: r for r in secret_scan.digest(secret_scan.scanned(docs)).collect()}
    assert digest[19].n_access == 1 and digest[19].n_hex == 1 and digest[18].n_assign == 1
    assert digest[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.scanned(empty).count() == 0
    clean = {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()}
    for i, t in ROWS:
        wanted, at = "", 0
        for start, _, end, kind in spans_of(t):
            if start >= at:
                wanted += t[at:start] + f"[{kind}]"
            at = max(at, end)
        assert clean[i] == (wanted + t[at:] if spans_of(t) else t)


def test_secrets_in_long_texts(spark):
    """Thousands of matches in one text: equal to the plain version, in about proportional time."""
    def text(n):
        return " ".join(f"ümlaut 😀 {i:024x} token={'s' * (4 + i % 4)}" if i % 3 else f"{i:030x}" for i in range(n)) + " end"

    took = {}
    for n in (50, 6000, 24_000):
        frame = spark.createDataFrame([(1, text(n)), (2, text(n // 2))], "doc_id long, text string")
        began = time.perf_counter()
        spans = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scanned(frame).collect()}
        clean = {r.doc_id: r.text for r in secret_scan.redacted(frame).collect()}
        took[n] = time.perf_counter() - began
        assert spans == {1: spans_of(text(n)), 2: spans_of(text(n // 2))}
        assert clean == {1: secret(text(n)), 2: secret(text(n // 2))}
    assert took[24_000] - took[50] < 8 * max(1.0, took[6000] - took[50])


def test_trigram_queries_hold_for_every_match():
    samples = ["Password: hunter2", "api_key='abcdefg'", "apikey=abcdefg", "xx AKIA" + "A" * 20, "-----BEGIN PRIVATE KEY-----", "ghs_" + "z" * 40, "xoxb-123456789012", "eyJabcdefgh.eyJabcdefgh.abcdefgh", "passwd = 123456", "SECRET:abcdef", "token=abcdef"]
    for rule in secret_scan.BASE_RULES + secret_scan.MORE_RULES:
        query = secret_scan.trigram_query(rule.pattern)
        assert (query == ()) == (rule.kind == "hex")
        for s in samples:
            for m in re.finditer(rule.pattern, s):
                low = m[0].lower()
                assert all(any(all(t in low for t in strings) for strings in clause) for clause in query), (rule.kind, s)


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.NET/en/1", "https://example.net/fr/", "http://x.example.com/de/2?q#f", "http://x.example.com/DE/2", "ftp://org/fr/", "http://b.org/fr", "http://net", "http://inet/", "http://q.net/?a://b/c",
            "http://cheap-pills.example.com/en/9", "http://library.example.com/en/9", "http://x.com#a/b"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(4, urls[4], "x")], "page_id long, url string, host string")
    model = url_filter.trained(url_filter.labelled_urls(spark))
    out = url_filter.judged_urls(pages, model).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        rest = (urls[r.page_id] or "").partition("://")[2] if "://" in (urls[r.page_id] or "") else ""
        host = re.match("[^/?#]*", rest)[0].translate(LOWER)
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert r.rule == (max(fits)[2] if fits else None)
        assert r.verdict == (max(fits)[1] if fits else r.verdict) and r.verdict in ("allow", "block")
    verdicts = {r.page_id: r.verdict for r in out}
    assert verdicts[13] == "block" and verdicts[14] == "allow"
    assert url_filter.judged_urls(pages.limit(0), model).count() == 0


def murmur3(data, seed=42):
    """The hash of feature hashing, in plain Python."""
    mask, rotl = 0xFFFFFFFF, lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF
    mix = lambda k: rotl(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (rotl(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for r, f in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> r) * f & mask
    return h - (1 << 32) if h >> 31 else h


def test_url_verdicts_by_hand(spark):
    """Every learned verdict and score again, from the model's coefficients."""
    model = url_filter.trained(url_filter.labelled_urls(spark))
    weights, bias = model.stages[1].coefficients.toArray(), model.stages[1].intercept
    urls = [None, "x", "http://", *[f"http://{h}.{d}/{p}/{i}" for i, (h, d, p) in enumerate((h, d, p) for h in ("bets", "news", "müseum") for d in ("com", "example.com") for p in ("a", "en/pills", "docs"))]]
    out = url_filter.judged_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), model).collect()
    for r in out:
        whole = f"^{r.host}|{r.path}$"
        grams = {whole[i : i + n] for n in (3, 4) for i in range(max(1, len(whole) - n + 1))}
        score = 1 / (1 + np.exp(-bias - sum(weights[i] for i in {murmur3(g.encode()) % 4096 for g in grams})))
        assert r.block_score == pytest.approx(score, abs=2e-6)
        assert r.verdict == ("block" if score >= 0.5 else "allow") or r.rule


def test_url_model_on_held_out_urls(spark):
    """Hosts and paths that no labelled row has: words in other company, under other domains."""
    hosts = {1: ["superbets", "pillstore", "spamnet", "grandcasino", "trackads"], 0: ["gardenclub", "citynews", "oldlibrary", "sciencehub", "artmuseum"]}
    paths = {1: ["play/casino-games", "buy/pills-online", "free-bets/today"], 0: ["fr/articles/art", "guide/docs", "history/city", "en/noticias"]}
    held = [(f"http://{h}.test/{p}", float(a or b)) for a in (0, 1) for h in hosts[a] for b in (0, 1) for p in paths[b]]
    known = {r.url for r in url_filter.labelled_urls(spark).collect()}
    assert not known & {u for u, _ in held}
    model = url_filter.trained(url_filter.labelled_urls(spark))
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
    out = {r.page_id: r.block_score >= 0.5 for r in url_filter.judged_urls(rows, model).collect()}
    for kind in (0, 1):
        mine = [i for i, (_, y) in enumerate(held) if y == kind]
        assert sum(out[i] == bool(kind) for i in mine) / len(mine) >= 0.8
    assert sum(out[i] == bool(y) for i, (_, y) in enumerate(held)) / len(held) >= 0.85


def test_revisits(spark):
    schema = "record_id string, kind string, url string, ts long, status int, etag string, last_modified string, digest string, headers map<string,string>, prior string"
    rows = [
        ("r1", "response", "http://www.A.com/x/", 100, 200, "e1", None, "d1", {"date": "1", "content-type": "t"}, "z"), ("r2", "response", "https://a.com/x#f", 300, 200, "e2", "m", "d2", None, "z"), ("r2b", "response", "https://a.com/x", 300, 200, "e3", "m", "d3", {"date": "2"}, "z"),
        ("v0", "revisit", "http://a.com/x", 50, 304, "e1", None, None, {}, "z"), ("v1", "revisit", "http://a.com/x?utm_source=q", 200, 304, "e1", None, None, {"date": "9", "content-type": "no"}, "z"),
        ("v2", "revisit", "http://a.com/x", 300, 304, "e1", None, None, None, "z"), ("v3", "revisit", "http://a.com/x", 100_000, 304, "e2", "m", None, None, "z"), ("v4", "revisit", "http://a.com/x", 100_001, 304, None, "m", None, {"etag": "new", "server": "s"}, "z"),
        ("v5", "revisit", "http://a.com/x", 400, 304, None, None, None, None, "z"), ("v6", "revisit", "http://a.com/x", 401, 304, "W/e3", None, None, None, "z"), ("v7", "revisit", "http://a.com/x", 402, 304, "w/e3", None, None, None, "z"), ("n1", "revisit", None, 400, 304, "e1", None, None, None, "z"), ("n2", "revisit", "http://a.com/x", None, 304, "e1", None, None, None, "z"), ("e", "response", "http://a.com/x", 350, 404, "e9", None, "d9", None, "z"),
    ]
    frame = spark.createDataFrame(rows + rows[-1:], schema)
    out = {r.record_id: r for r in warc.resolved(frame, width=1000).collect()}
    assert {k: (r.outcome, r.resolved_id) for k, r in out.items()} == {
        "r1": ("response", None), "r2": ("response", None), "r2b": ("response", None), "v0": ("no_earlier", None), "v1": ("resolved", "r1"), "v2": ("resolved", "r1"), "v3": ("changed", None),
        "v4": ("resolved", "r2b"), "v5": ("unvalidated", None), "v6": ("resolved", "r2b"), "v7": ("changed", None), "n1": ("no_earlier", None), "n2": ("no_earlier", None), "e": ("response", None),
    }
    assert out["v1"].merged_headers == {"date": "9", "content-type": "t"} and out["v4"].merged_headers == {"date": "2", "etag": "new"} and out["v1"].resolved_digest == "d1"
    assert {r.prior for r in out.values()} == {"z"}
    assert warc.resolved(frame, width=1000).count() == len(rows) + 1 and warc.resolved(frame.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in ROWS if i is not None]
    rows += [(100 + i, prose(120), "en", "s", 1) for i in range(12)] + [(200, prose(150) + "\ntoken = abcdef123456", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    state = [(i, t) for i, t, *_ in rows]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 0:
            state = [(i, t) for i, t in state if quality_row(i, t)[-1]]
        elif k == 2:
            parts = near_components(state, 5)
            first = {}
            for (i, t), p in zip(state, parts, strict=True):
                first.setdefault((i, t) if p[3] else None, (i, t))
            state = list({(i, t) for (i, t), p in zip(state, parts, strict=True) if p[3]})
        elif k == 1:
            state = [(r.doc_id, r.text) for r in docs.collect()]
        elif k == 3:
            state = [(i, secret(t)) for i, t in state]
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            same([(r.doc_id, r.text) for r in docs.collect()], state)
            assert all(r.n_chars == len(r.text) for r in docs.collect()) or k == 0
    assert {r.doc_id for r in docs.collect()} == {i for i, _ in state}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def secret(text):
    out, at = "", 0
    for start, _, end, kind in spans_of(text):
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]


def test_private_keys_go_whole(spark):
    body = "\n".join("MIIEpAIBAAKCAQEA7bq/+" + chr(97 + i) * 43 for i in range(25)) + "\nQ9z=="
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    texts = [f"before {begin}\n{body}\n{end} after", f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB12\n\n{body}\n{end}\nafter", f"{begin}\n{body}\nafter the key, text", f"{begin} alone, and text", f"{begin}\n{body}\n{end} and {begin}\n{body}\n{end}."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in secret_scan.redacted(frame).collect()}
    assert clean == {0: "before [private_key] after", 1: "[private_key]\nafter", 2: "[private_key]\nafter the key, text", 3: "[private_key] alone, and text", 4: "[private_key] and [private_key]."}
    rule = next(r for r in secret_scan.MORE_RULES if r.kind == "private_key")
    assert secret_scan.trigram_query(rule.pattern) == secret_scan.trigram_query(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")


def test_stored_tables(spark):
    from rallyframe.llm import common

    table = common.stored(spark.range(3), "three")
    assert table.count() == 3 and spark.sparkContext.applicationId in table.inputFiles()[0]
    common.discard_stored(spark)
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(table.inputFiles()[0]).count()
