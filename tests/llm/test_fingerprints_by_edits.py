"""Likeness follows edit distance in every script, and white space counts."""

from __future__ import annotations

import base64
import random

import pytest

from rallyframe.llm import fingerprints

SCRIPTS = {
    "latin": "abcdefghijklmnopqrstuvwxyz", "consonants": "bcdfghjklmnpqrstvwxz13579", "thai": "".join(map(chr, range(0x0E01, 0x0E2F))), "cyrillic": "".join(map(chr, range(0x0430, 0x0450))),
    "hiragana": "".join(map(chr, range(0x3041, 0x3090))), "words": "abcdefgh    \n",
}


def distance(a: str, b: str, band: int = 400) -> int:
    """Edit distance by a band about the diagonal."""
    before = {j: j for j in range(min(len(b), band) + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - band), min(len(b), i + band) + 1):
            now[j] = min(before.get(j, 10**9) + 1, now.get(j - 1, 10**9) + 1, before.get(j - 1, 10**9) + (j == 0 or x != b[j - 1])) if j else i
        before = now
    return before[len(b)]


def likenesses(spark, pairs: list[tuple[str, str]]) -> list[float]:
    rows = [(i, side, t) for i, pair in enumerate(pairs) for side, t in enumerate(pair)]
    kmers = fingerprints.with_kmers(spark.createDataFrame(rows, "i long, side long, text string").repartition(8), "text", "kmers")
    sig = {(r.i, r.side): r.sig for r in fingerprints.signatures(kmers, ["i", "side"], "kmers", "sig", selections=32).collect()}
    return [sum(a == b for a, b in zip(sig[i, 0], sig[i, 1], strict=True)) / 32 for i in range(len(pairs))]


def test_one_inserted_letter_in_any_script(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(s) for _ in range(4000)) for s in SCRIPTS.values()] + [base64.b64encode(rng.randbytes(3000)).decode(), "a" * 4000]
    front = likenesses(spark, [(t, t[7] + t) for t in texts])
    middle = likenesses(spark, [(t, t[:2000] + t[3] + t[2000:]) for t in texts])
    assert min(front) >= 0.87 and min(middle) >= 0.87 and sum(front + middle) / 16 >= 0.95, (front, middle)


def test_white_space_counts(spark):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(800))
    all_, none, some = likenesses(spark, [(text, text.replace(" ", "\n\n\t")), (text, text), (text, text.replace(" ", "  ", 4))])
    assert all_ < 0.2 and none == 1 and 0.8 < some < 1


@pytest.mark.parametrize("script", SCRIPTS)
def test_likeness_falls_with_the_distance(spark, script):
    rng, letters = random.Random(script), SCRIPTS[script]
    text = "".join(rng.choice(letters) for _ in range(1000))
    pairs, far = [], []
    for edits in (0, 2, 10, 40, 160):
        for _ in range(4):
            other = list(text)
            for _ in range(edits):
                at = rng.randrange(len(other))
                other[at : at + rng.randrange(2)] = rng.choice(letters) * rng.randrange(2)
            pairs.append((text, "".join(other)))
        if edits <= 40:
            far.append(distance(*pairs[-1], band=45))
    like = likenesses(spark, pairs)
    mean = [sum(like[i : i + 4]) / 4 for i in range(0, 20, 4)]
    assert far == sorted(far) and far[0] == 0 < far[1] and mean == sorted(mean, reverse=True)
    assert mean[0] == 1 and mean[1] > 0.75 and mean[4] < 0.5


def test_places_beyond_16_million(spark):
    assert fingerprints.PLACE_BITS == 31
    rows = spark.sql("select id, array_repeat(7L, cast(100 as int)) as kmers from range(1)")
    assert len(fingerprints.signatures(rows, ["id"], "kmers", "sig").first().sig) == 32


def test_several_null_keys_follow_each_other_once(spark):
    rows = [(None, f"null {i}") for i in range(40)] + [(i, f"text {i}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = fingerprints.with_next(frame, "doc_id", "text", rows_per_bucket=10).filter("not is_copy").collect()
    assert sorted(r.next_text for r in out) == sorted(r.text for r in out) == sorted(t for _, t in rows)
    (last,) = [r for r in out if r.doc_id == 59]
    assert last.next_text.startswith("null")
