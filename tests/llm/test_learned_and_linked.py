"""Operators 11 to 13 against plain versions, and what they define for odd input."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rallyframe.llm import conversation_trie, hard_negatives, queries, toxicity

TURNS = "conv_id long, turn long, role string, text string, digest string"


def plain_trie(paths: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        return [p, *(q for child in children[p] for q in below(child))]

    def saved(p):
        return (len(members[p]) - 1) * len(p[-1][1].split()) if p else 0

    out = set()
    for p, who in members.items():
        under = below(p)
        ends = ",".join(map(str, sorted(c for c in who if tuple(paths[c]) == p)))
        out.add((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), sum(not children[q] for q in under), sum(map(saved, under)), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found_trie(df) -> set[tuple]:
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(rows) == len(set(map(tuple, rows)))
    return set(map(tuple, rows))


def test_trie_of_deep_repeated_and_odd_conversations(spark):
    rng = np.random.default_rng(3)
    rows, paths = [], {}
    for c in range(60):
        deep = 150 if c < 3 else int(rng.integers(1, 6))
        turns = [("u" if i % 2 == 0 else "a", f"t {i if c < 3 else int(rng.integers(2))} x") for i in range(deep)]
        if c == 2:
            turns[100] = ("u", "other")
        paths[c] = turns
        rows += [(c, i, r, t, "clash") for i, (r, t) in enumerate(turns)]
    rows += [(70, None, None, None, None), (70, 0, "u", "", None), (None, 0, "u", "lost", None)]
    paths[70] = [("", ""), ("u", "")]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    assert found_trie(conversation_trie.conversation_trie(turns)) == plain_trie(paths)


def test_prefixes_do_not_depend_on_the_runs(spark):
    rows = spark.range(3).crossJoin(spark.range(1, 71).toDF("place")).select(F.col("id").alias("conv_id"), "place", F.sha2(F.when((F.col("id") == 2) & (F.col("place") > 40), "y").otherwise(F.col("place").cast("string")), 256).cast("binary").alias("item"))
    got = conversation_trie.prefixes(rows, span=4).toPandas()
    by = {(r.conv_id, r.place): (bytes(r.digest), bytes(r.parent)) for r in got.itertuples()}
    for c in range(3):
        assert by[c, 1][1] == conversation_trie.ROOT
        assert all(by[c, d][1] == by[c, d - 1][0] for d in range(2, 71))
    assert all(by[0, d] == by[1, d] for d in range(1, 71))
    assert all((by[0, d][0] == by[2, d][0]) == (d <= 40) for d in range(1, 71))
    assert len({v[0] for v in by.values()}) == 70 + 30


def test_trie_query_splices_openings(spark, tmp_path):
    rng = np.random.default_rng(5)
    own = {c: [("u", f"w{int(rng.integers(3))} z") for _ in range(int(rng.integers(1, 6)))] for c in [*range(0, 45), 61, 62, 63, 65]}
    spark.createDataFrame([(c, i, r, t) for c, turns in own.items() for i, (r, t) in enumerate(turns)], TURNS.rsplit(",", 1)[0]).write.parquet(f"{tmp_path}/conversations.parquet")
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not p for p in paths.values())
    assert found_trie(queries.op12_conversation_trie(spark, str(tmp_path))) == plain_trie(paths)


def test_trie_of_nothing(spark):
    assert conversation_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_a_hot_end_is_hashed_in_pieces(spark):
    turns = spark.range(50).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"), F.lit("a b").alias("text"))
    got = conversation_trie.trie(conversation_trie.numbered(turns), piece=7).where("depth = 1").first()
    assert got["ends_sha256"] == hashlib.sha256(",".join(map(str, range(50))).encode()).hexdigest() and got["saved_tokens"] == 98


@pytest.mark.parametrize("seed", range(4))
def test_ball_tree_finds_what_a_full_scan_finds(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(1, 700)), int(rng.integers(1, 7))
    x = rng.integers(-20, 20, (n, d)).astype(float)
    x[: n // (2 + seed)] = x[0]
    labels, ids = rng.integers(0, [1, 4, 200, 3][seed], n), rng.permutation(3 * n)[:n]
    tree = hard_negatives.BallTree(ids, labels, x, leaf=[2, 16, 64, 8][seed])
    least = rng.integers(-200, 100, n).astype(float)
    most = least + rng.integers(0, 300, n)
    for same in (True, False):
        hits = tree.search(x, labels, ids, 3, same, least, most)
        for i in range(n):
            s = x @ x[i]
            fits = ((labels == labels[i]) == same) & (ids != ids[i]) & (s >= least[i]) & (s <= most[i])
            want = sorted(zip(-s[fits], ids[fits], strict=True))[:3]
            got = [(-a, b) for a, b in zip(hits.score[i], hits.row[i], strict=True) if b != np.iinfo(np.int64).max]
            assert got == want


def test_scores_beyond_doubles_stay_exact():
    x = np.array([[2.0**30 + 1, 1.0], [2.0**30 + 3, 5.0], [2.0**30 + 1, 2.0]])
    tree = hard_negatives.BallTree(np.arange(3), np.zeros(3, np.int64), x)
    hits = tree.search(x[:1], np.zeros(1, np.int64), np.array([0]), 2, True, np.array([-np.inf]), np.array([np.inf]))
    assert [int(v) for v in hits.score[0]] == [(2**30 + 1) * (2**30 + 3) + 5, (2**30 + 1) ** 2 + 2] and hits.row[0].tolist() == [1, 2]


def plain_mined(rows: list[tuple[int, int, list[float]]]) -> set[tuple]:
    out = set()
    for i, label, x in rows:
        if i % 50:
            continue
        scored = sorted((-int(np.dot(x, y)), j, m) for j, m, y in rows if j != i)
        for s, p, m in [r for r in scored if r[2] == label][:5]:
            fits = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out |= {(i, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)}
    return out


@pytest.mark.parametrize("block", [40, 10_000])
def test_mined_negatives_against_a_full_scan(spark, block):
    rng = np.random.default_rng(block)
    rows = [(int(i), int(rng.integers(3)), rng.normal(size=3 if i % 9 else 2).tolist()) for i in range(400)]
    rows = [(i, m, [0.5, 0.5, 0.25] if 100 <= i < 220 else v) for i, m, v in rows]
    odd = [(None, 1, [1.0]), (1000, None, [1.0]), (1050, 1, None), (1100, 1, [1.0, None]), (1150, 1, [float("nan")]), (1200, 1, [float("inf")])]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:60] + odd], "vec_id long, label int, embedding array<float>, score int")
    got = hard_negatives.mined(hard_negatives.quantised(df), F.col("vec_id") % 50 == 0, block=block)
    whole = [(i, m, np.pad(np.floor(256 * np.array(v, np.float32).astype(float)), (0, 3 - len(v)))) for i, m, v in rows]
    found = list(map(tuple, got.collect()))
    assert len(found) == len(set(found)) and set(found) == plain_mined(whole)


def test_mined_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mined(hard_negatives.quantised(df), F.col("vec_id") % 50 == 0).count() == 0


def test_toxicity_on_rows_held_out(spark):
    rng = np.random.default_rng(7)
    common = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        text = list(rng.choice(common, int(rng.integers(20, 200))))
        toxic = i % 8 == 0
        if toxic:
            text[3:3] = ["IDIOT!!", "trash***"] if i % 16 else [f"zorg{k}" for k in rng.integers(0, 40, 12)]
        docs.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(toxic)))
    docs += [(5000, None, "x"), (5001, "", "x"), (None, "idiot", "x"), (5002, "idiot " * 100_000, "x"), (0, docs[0][1], "y")]
    labels += [(0, 1, 0), (5000, 1, None), (None, 1, 1)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.trained(d, l, ~toxicity.held_out())
    out = toxicity.scored(d, model).toPandas()
    assert len(out) == len(docs) and out["score"].between(0, 1).all()
    ids = [None if pd.isna(x) else int(x) for x in out["doc_id"]]
    assert [bool(h) for h in out["held_out"]] == [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]
    asked = out[out["held_out"] & (out["doc_id"] < 1500)]
    truth = asked["doc_id"] % 8 == 0
    assert (asked["predicted"][truth] == 1).mean() > 0.95 and (asked["predicted"][~truth] == 1).mean() < 0.01
    assert set(out.loc[out["doc_id"] == 5002, "predicted"]) == {1} and set(out.loc[out["doc_id"].isin([5000, 5001]), "predicted"]) == {0}


def test_toxicity_learns_nothing_from_held_out_labels_and_clean_labels(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("same "), F.when(F.col("id") % 3 == 0, "bad").otherwise("fine")).alias("text"))
    base = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("toxic"))
    turned = base.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.trained(docs, x, ~toxicity.held_out()) for x in (base, turned))
    assert one.index == two.index and np.array_equal(one.weights, two.weights) and np.array_equal(one.bias, two.bias)


def test_toxicity_without_labels_or_documents(spark):
    empty_l = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    out = toxicity.scored(docs, toxicity.trained(docs, empty_l, ~toxicity.held_out())).collect()
    assert [(r["score"] < 0.01, r["predicted"]) for r in out] == [(True, 0)]
    assert toxicity.scored(docs.limit(0), toxicity.trained(docs.limit(0), empty_l, ~toxicity.held_out())).count() == 0


def test_the_risk_on_clean_text_is_freed_of_the_hidden_share():
    rng = np.random.default_rng(0)
    toxic = (rng.random((500, 1)) < 0.9).astype(np.float32)
    clean = (rng.random((4000, 1)) < 0.05).astype(np.float32)
    w, b = toxicity.nn_pu_fit(toxic, np.vstack([clean, toxic[:400]]), 400 / 4400, seed=1, decay=0.0)
    for x, want in ((1, 0.9 * 400 / (0.9 * 400 + 0.05 * 4000)), (0, 0.1 * 400 / (0.1 * 400 + 0.95 * 4000))):
        assert abs(1 / (1 + np.exp(-(w[0] * x + b))) - want) < 0.08
