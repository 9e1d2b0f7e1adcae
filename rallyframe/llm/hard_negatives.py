"""Hard negatives for contrastive training: rows that score close beneath a positive but carry another label.

The rows are dealt into blocks by a hash of their id. A task builds a ball tree of its block and streams the
anchors through it, so it holds one block and a batch of anchors, never a table. Each node bounds the inner
product of a query q with its rows x from both sides, |q.x - q.c| <= |q| r for a centre c and radius r: a node goes
when it lies outside the wanted score window or strictly beneath the query's current kth row. The blocks' short
lists are merged by rank.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; of rows with
one id the least by (label, vector) counts; vectors of unequal length are filled with zeros; an empty table gives no
rows; an anchor without a positive gives none. Scores are exact integers: rows whose norms allow a product beyond
2**53 are multiplied as whole numbers, and a score beyond a long raises OverflowError. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a block at most on average (a few dozen MB with 64 components), and the least worth a task of its own.
BLOCK, LEAST_BLOCK = 65536, 2048
LEAF = 64
#: Queries that meet a tree at once.
BATCH = 256
EXACT = float(2**53)


@dataclass
class Hits:
    """The best rows of each query so far: scores (descending), ids (ascending where scores tie)."""

    score: np.ndarray
    row: np.ndarray

    @classmethod
    def none(cls, n: int, k: int) -> Hits:
        return cls(np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max, np.int64))

    def offer(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """Merge candidates given as flat arrays."""
        if not len(query):
            return
        k = self.score.shape[1]
        seen = np.unique(query)
        q = np.concatenate([np.repeat(seen, k), query])
        s, r = np.concatenate([self.score[seen].ravel(), score]), np.concatenate([self.row[seen].ravel(), row])
        order = np.lexsort((r, -s, q))
        q, s, r = q[order], s[order], r[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        best = place < k
        self.score[q[best], place[best]], self.row[q[best], place[best]] = s[best], r[best]


class BallTree:
    """Balls over one block. Nodes are split at a label's edge where that leaves no small side, else across their
    widest direction; rows of one vector are split by id, so that ties at the kth place can be pruned by id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids, labels))
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        place = np.arange(len(ids))
        start, end, left, right, centre, radius = [], [], [], [], [], []

        def added(a: int, b: int) -> int:
            node = len(start)
            x = vectors[place[a:b]].astype(np.float64)
            c = x.mean(axis=0)
            start.append(a), end.append(b), left.append(-1), right.append(-1), centre.append(c)
            radius.append(float(np.sqrt(((x - c) ** 2).sum(axis=1).max())))
            return node

        waiting = [added(0, len(ids))] if len(ids) else []
        while waiting:
            node = waiting.pop()
            a, b = start[node], end[node]
            if b - a <= leaf:
                continue
            rows = place[a:b]
            edges = np.flatnonzero(np.diff(labels[rows])) + 1 if (np.diff(labels[rows]) >= 0).all() else np.array([], np.int64)
            cut = int(edges[np.abs(edges - (b - a) // 2).argmin()]) if len(edges) else 0
            if min(cut, b - a - cut) * 8 < b - a:
                cut = (b - a) // 2
                x = vectors[rows].astype(np.float64)
                far = x[((x - centre[node]) ** 2).sum(axis=1).argmax()] - centre[node]
                along = x @ far if radius[node] > 1e-9 else ids[rows]
                place[a:b] = rows[np.argpartition(along, cut)]
            left[node], right[node] = added(a, a + cut), added(a + cut, b)
            waiting += [left[node], right[node]]
        self.ids, self.labels, self.vectors = ids[place], labels[place], vectors[place]
        self.start, self.end, self.left, self.right = (np.array(v, np.int64) for v in (start, end, left, right))
        self.centre, self.radius = np.array(centre), np.array(radius)
        spans = list(zip(start, end, strict=True))
        self.low = np.array([self.labels[a:b].min() for a, b in spans], np.int64)
        self.high = np.array([self.labels[a:b].max() for a, b in spans], np.int64)
        self.first = np.array([self.ids[a:b].min() for a, b in spans], np.int64)
        self.biggest = float(np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1).max())) if len(ids) else 0.0

    def search(self, queries: np.ndarray, labels: np.ndarray, own: np.ndarray, k: int, same: bool, least: np.ndarray, most: np.ndarray) -> Hits:
        """The first k rows of each query: of its label (without the row `own`) or of others, with least <= score <= most."""
        hits = Hits.none(len(queries), k)
        if not len(self.ids) or not len(queries):
            return hits
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        whole = norms.max() * self.biggest >= EXACT
        left = tuple(_integers(x) if whole else x.astype(np.float64) for x in (queries, self.vectors))

        def wanted(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.einsum("ij,ij->i", queries[q].astype(np.float64), self.centre[node])
            reach = norms[q] * self.radius[node]
            slack = 1e-9 * (np.abs(at) + norms[q] * self.biggest) + 1e-6
            above, below = np.floor(at + reach + slack), at - reach - slack
            keep = (above >= least[q]) & (below <= most[q])
            if same:
                keep &= (self.low[node] <= labels[q]) & (labels[q] <= self.high[node])
            else:
                keep &= ~((self.low[node] == labels[q]) & (self.high[node] == labels[q]))
            return q[keep], node[keep], above[keep]

        def not_beneath(q: np.ndarray, node: np.ndarray, above: np.ndarray) -> np.ndarray:
            kth, row = hits.score[q, -1], hits.row[q, -1]
            return (above > kth).astype(bool) | ((above == kth).astype(bool) & (self.first[node] < row))

        def scored(q: np.ndarray, node: np.ndarray) -> None:
            order = np.argsort(node, kind="stable")
            q, node = q[order], node[order]
            edges = np.flatnonzero(np.diff(node)) + 1
            for part in np.split(np.arange(len(q)), edges):
                who, leaf = q[part], node[part[0]]
                a, b = self.start[leaf], self.end[leaf]
                score = left[0][who] @ left[1][a:b].T
                fits = (self.labels[a:b][None, :] == labels[who][:, None]) == same
                fits &= (score >= least[who][:, None]).astype(bool) & (score <= most[who][:, None]).astype(bool) & (self.ids[a:b][None, :] != own[who][:, None])
                kth = hits.score[who, -1][:, None]
                i, j = np.nonzero(fits & (score >= kth).astype(bool))
                hits.offer(who[i], score[i, j].astype(np.float64), self.ids[a:b][j]) if not whole else self._whole(hits, who[i], score[i, j], self.ids[a:b][j])

        # Down the tree, all queries at once; then each query's leaves, the most promising first, in growing rounds.
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        leaves = []
        while len(q):
            q, node, above = wanted(q, node)
            done = self.left[node] < 0
            leaves.append((q[done], node[done], above[done]))
            q, node = np.repeat(q[~done], 2), np.stack([self.left[node[~done]], self.right[node[~done]]], axis=1).ravel()
        q, node, above = (np.concatenate(v) for v in zip(*leaves, strict=True))
        order = np.lexsort((-above, q))
        q, node, above = q[order], node[order], above[order]
        share = 1
        while len(q):
            place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
            scored(q[place < share], node[place < share])
            rest = place >= share
            q, node, above = q[rest], node[rest], above[rest]
            keep = not_beneath(q, node, above)
            q, node, above = q[keep], node[keep], above[keep]
            share *= 2
        return hits

    @staticmethod
    def _whole(hits: Hits, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """Scores beyond 2**53 are kept as whole numbers; the arrays of hits become objects then."""
        if any(abs(int(s)) >= 2**63 for s in score):
            raise OverflowError("an inner product is beyond a long")
        if hits.score.dtype != object:
            hits.score = hits.score.astype(object)
        hits.offer(query, score, row)


def _integers(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) for v in x.ravel()]
    return out


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


@dataclass(frozen=True)
class _Search:
    """One block's rows (kind 0), then the anchors (kind 1), to short lists (anchor_id, goal, row, score)."""

    k: int
    same: bool
    width: int
    low: float
    high: float

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, tree, held = None, None, []
        for pdf in batches:
            for (at, kind), part in pdf.groupby(["block", "kind"], sort=True):
                if at != block:
                    block, tree, held = at, None, []
                if kind == 0:
                    held.append(part)
                    continue
                if tree is None:
                    tree, held = self._tree(held), []
                for a in range(0, len(part), BATCH):
                    yield self._found(tree, part.iloc[a : a + BATCH])

    def _tree(self, held: list[pd.DataFrame]) -> BallTree:
        if not held:
            return BallTree(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, self.width)))
        rows = pd.concat(held)
        return BallTree(rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), _matrix(rows["q"], self.width))

    def _found(self, tree: BallTree, anchors: pd.DataFrame) -> pd.DataFrame:
        ids, labels, q = anchors["vec_id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64), _matrix(anchors["q"], self.width)
        if self.same:
            who, goal = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            least, most = np.full(len(ids), -np.inf), np.full(len(ids), np.inf)
        else:
            goals = [np.unique(np.asarray(g, np.int64)) for g in anchors["goals"]]
            who, goal = np.repeat(np.arange(len(ids)), [len(g) for g in goals]), np.concatenate(goals)
            least, most = np.ceil(goal * self.low / 100), np.floor(goal * self.high / 100)
        hits = tree.search(q[who], labels[who], ids[who], self.k, self.same, least, most)
        i, j = np.nonzero(hits.row != np.iinfo(np.int64).max)
        return pd.DataFrame({"anchor_id": ids[who[i]], "goal": goal[i], "row_id": hits.row[i, j], "score": hits.score[i, j].astype(np.int64)})


def quantised(embeddings: DataFrame, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, q): each component x as floor(scale * x), in doubles; rows that can't take part are left out."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & whole)
    q = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each query over the blocks' short lists."""
    best = Window.partitionBy(*by).orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` as `quantised` gives them, `anchors` a condition on them. A negative n of a positive p satisfies
    low * p <= 100 * n <= high * p.
    """
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")
    once = stored(once, "vectors")
    n, width = once.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    spark = rows.sparkSession
    n_blocks = max(1, -(-n // block), min(-(-n // LEAST_BLOCK), spark.sparkContext.defaultParallelism))
    ours = once.select((F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))).alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "q")
    picked = stored(once.where(anchors), "anchors")

    def short_lists(asked: DataFrame, k: int, same: bool) -> DataFrame:
        """Every block meets every anchor; the goals are the positives' scores."""
        everywhere = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), "vec_id", "label", "q", "goals")
        met = ours.withColumn("goals", F.lit(None).cast("array<long>")).unionByName(everywhere)
        dealt = met.repartitionByRange(n_blocks, "block").sortWithinPartitions("block", "kind")
        return dealt.mapInPandas(_Search(k, same, width or 0, *map(float, window)), "anchor_id long, goal long, row_id long, score long")

    near = _first(short_lists(picked.withColumn("goals", F.lit(None).cast("array<long>")), positives, True), ["anchor_id"], positives)
    near = stored(near.select("anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    goals = near.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("goals"))
    hard = _first(short_lists(picked.join(goals, "vec_id"), negatives, False), ["anchor_id", "goal"], negatives)
    hard = hard.select("anchor_id", F.col("goal").alias("positive_score"), "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(hard, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
