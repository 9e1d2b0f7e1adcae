"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other text is unlabelled, whatever a label may say of it. A text's
features are its words and their runs of GRAM characters, edges included: whether the text's distinct words hold
one, whether several of them do, and their share. Document counts of the features cover every document; those that toxic texts show far more often than the
corpus are kept. Numpy classifiers then minimise, over a bounded sample, the risk

    prior * R+(positives)  +  max(0, R-(unlabelled) - prior * R-(positives))

whose second part is the risk on clean text, freed of the toxic share hidden in the unlabelled text; where a batch
drives it below zero, the step goes the other way. The score is the mean over classifiers of different seeds.

Defined results: null and empty texts hold no words and get the bias alone; without any confirmed toxic text every
score is the smallest prior; a null doc_id is never held out and never a training row; of several labels of one
doc_id toxic counts if any is; repeated documents are scored each; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_in, stored, text_of

WORD = re.compile(r"[^\W_]+")
#: Rows that the fit takes at most, about: confirmed toxic texts, and other texts of the corpus.
POSITIVES, UNLABELLED = 5_000, 10_000
#: Words and runs looked at (those in most toxic texts), and features kept (those most typical of toxic texts).
CANDIDATES, FEATURES = 16_384, 512
#: A feature's share in toxic texts lies so many deviations above its share in the corpus, and is so many times as large.
DEVIATIONS, RATIO = 5.0, 2.0
GRAM = 5
#: A run of characters is dense in a text where it makes up one in so many words.
ONE_IN = 100
#: Distinct words whose features a worker remembers.
REMEMBERED = 500_000
LEAST_PRIOR = 1e-4


def parts(word: str) -> set[str]:
    """A word (marked by its edges) and its runs of GRAM characters."""
    edged = f"<{word}>"
    return {edged, *(edged[i : i + GRAM] for i in range(len(edged) - GRAM + 1))}


@dataclass
class Parts:
    """Places of known parts in a text. What a word has is remembered, in bounds."""

    index: dict[str, int]
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def _of(self, word: str) -> tuple[int, ...]:
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        found = self.seen[word] = tuple(sorted(self.index[p] for p in parts(word) if p in self.index))
        return found

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, distinct words that hold each, distinct words)."""
        words, seen, places = set(WORD.findall(text.lower())), self.seen, []
        for word in words:
            at = seen.get(word)
            if at is None:
                at = self._of(word)
            places += at
        at, n = np.unique(np.array(places, np.int64), return_counts=True)
        return at, n, len(words)


def dense(n: np.ndarray, total: int) -> np.ndarray:
    return n * ONE_IN >= total


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id's decimal text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Parts with rows of weights (for being present, in several words, and for their share), a column per classifier."""

    index: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, texts: pd.Series, found: Parts | None = None) -> np.ndarray:
        found = found or Parts(self.index)
        k = len(self.index)
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            at, n, total = found.counted(text)
            margin = self.bias + self.weights[at].sum(axis=0) + self.weights[at[n > 1] + k].sum(axis=0) + shares(n, total) @ self.weights[at + 2 * k]
            out[i] = _sigmoid(margin).mean()
        return out


def shares(n: np.ndarray, total: int) -> np.ndarray:
    return np.log1p(n * ONE_IN / max(total, 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def nn_pu_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, steps: int = 800, batch: int = 2048, rate: float = 0.02, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier on two matrices, by Adam on the non-negative risk.

    With the logistic loss l+(m) = log(1 + e^-m), l-(m) = log(1 + e^m).
    """
    rng = np.random.default_rng(seed)
    w = np.zeros(positive.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))

    def slopes(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.append(by @ x, by.sum()) / len(x)

    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        xp, xu = (x[rng.integers(0, len(x), min(batch, len(x)))] for x in (positive, unlabelled))
        mp, mu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        clean = np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, mp).mean()
        of_clean = slopes(xu, _sigmoid(mu)) - prior * slopes(xp, _sigmoid(mp))
        of_toxic = prior * slopes(xp, _sigmoid(mp) - 1)
        slope = of_toxic + of_clean if clean >= 0 else -of_clean
        slope[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _counts(kept: dict[str, int]):
    """Texts by candidate (present, dense, and the same among the positives), summed in the task, and the parts of the
    rows that the fit takes."""
    columns = ["part", "present", "dense", "toxic_present", "toxic_dense", "positive", "at", "n", "total"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((4, len(kept)), np.int64)
        found = Parts(kept)
        for pdf in batches:
            rows = []
            for text, positive, drawn in zip(pdf["text"], pdf["positive"], pdf["drawn"], strict=True):
                at, n, total = found.counted(text)
                often = at[dense(n, total)]
                for first in (0, 2) if positive else (0,):
                    held[first, at] += 1
                    held[first + 1, often] += 1
                if positive or drawn:
                    rows.append((-1, 0, 0, 0, 0, bool(positive), at, n, total))
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame([(i, *held[:, i], False, [], [], 0) for i in np.flatnonzero(held[0])], columns=columns)

    return count


def _narrowed(place: dict[int, int]):
    """Keep the features of a row's parts."""

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = [[(place[p], int(k)) for p, k in zip(at, n, strict=True) if p in place] for at, n in zip(pdf["at"], pdf["n"], strict=True)]
            yield pdf.assign(at=[[p for p, _ in row] for row in known], n=[[k for _, k in row] for row in known])

    return narrow


def _matrix(rows: pd.DataFrame, k: int) -> np.ndarray:
    """Three blocks of k columns as in `Model`."""
    out = np.zeros((len(rows), 3 * k), np.float32)
    for i, (at, n, total) in enumerate(zip(rows["at"], rows["n"], rows["total"], strict=True)):
        at, n = np.asarray(at, np.int64), np.asarray(n, np.int64)
        out[i, at], out[i, at + k], out[i, at + 2 * k] = 1, n > 1, shares(n, total)
    return out


def trained(documents: DataFrame, labels: DataFrame, learn: Column, seeds: tuple[int, ...] = (1, 2, 3)) -> Model:
    """Fit on the labels for which `learn` holds; the prior is the share of toxic ones among them.

    Which rows are drawn is decided by a hash of their id; the bounds are POSITIVES and UNLABELLED, in expectation.
    What is collected is bounded by them, CANDIDATES and a text's distinct candidate words.
    """
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = stored(told, "toxic_labels")
    n_told, n_toxic = told.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    prior = min(max(n_toxic / n_told, LEAST_PRIOR), 0.5) if n_told else LEAST_PRIOR
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(2**32)) / 2.0**32
    toxic = told.where((F.col("toxic") == 1) & (chance < POSITIVES / max(n_toxic, 1))).select("doc_id", F.lit(True).alias("positive"))
    texts = documents.select("doc_id", text_of().alias("text")).join(F.broadcast(toxic), "doc_id", "left")
    n_docs = rows_in(documents)
    drawn = F.coalesce(chance < UNLABELLED / max(n_docs, 1), F.lit(False))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter[str] = Counter()
            for text in pdf["text"]:
                seen.update(set().union(*map(parts, set(WORD.findall(text.lower())))))
            yield pd.DataFrame(seen.items(), columns=["part", "n"])

    by_part = texts.where("positive").select("text").mapInPandas(found, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")).where("n >= 3")
    common = by_part.orderBy(F.desc("n"), "part").limit(CANDIDATES).collect()
    bare = Model({}, np.zeros((0, 1)), np.array([np.log(prior / (1 - prior))]))
    if not common:
        return bare
    kept = {r["part"]: i for i, r in enumerate(common)}
    marked = texts.select("text", F.coalesce("positive", F.lit(False)).alias("positive"), drawn.alias("drawn"))
    table = stored(marked.mapInPandas(_counts(kept), "part int, present long, dense long, toxic_present long, toxic_dense long, positive boolean, at array<int>, n array<int>, total long"), "toxic_parts")
    held = np.zeros((4, len(kept)))
    for r in table.where("part >= 0").groupBy("part").agg(*[F.sum(c) for c in ("present", "dense", "toxic_present", "toxic_dense")]).collect():
        held[:, r[0]] = r[1:]
    drawn_rows = table.where("part < 0")
    n_positive = rows_in(drawn_rows.where("positive"))
    if not n_positive:
        return bare
    inside, share = held[2:] / n_positive, np.clip(held[:2] / n_docs, 1 / n_docs, 1)
    deviations = np.where(inside >= RATIO * share, (inside - share) / np.sqrt(share * (1 - share) / n_positive + 1e-12), 0).max(axis=0)
    typical = np.flatnonzero(deviations >= DEVIATIONS)
    typical = typical[np.argsort(-deviations[typical], kind="stable")][:FEATURES]
    if not len(typical):
        return bare
    place = {int(p): i for i, p in enumerate(typical)}
    rows = drawn_rows.select("positive", "at", "n", "total").mapInPandas(_narrowed(place), "positive boolean, at array<int>, n array<int>, total long").toPandas()
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["total"].iat[i], *rows["at"].iat[i], *rows["n"].iat[i]))]  # the fit doesn't depend on how tasks ran
    toxic_rows, other_rows = rows[rows["positive"]], rows[~rows["positive"]]
    # Confirmed texts are texts of the corpus too: the unlabelled side holds its share of them.
    hidden = round(len(other_rows) * n_positive / max(n_docs - n_positive, 1))
    positive, unlabelled = _matrix(toxic_rows, len(place)), _matrix(pd.concat([other_rows, toxic_rows[:hidden]]), len(place))
    fits = [nn_pu_fit(positive, unlabelled, prior, seed) for seed in seeds]
    names = list(kept)
    return Model({names[w]: i for w, i in place.items()}, np.stack([w for w, _ in fits], axis=1), np.array([b for _, b in fits]))


def scored(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; the model has FEATURES parts at most."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Parts(model.index)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": model.scores(pdf["text"], found)})

    ids = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    found = rows.mapInPandas(score, f"doc_id {ids}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
