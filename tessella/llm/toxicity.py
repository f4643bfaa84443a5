"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, in `BUCKETS` buckets, of its words, pairs of neighbours and pairs with one
word between. FTRL-proximal keeps a learning rate for each coordinate and an L1 term that leaves most weights at zero,
so the model that goes to the executors is a short list of (bucket, weight) of at most `MAX_WEIGHTS` entries.

It is fitted on a sample of labelled rows, at most `TRAIN_ROWS`, taken by a hash of the id: one bounded task. Scoring
reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, with_python, written
from .textvec import blocks, grams, words

BUCKETS = 1 << 22
TRAIN_ROWS = 12_000
MAX_WEIGHTS = 200_000
#: Texts of the sample that a bucket must occur in to be learned.
MIN_TEXTS = 5
FOLDS, HELD = 3, 1
THRESHOLD = 0.7

_SHIFT = np.uint64(64 - 22)
_SHAPES = ((0,), (0, 1), (0, 2))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the text), with repeats, for one block of texts."""
    hashes, owner = words(texts)
    found = [grams(hashes, owner, shape, seed) for seed, shape in enumerate(_SHAPES)]
    return np.concatenate([(h >> _SHIFT).astype(np.uint32) for h, _ in found]), np.concatenate([o for _, o in found])


@dataclass
class Ftrl:
    """FTRL-proximal for binary presence features."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0

    def __post_init__(self):
        self.z, self.n, self.bias = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), [0.0, 0.0]

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0
        return w

    def intercept(self) -> float:
        z, n = self.bias
        return -z / ((self.beta + n**0.5) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.intercept()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        old = self.n[at]
        self.n[at] = old + g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - np.sqrt(old)) / self.alpha * w
        z, n = self.bias
        self.bias = [z + g - ((n + g * g) ** 0.5 - n**0.5) / self.alpha * b, n + g * g]


def fit(texts: list[str], labels: list[int], epochs: int = 6) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets of the weights that are not zero, the weights, and the intercept."""
    rows: list[np.ndarray] = []
    for _, group in blocks(texts):
        at, owner = features(group)
        order = np.argsort(owner, kind="stable")
        at, cuts = at[order], np.searchsorted(owner[order], np.arange(1, len(group)))
        rows += [np.unique(x) for x in np.split(at, cuts)]
    seen = np.zeros(BUCKETS, np.int32)
    for at in rows:
        seen[at] += 1
    rows = [at[seen[at] >= MIN_TEXTS] for at in rows]
    model = Ftrl()
    for _ in range(epochs):
        for at, label in zip(rows, labels, strict=True):
            model.learn(at, label)
    w = model.weights(np.arange(BUCKETS))
    keep = np.flatnonzero(w)
    keep = np.sort(keep[np.argsort(-np.abs(w[keep]), kind="stable")[:MAX_WEIGHTS]])
    return keep, w[keep], model.intercept()


def training_rows(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, bound: int, id_col: str, text_col: str) -> DataFrame:
    """(h, text, label): labelled rows outside the held-out fold, at most `bound`, by a hash of the id."""
    l = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, held))
    l = l.groupBy("doc_id").agg(F.max(target).cast("int").alias("label")).withColumn("h", F.xxhash64(F.lit(11), "doc_id"))
    sample = written(l.orderBy("h").limit(bound), "labels").withColumnRenamed("doc_id", "label_id")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("h", "text", "label")
    # Of an id that several rows have one text is taken, so the sample is as large as its bound says at most.
    return rows.groupBy("h", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, *, target: str = "toxic", folds: int = FOLDS, held: int = HELD, bound: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """The model, from one task over the bounded sample. Without any labelled row it is empty and scores 0.5."""
    rows = training_rows(docs, labels, target, folds, held, bound, id_col, text_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, truth = [], []
        for frame in frames:
            texts += frame["text"].tolist()
            truth += frame["label"].tolist()
        at, w, b = fit(texts, truth)
        yield pd.DataFrame({"at": [at.astype(np.int32).tobytes()], "w": [w.astype(np.float32).tobytes()], "b": [float(b)]})

    model = rows.repartition(1).sortWithinPartitions("h", "label").mapInPandas(run, "at binary, w binary, b double").head()
    if model is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    return np.frombuffer(model["at"], np.int32), np.frombuffer(model["w"], np.float32), model["b"]


def scores(texts: list[str], model: tuple[np.ndarray, np.ndarray, float], dense: np.ndarray) -> np.ndarray:
    out = np.full(len(texts), model[2], np.float64)
    for first, group in blocks(texts):
        at, owner = features(group)
        hit = np.flatnonzero(dense[at])
        once = np.unique(owner[hit].astype(np.int64) * BUCKETS + at[hit])
        np.add.at(out, first + once // BUCKETS, dense[once % BUCKETS].astype(np.float64))
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score_column(text: Column, model: tuple[np.ndarray, np.ndarray, float]) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros(BUCKETS, np.float32)
        dense[model[0]] = model[1]
        for texts in batches:
            yield pd.Series(scores(texts.tolist(), model, dense))

    return score(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Only id and text are read. A null text counts as empty and scores the intercept alone. A null id is never a
    training row and not held out. Label rows without id or label are ignored; repeated ones count once, as toxic if
    any says so.
    """
    with_python(docs.sparkSession)
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col), FOLDS, HELD), F.lit(False)).alias("held_out"), score_column(F.col(text_col), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, in all its columns, without the rows that score at or above the threshold.

    Scores are those of score(): a null text counts as empty, equal texts have equal scores whatever their ids, an empty
    table gives no rows. Columns are looked up in docs alone, so none of the labels' clashes with them.
    """
    with_python(docs.sparkSession)
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(score_column(F.col(text_col), model) < threshold)
