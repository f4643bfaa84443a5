"""Quality scores by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled documents of good quality; unlabelled web text is any document of the training folds,
whatever its label. With the class prior p, the risk of a scorer g under a loss l is estimated as

    p * E_positive[l(g, +1)]  +  max(0, E_unlabelled[l(g, -1)] - p * E_positive[l(g, -1)])

and where a mini-batch's second part is negative, the step goes the other way along it, which stops the scorer from
fitting the positives by heart. g is a small network over statistics of the whole text (shares of character classes,
repetition of words, word runs and lines, lengths); the loss is logistic, so the sigmoid of g estimates the posterior.

The prior is the share of positives among the labelled rows of the training folds. Fitting uses at most `POSITIVES`
and `UNLABELLED` rows, taken by a hash of the id: one bounded task. Scoring reads every whole text.
"""

from __future__ import annotations

import functools
import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, with_python, written
from .textvec import blocks, code_points, grams, span_hashes, words

FOLDS, HELD = 5, 0
THRESHOLD = 0.3
POSITIVES, UNLABELLED = 8_000, 12_000

#: Characters that are a class of their own.
MARKS = "\n.,!?;:'\"-()[]{}<>|/\\#$%&*@=+_~^`"
LOWER, UPPER, LETTER, DIGIT, SPACE, OTHER = range(6)


@functools.cache
def char_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    kinds = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Lm": LETTER, "Lo": LETTER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": SPACE}
    for c in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(c)))
        if kind is not None:
            out[c] = kind
    out[[9, 11, 12, 13]] = SPACE
    for i, c in enumerate(MARKS):
        out[ord(c)] = 6 + i
    return out


_CLASSES = 6 + len(MARKS)


def _distinct(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By owner: how many distinct keys, and how often the commonest occurs."""
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(o)))
    most = np.zeros(n)
    np.maximum.at(most, o[at], size)
    return np.bincount(o[at], minlength=n).astype(float), most


def statistics(texts: list[str]) -> np.ndarray:
    """One row of features for each text, of one block of texts."""
    n = len(texts)
    text = "\n".join([*texts, ""])
    cp = code_points(text)
    length = np.array([len(t) + 1 for t in texts])
    classes = char_classes()[cp]
    owner = np.repeat(np.arange(n), length)
    share = np.bincount(owner * _CLASSES + classes, minlength=n * _CLASSES).reshape(n, _CLASSES) / length[:, None]
    hashes, of = words(texts)
    total = np.bincount(of, minlength=n).astype(float)
    some = np.maximum(total, 1)
    kinds, top = _distinct(of, hashes, n)
    runs, run_of = grams(hashes, of, (0, 1, 2, 3), 7)
    run_total = np.maximum(np.bincount(run_of, minlength=n), 1)
    run_kinds, run_top = _distinct(run_of, runs, n)
    pair, pair_of = grams(hashes, of, (0, 1), 9)
    pair_kinds, _ = _distinct(pair_of, pair, n)
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]))
    ends = np.flatnonzero(cp == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    line_of = owner[begins]
    filled = ends > begins
    last = np.where(filled, classes[np.maximum(ends - 1, 0)], OTHER)
    closed = np.isin(last, [6 + MARKS.index(c) for c in ".!?"])
    lines = np.maximum(np.bincount(line_of[filled], minlength=n), 1)
    line_kinds, _ = _distinct(line_of[filled], span_hashes(text, cp, begins[filled], ends[filled]), n)
    change = np.flatnonzero(np.diff(classes)) + 1
    letters = share[:, LOWER] + share[:, UPPER] + share[:, LETTER]
    columns = [
        np.log1p(length), np.log1p(total), length / some / 10, kinds / some, top / some, np.log1p(kinds), np.log1p(kinds) / np.log1p(some),
        run_kinds / run_total, run_top / run_total, pair_kinds / some, np.bincount(of[same], minlength=n) / some,
        np.log1p(lines), line_kinds / lines, np.bincount(line_of[filled & closed], minlength=n) / lines, np.log1p(length / lines),
        np.bincount(owner[change], minlength=n) / length, letters, share[:, UPPER] / np.maximum(letters, 1e-9),
    ]
    return np.column_stack([*columns, np.log1p(200 * share)]).astype(np.float32)


class Scorer:
    """A network with one hidden layer, fitted to the non-negative positive-unlabelled risk by Adam."""

    def __init__(self, width: int, hidden: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.tanh(x @ self.p[0] + self.p[1])
        return a @ self.p[2] + self.p[3], a

    def gradient(self, x: np.ndarray, a: np.ndarray, dg: np.ndarray) -> list[np.ndarray]:
        da = np.outer(dg, self.p[2]) * (1 - a * a)
        return [x.T @ da, da.sum(0), a.T @ dg, np.array([dg.sum()])]

    def risk_gradient(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> list[np.ndarray]:
        """Of prior * E+[l(g)] + max(0, Eu[l(-g)] - prior * E+[l(-g)]), l being the logistic loss.

        Where the second part is below zero, a step goes up that part alone, which takes back what was fitted too far.
        """
        sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -35, 35)))
        (gp, ap), (gu, au) = self.forward(positive), self.forward(unlabelled)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up, over, uu = -prior * sigmoid(-gp) / len(gp), -prior * sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)
        if negative >= 0:
            return [x + y for x, y in zip(self.gradient(positive, ap, up + over), self.gradient(unlabelled, au, uu), strict=True)]
        return [-(x + y) for x, y in zip(self.gradient(positive, ap, over), self.gradient(unlabelled, au, uu), strict=True)]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 300, batch: int = 2048, rate: float = 0.005, decay: float = 1e-4) -> None:
        both = np.concatenate((positive, unlabelled))
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        xp, xu = (np.clip((x - self.mean) / self.scale, -6, 6) for x in (positive, unlabelled))
        batch = min(batch, max(1, len(xu) // 5))  # five steps an epoch at least: small samples need as many
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            for _ in range(max(1, len(xu) // batch)):
                bp, bu = xp[self.rng.integers(0, len(xp), batch)], xu[self.rng.integers(0, len(xu), batch)]
                t += 1
                for i, g in enumerate(self.risk_gradient(bp, bu, prior)):
                    g = g + decay * self.p[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        g, _ = self.forward(np.clip((x - self.mean) / self.scale, -6, 6))
        return 1 / (1 + np.exp(-np.clip(g, -35, 35)))


def rows_of(texts: list[str]) -> np.ndarray:
    return np.concatenate([statistics(group) for _, group in blocks(texts)])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """((h, text, positive) of both samples, the estimated prior)."""
    l = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD))
    l = written(l.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).withColumn("h", F.xxhash64(F.lit(13), "doc_id")), "labels")
    prior = l.agg(F.avg(F.col("quality").cast("double"))).head()[0]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    good = l.where("quality = 1").orderBy("h").limit(POSITIVES).select(F.col("doc_id").alias("pick"), "h", F.lit(1).alias("positive"))
    ids = texts.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD)).select("doc_id").distinct().withColumn("h", F.xxhash64(F.lit(17), "doc_id"))
    any_ = ids.orderBy("h").limit(UNLABELLED).select(F.col("doc_id").alias("pick"), "h", F.lit(0).alias("positive"))
    picked = written(good.unionByName(any_), "picked")
    rows = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("pick")).select("h", "text", "positive")
    # Of an id that several rows have one text is taken, so the samples are as large as their bounds say at most.
    one = rows.groupBy("h", "positive").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one, prior if prior is not None else 1.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer | None:
    """The fitted scorer, or None if there is no positive row to learn from."""
    rows, prior = training_rows(docs, labels, id_col, text_col)
    prior = min(max(prior, 0.01), 0.99)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xs, ys = [], []
        for frame in frames:
            xs.append(rows_of(frame["text"].tolist()))
            ys.append(frame["positive"].to_numpy())
        if xs:
            x, y = np.concatenate(xs).astype(np.float64), np.concatenate(ys)
            if (y == 1).any() and (y == 0).any():
                scorer = Scorer(x.shape[1])
                scorer.fit(x[y == 1], x[y == 0], prior)
                yield pd.DataFrame({"model": [pickle.dumps(scorer)]})

    found = rows.repartition(1).sortWithinPartitions("h", "positive").mapInPandas(run, "model binary").head()
    if found is None:
        return None
    return pickle.loads(bytes(found["model"]))


def score_column(text: Column, scorer: Scorer | None) -> Column:
    if scorer is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scorer.score(rows_of(texts.tolist())))

    return score(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Only id and text are read. A null text counts as empty. A null id is never a training row and not held out.
    Label rows without id or label are ignored; repeated ones count once, as bad if any says so. Without a positive
    label every score is 0.5.
    """
    with_python(docs.sparkSession)
    scorer = train(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col), FOLDS, HELD), F.lit(False)).alias("held_out"), score_column(F.col(text_col), scorer).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
