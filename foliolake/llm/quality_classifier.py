"""Quality scores learned from preference pairs (Bradley-Terry).

A document's features are ratios over its whole text: classes of characters,
repetition of words, runs and lines, word lengths, frequent words. For pairs of
a good and a bad labelled document, the logistic loss of the weighted feature
difference is minimized (Newton's method, ridge penalty); the weighted features
are then a quality scale, up to a shift. Scores between 0 and 1 come from a
logistic fit of the labels on that scale, on the training rows. Two verdicts
follow: ``predicted`` by the score itself, and ``above_quantile`` by the quantile
of all scores that ``QUANTILE`` of the rows lie under.

At most ``TRAIN_ROWS`` labelled rows, by hash of doc_id and text, are learned
from, however many rows share an id, with ``PAIRS_EACH`` random partners for a
document of the rarer class; features of every document are computed where it is,
without a shuffle. Neither labels nor lang, source or doc_id are features.

Null and empty texts have features of zeros and get a score like any other. With
no labels of either class every score is the share of good ones, or 0.5. Null
labels don't count; a document labelled twice counts twice. Repeated rows stay.
An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm.storage import plain, table, written

TRAIN_ROWS = 20_000
PAIRS_EACH = 16
RIDGE = 1e-3
FOLDS, HELD_OUT = 5, 0
CUT = 0.3
QUANTILE = 0.3
SEED = 11

_SYMBOLS = b"#*$%&|<>!?.,;:\"'()[]{}=+/_-@^~\\`"


def features(text: str) -> np.ndarray:
    """The feature vector of a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256)
    n = max(1, len(raw))
    words = text.split()
    n_words = max(1, len(words))
    tally = Counter(words)
    top = tally.most_common(1)[0][1] if words else 0
    lines = [line for line in text.split("\n") if line.strip()]
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = Counter(zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    upper = sum(w.isupper() for w in words)
    alone = sum(c for w, c in tally.items() if not any(map(str.isalnum, w)))
    shares = [counts[c] / n for c in _SYMBOLS]
    shares += [counts[48:58].sum() / n, counts[65:91].sum() / n, counts[97:123].sum() / n, counts[128:].sum() / n, counts[10] / n, counts[32] / n]
    symbols = sum(counts[c] for c in b"#*$%&|<>!=+@^~")
    return np.array(
        [
            *np.sqrt(shares),
            min(1.0, symbols / n_words),
            upper / n_words,
            alone / n_words,
            top / n_words,
            runs / n_words,
            1 - len(pairs) / n_words,
            1 - len(tally) / n_words,
            1 - len(set(lines)) / max(1, len(lines)),
            lengths.mean() / 20,
            lengths.std() / 20,
            np.log1p(len(words)) / 10,
        ]
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        worth = ((rows - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * worth + self.shift, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights of a logistic fit of y in 0..1 on the columns of x, with a ridge penalty."""
    w = np.zeros(x.shape[1])
    loss = np.inf
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        now = -np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)) + ridge * (w @ w) / 2
        if loss - now < 1e-9:
            break
        loss = now
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) / len(x) + ridge * w)
    return w


def bradley_terry(rows: np.ndarray, labels: np.ndarray) -> Model:
    """The model of labelled feature rows (label 1: good)."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    mean = rows.mean(axis=0) if len(rows) else np.zeros(len(features("")))
    scale = rows.std(axis=0) + 1e-3 if len(rows) else np.ones_like(mean)
    if not len(good) or not len(bad):
        share = min(max(len(good) / len(rows), 1e-3), 1 - 1e-3) if len(rows) else 0.5
        return Model(mean, scale, np.zeros_like(mean), 1.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(SEED)
    x = (rows - mean) / scale
    rare, other = (bad, good) if len(bad) <= len(good) else (good, bad)
    mine = np.repeat(rare, PAIRS_EACH)
    partners = rng.choice(other, len(mine))
    better, worse = (partners, mine) if rare is bad else (mine, partners)
    weights = _newton(x[better] - x[worse], np.ones(len(mine)), RIDGE)
    worth = x @ weights
    shift, slope = _newton(np.stack((np.ones_like(worth), worth), axis=1), labels.astype(float), 1e-4)
    return Model(mean, scale, weights, float(slope), float(shift))


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def _measured(batch: pa.RecordBatch) -> np.ndarray:
    """The feature rows of a batch's texts."""
    return np.stack([features(t) for t in plain(batch.column("text"))]) if batch.num_rows else np.zeros((0, len(features(""))))


def _featured(docs: DataFrame) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("turn"), batch.column("quality"), pa.array(list(_measured(batch)), pa.list_(pa.float64()))], names=["turn", "quality", "features"])

    return docs.select("turn", "quality", "text").mapInArrow(measure, "turn long, quality int, features array<double>")


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The model learned from labels outside the held-out fold; at most ``train_rows`` rows come to the driver."""
    known = labels.filter(F.col("quality").isNotNull() & (_fold() != HELD_OUT)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(train_rows)
    turn = F.xxhash64("doc_id", "text", F.lit(SEED)).alias("turn")
    sample = _featured(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(turn, "quality", "text")).orderBy("turn", "quality").limit(train_rows).toPandas()
    if sample.empty:
        return bradley_terry(np.zeros((0, len(features("")))), np.zeros(0))
    rows, quality = np.stack(sample["features"].to_list()), sample["quality"].to_numpy()
    order = np.lexsort((*rows.T, quality))  # the same pairs whatever order the rows came in
    return bradley_terry(rows[order], quality[order])


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(_measured(batch)), pa.float64())], names=["doc_id", "score"])

    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rate, "doc_id long, score double")
    return rated.select("doc_id", F.coalesce(_fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def with_quantile(scored: DataFrame, share: float = QUANTILE) -> DataFrame:
    """``scored`` with above_quantile: whether the score is above the quantile that ``share`` of all rows lie under.

    The quantile is Spark's, to 1 in 10,000 of the rows; pass a written table, as it is read twice.
    """
    cut = scored.agg(F.percentile_approx("score", share, 10_000)).first()[0]
    return scored.withColumn("above_quantile", F.coalesce(F.col("score") > F.lit(cut), F.lit(False)))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_quantile(written(score(docs, fitted(docs, table(spark, sf_dir, "labels"))), "scores"))
