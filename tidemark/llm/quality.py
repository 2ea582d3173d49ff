"""Quality scores: ridge regression on random Fourier features of document statistics.

Statistics of a whole text are standardised; cosines of random projections
approximate a Gaussian kernel over them.  Each partition sums its part of the normal
equations; the driver gets their total, whose size does not depend on the data.
Labels kept from the fit then give an isotonic map from ridge score to probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, map_arrow, map_batches, stash
from .folds import in_fold, labelled

FEATURES = 128
RIDGE = 1e-4
SEED = 7
#: Bins of ridge scores on the way to the isotonic fit.
BINS = 1024

STATISTICS = ("log_words", "word_length", "upper", "digits", "symbols", "pipes", "stops", "commas", "marks", "distinct_words", "repeated_words", "repeated_lines", "long_words", "letters", "longest_word", "non_ascii", "line_words", "mixed_words")

_CLASS = np.zeros((256, 9))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"*$%&#@^~<>{}[]=+\\_/`", b"|", b".;:", b",", b"!?", b"abcdefghijklmnopqrstuvwxyz", bytes(range(128, 256)))):
    _CLASS[list(_chars), _k] = 1


def statistics_of(text: str | None) -> list[float]:
    """The STATISTICS of a whole text; all zero for a null or empty one."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    upper, digits, symbols, pipes, stops, commas, marks, lower, wide = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    size, n = len(raw), len(words)
    letters = upper + lower + wide
    lines = text.split("\n")
    lengths = list(map(len, words))
    distinct = set(words)
    return [
        math.log1p(n),
        sum(lengths) / n,
        upper / max(letters, 1),
        digits / size,
        symbols / size,
        pipes / n,
        stops / n,
        commas / n,
        marks / n,
        len(distinct) / n**0.8,
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        sum(x > 20 for x in lengths) / n,
        letters / size,
        math.log1p(max(lengths)),
        wide / size,
        math.log1p(n / len(lines)),
        sum(not w.isalpha() for w in distinct) / len(distinct),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats array<double> of every whole text of docs(doc_id, text).

    A null, empty or white-space text has statistics of 0; null ids and repeated rows are
    measured like any other; an empty table gives no rows; other columns are ignored.
    """

    def make():
        def step(batch):
            found = pa.array([statistics_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "stats"])

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, stats array<double>")


@dataclass
class Model:
    """mean, scale: of statistics; directions, phases: of the cosines; weights: ridge; knots: ridge score -> probability."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.concatenate([waves, np.ones((len(z), 1))], axis=1)

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge(stats), *self.knots)


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit to good / n at ascending x (pool adjacent violators), each pool at its mean x."""
    pools: list[list[float]] = []
    for a, g, w in zip(x, good, n, strict=True):
        pools.append([a * w, g, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    # One row of each class is added to a pool, so that no score is 0 or 1 on thin evidence.
    return np.array([p[0] / p[2] for p in pools]), np.maximum.accumulate([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def _batch_stats(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def fit(stats: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """A model from stats(doc_id, stats) and labels(doc_id, label 0 or 1).

    Ids whose crc32 modulo folds is held are never learned from; the last other fold is
    kept for calibration and the rest fit the ridge.  Every such labelled row counts.
    Without labels (or with one class) the score is that class's smoothed share, 0.5
    without any.  A null id meets no label; rows that share a labelled id all count; an
    empty table is one without labels.
    """
    rows = stats.join(labels, "doc_id").filter(in_fold(F.col("doc_id"), folds, held))
    rows = stash(rows.withColumn("fold", bucket(F.col("doc_id"), folds)), "labelled-stats")
    last = (held - 1) % folds
    learn, keep = rows.filter(F.col("fold") != last), rows.filter(F.col("fold") == last)
    d = len(STATISTICS)
    each = [F.col("stats")[i] for i in range(d)]
    sums = learn.agg(F.count("*"), F.sum("label"), *[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    n, positive = sums[0], sums[1] or 0
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(0, 1 / math.sqrt(d), (d, features)), rng.uniform(0, 2 * math.pi, features)
    if not 0 < positive < n:
        share = (positive + 0.5) / (n + 1)
        return Model(np.zeros(d), np.ones(d), directions, phases, np.zeros(features + 1), (np.zeros(1), np.full(1, share)))
    mean = np.array(sums[2 : 2 + d])
    scale = np.maximum(np.array(sums[2 + d :]), 1e-6)
    model = Model(mean, scale, directions, phases, np.zeros(features + 1), (np.zeros(1), np.zeros(1)))
    size = features + 2
    upper = np.triu_indices(size)

    def partial(batches):
        """This partition's sums of products of features and label, upper triangle."""
        total = np.zeros((size, size))
        for batch in batches:
            x = np.concatenate([model.features(_batch_stats(batch.column(0))), batch.column(1).to_numpy()[:, None]], axis=1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], names=["k", "v"])

    summed = map_batches(learn.select("stats", "label"), partial, "k int, v double").groupBy("k").agg(F.sum("v")).toPandas().sort_values("k")
    total = np.zeros((size, size))
    total[upper] = summed.iloc[:, 1].to_numpy()
    total += np.triu(total, 1).T
    model.weights = np.linalg.solve(total[:-1, :-1] + ridge * n * np.eye(features + 1), total[:-1, -1])

    def binned(batches):
        for batch in batches:
            at = np.clip((model.ridge(_batch_stats(batch.column(0))) + 0.5) * (BINS / 2), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1).cast(pa.int32())], names=["bin", "label"])

    counted = map_batches(keep.select("stats", "label"), binned, "bin int, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).toPandas().sort_values("bin")
    if len(counted):
        model.knots = isotonic((counted["bin"].to_numpy() + 0.5) / (BINS / 2) - 0.5, counted["good"].to_numpy(float), counted["n"].to_numpy(float))
    else:
        model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of stats(doc_id, stats)."""

    def make():
        def step(batch):
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_batch_stats(batch.column(1))))], names=["doc_id", "score"])

        return step

    return map_arrow(stats.select("doc_id", "stats"), make, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores at least threshold.

    A null or empty text is scored by statistics of 0; rows with null ids are judged by
    their text, repeated rows alike; an empty table gives no rows; columns of any name are
    kept.
    """
    at = docs.columns.index("text")

    def make():
        def step(batch):
            stats = np.array([statistics_of(t) for t in batch.column(at).to_pylist()])
            return batch.filter(pa.array(model.score(stats) >= threshold))

        return step

    return map_arrow(docs, make, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, score of every document of docs(doc_id, text), learned from labels(doc_id, label).

    A null, empty or white-space text has statistics of 0 and a score like any other.
    Null ids and repeated rows are scored; a null id is never learned from.  An empty
    table gives no rows.
    """
    stats = stash(statistics(docs), "stats")
    return score(stats, fit(stats, labelled(labels, label), folds, held))
