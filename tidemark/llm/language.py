"""Language identification by sparse multinomial logistic regression on character n-grams.

A text becomes the TF-IDF vector of its hashed 1- to 3-grams of letters (runs of
anything else count as one space).  Weights are learned by follow-the-regularised-
leader with elastic-net penalties, which leaves most of them exactly 0; a temperature
fitted on documents kept from training calibrates the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .folds import in_fold, sample_by_class

DIMENSIONS = 1 << 15
#: The classifier is fitted on at most so many documents, shared evenly among the languages.
TRAINING_DOCS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.01
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram of a whole text occurs; None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    c = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ c[1:]) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ c[2:]) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    return np.bincount(np.concatenate([one >> shift, two >> shift, three >> shift]), minlength=DIMENSIONS)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        x = (1 + np.log(counts[at])) * self.idf[at]
        return at, x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if self.languages else None
        if counts is None:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(*self.vector(counts)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with a letter, and in how many of them each n-gram occurs; each partition sums its own."""

    def partial(batches):
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts = gram_counts(text.as_py())
                if counts is not None:
                    total[:-1] += counts > 0
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["k", "v"])

    found = docs.select("text").mapInArrow(partial, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(DIMENSIONS + 1, np.int64)
    total[found["k"].to_numpy(int)] = found["v"].to_numpy(int)
    return int(total[-1]), total[:-1]


def train(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Weights and bias by FTRL-proximal over rows of (features, values, language)."""
    n_languages = len(model.languages)
    z, n = np.zeros((DIMENSIONS + 1, n_languages)), np.zeros((DIMENSIONS + 1, n_languages))

    def weights(at) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) > L1, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0)

    for _ in range(EPOCHS):
        for at, x, y in rows:
            at, x = np.append(at, DIMENSIONS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            squares = n[at]
            z[at] += g - (np.sqrt(squares + g * g) - np.sqrt(squares)) / ALPHA * w
            n[at] = squares + g * g
    w = weights(slice(None))
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, on a fixed grid."""
    grid = np.geomspace(0.02, 5, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, folds: int = 4, held: int = 2, training_docs: int = TRAINING_DOCS) -> Model:
    """A model from docs(doc_id, text, lang).

    Rows of an unknown language or id, or whose id's crc32 modulo folds is held, are not
    learned from.  Document frequencies count all other rows; the classifier is fitted
    on training_docs of them at most, those of each language whose ids hash lowest, each
    id once.  Whole texts count; of an n-gram that occurs over 65,535 times in one text,
    training sees so many.  An empty table, or one without a known language, gives a model
    that calls every text undetermined; other columns are ignored.
    """
    known = docs.filter(in_fold(F.col("doc_id"), folds, held) & F.col("lang").isNotNull())
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    n, df = document_frequencies(known)
    idf = np.log((n + 1) / (df + 1)) + 1
    model = Model(languages, idf, np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages)))
    if not languages or not n:
        model.languages = []
        return model
    each = max(2, training_docs // len(languages))
    # The sample has at most training_docs (or two a language) rows of id and language: small enough to broadcast.
    sample = sample_by_class(known.select(F.col("doc_id").cast("long"), "lang"), "lang", each)
    # Of rows that share an id and a language, the least text is learned from, so that no more rows than those are sent.
    chosen = known.select(F.col("doc_id").cast("long"), "text", "lang").join(F.broadcast(sample), ["doc_id", "lang"], "left_semi")
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")

    def make():
        def step(batch):
            rows = []
            for doc_id, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = gram_counts(text)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    rows.append((doc_id, languages.index(lang), at.astype("<u2").tobytes(), np.minimum(counts[at], 65535).astype("<u2").tobytes()))
            return pa.RecordBatch.from_pylist([dict(zip(("doc_id", "y", "at", "counts"), r, strict=True)) for r in rows], schema) if rows else None

        return step

    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("at", pa.binary()), ("counts", pa.binary())])
    rows = []
    for r in sorted(map_arrow(chosen, make, "doc_id long, y int, at binary, counts binary").collect(), key=lambda r: (r.doc_id * 0x9E3779B97F4A7C15 % (1 << 64), r.y)):
        counts = np.zeros(DIMENSIONS, np.int64)
        counts[np.frombuffer(r.at, "<u2")] = np.frombuffer(r.counts, "<u2")
        rows.append((*model.vector(counts), r.y))
    kept = rows[::5] if len(rows) >= 50 else []
    train(model, [r for i, r in enumerate(rows) if i % 5 or not kept])
    if kept:
        model.temperature = fit_temperature(np.array([model.logits(at, x) for at, x, _ in kept]), np.array([y for *_, y in kept]))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text of docs(doc_id, text).

    A null text, or one without a letter, is `und` with score 0, as is every text if no
    language could be learned.  Null ids and repeated rows are treated like any other row.
    """

    def make():
        def step(batch):
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=["doc_id", "lang_pred", "score"])

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double")
