"""Toxicity scores that do not lean on mentions of groups.

A text's features are its distinct words and their beginnings.  A logistic regression
over those most associated with the label, and over identity terms, is fitted with a
counterfactual penalty: each sentence of a labelled text that mentions a group is copied
with the group's name swapped for others, and changes of score between a sentence and its
copies are penalised.  What a group's name gathers from the texts that it happens to
occur in is so evened out over the group, and neutral mentions stay neutral.

A labelled text without any mention gets one: a neutral phrase with an identity term is
put into one of its sentences, and neither the mention nor its swap may change the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_arrow
from .folds import in_fold, labelled, sample_by_class

#: The classifier is fitted on at most so many labelled documents of each class.
SAMPLE_PER_CLASS = 6000
#: Features that the classifier may weigh, and the different documents a feature must occur in.
VOCABULARY, LEAST_DOCS = 4096, 5
#: A feature must be so much likelier to mark the label than a text at random, with this many standard errors to spare.
LIFT, CERTAINTY = 1.5, 3.5
#: Lengths of the beginnings of words that count as features.
BEGINNINGS = (4, 5, 6)
FEATURE_BITS = 20
PENALTY_L2, PENALTY_SWAP, STEPS = 1e-5, 1.0, 400
#: Words whose features a Python worker remembers.
CACHE_WORDS = 100_000

#: Identity terms by group; a term is swapped for others of its group.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("young", "old", "elderly"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
)
#: A neutral phrase for each group, that mentions one of its terms.
CARRIERS: tuple[str, ...] = (
    "many {} live here",
    "a {} spoke at the meeting",
    "the {} played after school",
    "the {} met in the hall",
    "a {} family lives next door",
    "a {} friend of ours came",
    "some {} neighbours came",
    "the {} arrived this year",
    "the {} people sat outside",
    "a {} student read aloud",
    "viele {} wohnen hier",
    "die {} trafen sich",
    "beaucoup de {} habitent ici",
    "les {} se sont réunis",
    "muchas personas y {} viven aquí",
    "los {} se reunieron",
)
#: Other terms of the group that each term is swapped for.
SWAPS = 2

_SENTENCE_END = re.compile(r"[.!?。！？]+\s|\n+")
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=CACHE_WORDS // 4)
def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings."""
    names = [f"={word}"] + [f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n]
    return tuple(xxhash.xxh32_intdigest(x.encode("utf-8", "replace")) >> (32 - FEATURE_BITS) for x in names)


kept(word_features.cache_clear)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(words: set[str]) -> np.ndarray:
    """The sorted distinct features of a set of words."""
    return np.unique(np.fromiter((f for w in words for f in word_features(w)), np.uint32))


@lru_cache(maxsize=8)
def _places(groups: tuple[tuple[str, ...], ...]) -> dict[str, tuple[tuple[str, ...], int]]:
    """The group of each term and its place there."""
    return {t: (g, i) for g in groups for i, t in enumerate(g)}


def swapped(words: set[str], groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> list[set[str]]:
    """Counterfactual copies: every identity term exchanged for the k-th after it in its group, k = 1..SWAPS."""
    place = _places(groups)
    found = {w: place[w] for w in words & place.keys()}
    rest = words - found.keys()
    return [rest | {g[(i + k) % len(g)] for g, i in found.values()} for k in range(1, SWAPS + 1)] if found else []


def counterfactuals(text: str | None, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, carriers: tuple[str, ...] = CARRIERS) -> list[tuple[set[str], set[str]]]:
    """Sentences of a labelled text and copies of them that should score alike, as sets of words.

    Each sentence with identity terms is paired with its swapped copies.  A text without
    such a sentence lends one, which its own hash chooses: that is paired with itself with
    a carrier's mention in it, and this again with its swapped copies.
    """
    sentences = [w for s in _SENTENCE_END.split(text or "") if (w := words_of(s))]
    pairs = [(words, copy) for words in sentences for copy in swapped(words, groups) if copy != words]
    if pairs or not sentences or not groups:
        return pairs
    chosen = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    words, g = sentences[chosen % len(sentences)], (chosen >> 24) % len(groups)
    term = groups[g][(chosen >> 48) % len(groups[g])]
    mention = words | words_of(carriers[g % len(carriers)].format(term))
    return [(words, mention), *((mention, copy) for copy in swapped(mention, groups[g : g + 1]) if copy != mention)]


def difference(words: set[str], copy: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features that a counterfactual copy adds and those that it removes."""
    before, after = features_of(words), features_of(copy)
    return np.setdiff1d(after, before), np.setdiff1d(before, after)


def differences(text: str | None, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> list[tuple[np.ndarray, np.ndarray]]:
    """What the counterfactual copies of a text's sentences add and remove, each kind once: few, however long the text."""
    found = {}
    for pair in counterfactuals(text, groups):
        added, removed = difference(*pair)
        found[added.tobytes(), removed.tobytes()] = (added, removed)
    return list(found.values())


@dataclass
class Model:
    """Features (sorted), their weights, the bias, and how many counterfactual copies the fit used."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    swaps: int = 0

    def __post_init__(self):
        self._weight = {int(f): float(w) for f, w in zip(self.features, self.weights, strict=True) if w}
        self._words: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        hit: set[int] = set()
        if len(self._words) > CACHE_WORDS:
            self._words.clear()
        for word in words_of(text):
            own = self._words.get(word)
            if own is None:
                own = self._words[word] = tuple(f for f in _uncached_features(word) if f in self._weight)
            if own:
                hit.update(own)
        z = self.bias + sum(self._weight[f] for f in sorted(hit))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


_uncached_features = word_features.__wrapped__


def _matrix(rows: list[np.ndarray], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the entries of a presence matrix over sorted features."""
    known = np.zeros(1 << FEATURE_BITS, bool)
    known[features] = True
    kept = [r[known[r]] for r in rows]
    return np.repeat(np.arange(len(rows)), [len(r) for r in kept]), np.searchsorted(features, np.concatenate([*kept, np.zeros(0, np.uint32)]))


def learn(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], penalty_swap: float = PENALTY_SWAP, mentions: np.ndarray | None = None) -> Model:
    """A model from feature rows, labels and row weights; swaps are (added, removed) features of counterfactual copies.

    mentions are features that the model weighs whether they are telling or not.

    Log loss + L2 + penalty_swap * mean squared change of the logit under a swap, by a
    fixed number of full-batch Adam steps: the result depends on the rows alone.  Features
    are those that the label favours and weights are not negative, so that no amount of
    harmless text makes up for an insult.
    """
    # Copies of a text count once, else all words of a much copied one would look telling.
    total, bad = (np.zeros(1 << FEATURE_BITS, np.int64) for _ in range(2))
    for row, label in {(r.tobytes(), int(v)): (r, v) for r, v in zip(rows, y, strict=True)}.values():
        total[row] += 1
        if label:
            bad[row] += 1
    prior = float((weight * y).sum() / weight.sum())
    at = np.flatnonzero(total >= LEAST_DOCS)
    # The lower end of the interval (Wilson's) for the label's share among texts with the feature.
    n, p, z = total[at], bad[at] / total[at], CERTAINTY
    low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    telling = low > min(LIFT * y.mean(), (1 + y.mean()) / 2)
    features = at[telling][np.argsort(-low[telling], kind="stable")[:VOCABULARY]]
    if mentions is not None:
        features = np.union1d(features, mentions[total[mentions] >= LEAST_DOCS])
    features = np.sort(features).astype(np.uint32)
    k = len(features)
    at, column = _matrix(rows, features)
    bias = float(np.log(prior / (1 - prior)))
    if not k:
        return Model(features, np.zeros(0), bias)
    s_at, s_column = _matrix([added for added, _ in swaps], features)
    o_at, o_column = _matrix([removed for _, removed in swaps], features)
    w = np.zeros(k + 1)
    w[-1] = bias
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    weight = weight / weight.sum()
    for step in range(1, STEPS + 1):
        z = np.bincount(at, w[column], len(rows)) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.append(np.bincount(column, error[at], k) + PENALTY_L2 * w[:-1], error.sum())
        if len(swaps):
            change = np.bincount(s_at, w[s_column], len(swaps)) - np.bincount(o_at, w[o_column], len(swaps))
            pull = 2 * penalty_swap / len(swaps) * change
            g[:-1] += np.bincount(s_column, pull[s_at], k) - np.bincount(o_column, pull[o_at], k)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.1 * (1 - step / (STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        np.maximum(w[:-1], 0, out=w[:-1])
    return Model(features, w[:-1], float(w[-1]), len(swaps))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = SAMPLE_PER_CLASS, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, penalty_swap: float = PENALTY_SWAP) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, label 0 or 1).

    Ids whose crc32 modulo folds is held are not learned from.  At most per_class labelled
    documents of each class are used (those whose ids hash lowest, each id once, of rows
    that share an id the least text), weighted back to the class's share of all labelled
    rows.  A null text is one without words; null ids and labels are not learned from.
    With one class or none, every score is that class's smoothed share, 0.5 without labels.
    """
    known = labels.filter(in_fold(F.col("doc_id"), folds, held))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    positive, n = counts.get(1, 0), sum(counts.values())
    if not 0 < positive < n:
        share = (positive + 0.5) / (n + 1)
        return Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(share / (1 - share))))
    # At most 2 * per_class rows of two numbers: small enough to broadcast.
    sample = sample_by_class(known, "label", per_class)
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def make():
        def step(batch):
            out = []
            for doc_id, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                swaps = differences(text, groups)
                out.append((doc_id, label, features_of(words_of(text)).tobytes(), [a.tobytes() for a, _ in swaps], [r.tobytes() for _, r in swaps]))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

        return step

    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.binary()), ("added", pa.list_(pa.binary())), ("removed", pa.list_(pa.binary()))])
    found = sorted(map_arrow(chosen, make, "doc_id long, label int, features binary, added array<binary>, removed array<binary>").collect(), key=lambda r: r.doc_id)
    y = np.array([r.label for r in found])
    if not 0 < y.sum() < len(y):
        share = (positive + 0.5) / (n + 1)
        return Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(share / (1 - share))))
    rows = [np.frombuffer(r.features, np.uint32) for r in found]
    weight = np.where(y == 1, positive / y.sum(), (n - positive) / (len(y) - y.sum()))
    swaps = [tuple(np.frombuffer(x, np.uint32) for x in pair) for r in found for pair in zip(r.added, r.removed, strict=True)]
    return learn(rows, y, weight, swaps, penalty_swap, mentions=features_of({t for g in groups for t in g}))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every whole text of docs(doc_id, text).

    A null or empty text has no features and scores the bias; null ids and repeated rows
    are scored like any other; an empty table gives no rows; other columns are ignored.
    """

    def make():
        def step(batch):
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below threshold.

    A null or empty text scores the model's bias; rows with null ids are judged by their
    text, repeated rows alike; an empty table gives no rows; columns of any name are kept.
    """
    at = docs.columns.index("text")

    def make():
        def step(batch):
            return batch.filter(pa.array([model.score(t) < threshold for t in batch.column(at).to_pylist()]))

        return step

    return map_arrow(docs, make, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, score of every document of docs(doc_id, text), learned from labels(doc_id, label).

    A null or empty text has no features and scores the bias.  Null ids and repeated rows
    are scored; a null id is never learned from.  An empty table gives no rows.
    """
    return score(docs, fit(docs, labelled(labels, label), folds, held))
