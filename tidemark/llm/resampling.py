"""Importance resampling towards a target: hashed n-gram features, counted through suffix arrays.

A document's features are its runs of up to `top` consecutive words, each hashed to a
bucket.  How much likelier a bucket is in the target texts than in the corpus is its gain;
a document's weight sums the gains of its features, and the documents of the highest
weights plus Gumbel noise are drawn, which samples without replacement in proportion to
the exponentials of the weights.

A block of words becomes an array of word ids and its suffix array, to a depth of `top`
words.  Neighbours in it that share m words or more (their LCP) are one run of equal
m-grams: each run is hashed once, whatever the number of its occurrences, and counted by
its length, or its bucket is scattered back to the places where the m-gram starts.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, places, stash

BUCKETS = 10_000
#: Words of a block, about, and bytes of a text that are looked at at once; longer texts are cut and their n-grams across cuts kept.
BLOCK_WORDS, SEGMENT_BYTES = 1 << 19, 1 << 22

#: Bytes of words in lower case; all others become spaces.
_FOLD = bytes(b if b >= 0x80 else ord(c) if (c := chr(b).lower()).isalnum() else 0x20 for b in range(256))


@dataclass
class Piece:
    """Consecutive words of document number doc; the first `carried` of them were in the piece before."""

    doc: int
    words: list[bytes]
    carried: int


def pieces(texts: list[str | None], top: int) -> Iterator[Piece]:
    """The words of whole texts, long ones in several pieces that overlap by top - 1 words."""
    for doc, text in enumerate(texts):
        folded = (text or "").encode("utf-8", "replace").translate(_FOLD)
        at, carry = 0, []
        while at < len(folded):
            stop = len(folded) if len(folded) - at <= SEGMENT_BYTES else folded.find(b" ", at + SEGMENT_BYTES)
            stop = len(folded) if stop < 0 else stop
            words = carry + folded[at:stop].split()
            yield Piece(doc, words, len(carry))
            carry = words[len(words) - min(top - 1, len(words)) :]
            at = stop


def blocks(texts: list[str | None], top: int) -> Iterator[list[Piece]]:
    held: list[Piece] = []
    size = 0
    for piece in pieces(texts, top):
        held.append(piece)
        size += len(piece.words)
        if size >= BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def suffix_array(ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of suffixes in order of their first top ids, and how many ids each shares with the one before it.

    By prefix doubling.  Id 0 ends a document: nothing is shared from there on.  ids ends
    with top - 1 of it.
    """
    n = len(ids) - (top - 1)
    rank, depth = ids, 1
    while depth < top:
        step = min(depth, top - depth)
        ahead = np.concatenate([rank[step:], np.zeros(step, rank.dtype)])
        rank = np.unique(rank * (int(ahead.max(initial=0)) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        depth += step
    order = np.argsort(rank[:n], kind="stable")
    shared = np.zeros(n, np.int64)
    same = np.ones(max(n - 1, 0), bool)
    for k in range(top):
        here = ids[order + k]
        same &= (here[1:] == here[:-1]) & (here[1:] > 0)
        shared[1:] += same
    return order, shared


def runs(block: list[Piece], top: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length up to top: the bucket of each run of equal n-grams, its occurrences' run, and their documents."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = lambda: len(numbers) + 1
    gap = [0] * (top - 1)
    flat: list[int] = []
    for p in block:
        flat += map(numbers.__getitem__, p.words)
        flat += gap
    ids = np.array(flat, np.int64)
    words = [b"", *numbers]
    sizes = np.array([len(p.words) + top - 1 for p in block], np.int64)
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.array([p.doc for p in block], np.int64), sizes)
    place = np.arange(len(ids)) - np.repeat(starts, sizes)
    left = np.repeat(sizes - (top - 1), sizes) - place
    carried = np.repeat(np.array([p.carried for p in block], np.int64), sizes) - place
    order, shared = suffix_array(ids, top)
    for m in range(1, top + 1):
        run = np.cumsum(shared < m)
        # An n-gram that lies in the words carried over was counted with the piece before.
        kept = (left[order] >= m) & (carried[order] < m)
        at, run = order[kept], run[kept]
        if not len(at):
            continue
        first = np.concatenate([[True], run[1:] != run[:-1]])
        heads = ids[at[first][:, None] + np.arange(m)]
        if m == 1:
            hashes = [zlib.crc32(words[i]) for i in heads[:, 0].tolist()]
        else:
            hashes = [zlib.crc32(b" ".join([words[i] for i in head])) for head in heads.tolist()]
        yield np.array(hashes, np.int64) % buckets, np.cumsum(first) - 1, doc[at]


def count_buckets(texts: list[str | None], top: int, buckets: int) -> np.ndarray:
    counts = np.zeros(buckets, np.int64)
    for block in blocks(texts, top):
        for bucket, run, _ in runs(block, top, buckets):
            np.add.at(counts, bucket, np.bincount(run, minlength=len(bucket)))
    return counts


def weigh(texts: list[str | None], top: int, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, features and weight of each text."""
    words, features, weights = (np.zeros(len(texts), np.int64) for _ in range(3))
    for block in blocks(texts, top):
        for p in block:
            words[p.doc] += len(p.words) - p.carried
        for bucket, run, doc in runs(block, top, len(gains)):
            features += np.bincount(doc, minlength=len(texts))
            # Sums of whole numbers below 2**53 are exact.
            weights += np.bincount(doc, gains[bucket][run], len(texts)).astype(np.int64)
    return words, features, weights


def bucket_counts(texts: DataFrame, top: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features by bucket in all of texts(text); null texts have none.

    One row of counts leaves each task; at most `buckets` rows reach the driver.
    """
    if top < 1 or buckets < 1:
        raise ValueError("top and buckets must be positive")
    schema = pa.schema([("counts", pa.list_(pa.int64()))])

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                total += count_buckets(batch.column(0).slice(at, 2048).to_pylist(), top, buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], schema=schema)

    parts = texts.select("text").mapInArrow(run, "counts array<long>").select(F.posexplode("counts").alias("bucket", "n")).filter("n > 0")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier each bucket is in the target), with one occurrence added to each bucket."""
    k = len(corpus)
    s_all, t_all = float(corpus.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.float64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 * a standard Gumbel number), from the seed and the id alone (a null id: the empty string)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gains: np.ndarray, top: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every whole text of docs(doc_id, text).

    A null or empty text has no features and weight 0.  Null ids and repeated rows are
    scored like any other row; rows of one id share its noise.
    """

    def make():
        def step(batch):
            doc_ids = batch.column(0).to_pylist()
            words, features, weights = weigh(batch.column(1).to_pylist(), top, gains)
            scores = weights + np.array([noise(d, seed) for d in doc_ids], np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weights, scores))], names=["doc_id", "n_words", "n_features", "weight", "score"])

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, top: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document of docs(doc_id, text), drawn towards target(text).

    Of the N documents with at least least_words words, floor(percent * N / 100) of the
    highest scores get ranks 1, 2, ...; equal scores go to the smaller id (null ids
    first), and rows alike in both are interchangeable.  All others have a null rank.  An
    empty target or corpus counts as buckets of one occurrence each; an empty docs gives
    no rows.  Other columns are ignored.
    """
    gains = gains_of(bucket_counts(docs, top, buckets), bucket_counts(target, top, buckets))
    scored = stash(score(docs, gains, top, seed), "scored")
    fit = F.col("n_words") >= least_words
    placed, n = places(scored.filter(fit), [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") < percent * n // 100, F.col("rank") + 1))
    rest = scored.filter(~fit).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).drop("n_words")
