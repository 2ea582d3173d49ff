"""Resampling and whitening against their definitions, worked out without Spark."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import common, queries, resampling, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets_of(text, top, k):
    ws = words(text)
    return [zlib.crc32(" ".join(ws[i : i + m]).encode()) % k for m in range(1, top + 1) for i in range(len(ws) - m + 1)]


def drawn(docs, target, percent=10, least=20, top=1, k=10_000, seed=2024):
    """Rows of resample, from the definition; docs are (doc_id, text)."""
    corpus, goal = (Counter(b for t in texts for b in buckets_of(t, top, k)) for texts in ([t for _, t in docs], target))
    s_all, t_all = sum(corpus.values()), sum(goal.values())
    rows = []
    for d, text in docs:
        found = buckets_of(text, top, k)
        weight = sum(math.floor(1000 * math.log((goal[b] + 1) * (s_all + k) / ((corpus[b] + 1) * (t_all + k)))) for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    out = [(*r[:4], i + 1 if i < percent * len(order) // 100 else None) for i, r in enumerate(order)]
    return sorted(out + [(*r[:4], None) for r in rows if r[4] < least], key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = drawn(docs, target)
    assert got(queries.op12_resampling(spark, sf)) == want and sum(r[4] is not None for r in want) > 50


@pytest.mark.parametrize("top", [1, 2, 3, 5])
def test_longer_features_and_cut_texts(spark, edge, clashing, monkeypatch, top):
    """N-grams of several lengths; texts cut into pieces lose none, at any size of a piece."""
    target = spark.createDataFrame([("The quick Brown fox, the river bank",), (None,), ("word word word",)], "text string")
    goal = [r["text"] for r in target.collect()]
    want = drawn([(r["doc_id"], r["text"]) for r in edge.collect()], goal, 50, 3, top, 97)
    for docs in (edge, clashing):
        assert got(resampling.resample(docs, target, 50, 3, top, 97)) == want
    texts = [r["text"] for r in edge.collect()]
    whole = resampling.count_buckets(texts, top, 97)
    monkeypatch.setattr(resampling, "SEGMENT_BYTES", 40)
    monkeypatch.setattr(resampling, "BLOCK_WORDS", 7)
    assert (resampling.count_buckets(texts, top, 97) == whole).all()
    gains = resampling.gains_of(whole, whole[::-1].copy())
    cut = resampling.weigh(texts, top, gains)
    monkeypatch.undo()
    assert all((a == b).all() for a, b in zip(cut, resampling.weigh(texts, top, gains), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=9), min_size=1, max_size=6), st.integers(1, 6))
def test_suffix_array(docs, top):
    """Suffixes in order of their first ids, and what neighbours share, as sorting lists gives them."""
    flat = [x for d in docs for x in d + [0] * (top - 1)] if top > 1 else [x for d in docs for x in d]
    ids = np.array(flat, np.int64)
    n = max(len(ids) - (top - 1), 0)
    if not n:
        return
    order, shared = resampling.suffix_array(ids, top)
    heads = [flat[i : i + top] for i in order]
    assert sorted(order.tolist()) == list(range(n)) and heads == sorted(heads)
    for a, b, m in zip(heads, heads[1:], shared[1:].tolist(), strict=False):
        want = next((k for k in range(top) if a[k] != b[k] or not a[k]), top)
        assert m == want


def test_a_run_is_hashed_once(monkeypatch):
    calls = []
    monkeypatch.setattr(resampling.zlib, "crc32", lambda b: calls.append(b) or len(b))
    resampling.count_buckets(["a b a b a b"] * 50, 2, 10)
    assert sorted(calls) == [b"a", b"a b", b"b", b"b a"]


def test_resampling_edges(spark, edge, empty):
    target = spark.createDataFrame([], "text string")
    rows = resampling.resample(edge, target).collect()
    assert len(rows) == 13 and resampling.resample(empty, edge).count() == 0
    assert got(resampling.resample(edge, target)) == drawn([(r["doc_id"], r["text"]) for r in edge.collect()], [])
    many = spark.createDataFrame([(i % 7, "same words over and over " * 5) for i in range(300)], "doc_id long, text string").repartition(5)
    ranks = sorted((r["rank"], -r["score"]) for r in resampling.resample(many, many, 40).collect() if r["rank"])
    assert [k for k, _ in ranks] == list(range(1, 121)) and ranks == sorted(ranks, key=lambda r: r[1])
    with pytest.raises(ValueError):
        resampling.bucket_counts(edge, 0)


def test_long_text(spark):
    """A text of 30 MB: counted in pieces."""
    text = "ab cd, EF gh. " * 2_200_000
    words_, features, _ = resampling.weigh([text, "ab"], 2, np.ones(97))
    assert words_.tolist() == [8_800_000, 1] and features.tolist() == [17_599_999, 1]


def test_places(spark, edge):
    rows = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)], "k long, at string").repartition(6)
    placed, n = common.places(rows, ["k"], "place")
    assert n == 101 and all(r["place"] == r["k"] and r["at"] == "x" for r in placed.collect())
    placed, n = common.places(rows.limit(0), ["k"], "place")
    assert n == 0 and placed.count() == 0


# --- whitening ---


def test_jacobi():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 20, 64):
        b = rng.normal(size=(n, n + 5)) * np.logspace(0, -5, n)[:, None]
        a = b @ b.T
        values, vectors = whitening.jacobi(a)
        want = np.linalg.eigvalsh(a)[::-1]
        assert np.allclose(values, want, rtol=1e-6, atol=1e-14 * want[0]) and (np.diff(values) <= 0).all()
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13) and np.allclose(a @ vectors, vectors * values, atol=1e-13 * want[0])
    assert [v.tolist() for v in whitening.jacobi(np.zeros((0, 0)))] == [[], []]
    assert whitening.jacobi(np.diag([1.0, 3, 2]))[0].tolist() == [3, 2, 1]


def test_small_eigenvalues_are_accurate():
    """A graded matrix, whose small eigenvalues a tridiagonal solver loses: known from exact fractions."""
    a = np.array([[1e20, 1e9, 0], [1e9, 1.0, 1e-9], [0, 1e-9, 1e-16]])
    from fractions import Fraction

    values, _ = whitening.jacobi(a)
    f = [[Fraction(x) for x in row] for row in a.tolist()]
    det = f[0][0] * (f[1][1] * f[2][2] - f[1][2] ** 2) - f[0][1] * (f[0][1] * f[2][2])
    minors = f[0][0] * f[1][1] - f[0][1] ** 2 + f[0][0] * f[2][2] + f[1][1] * f[2][2] - f[1][2] ** 2
    assert abs(values[0] * values[1] * values[2] / float(det) - 1) < 1e-12
    assert abs(values[0] * values[1] / float(minors) - 1) < 1e-12


def dirty(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1 / (j + 1)) for j in range(12)]) for i in range(400)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (None, rows[8][1]), (500, None), (501, [1.0] * 11 + [None]), (502, [math.nan] + [0.0] * 11), (503, [0.0] * 11 + [math.inf]), (504, [-math.inf] * 12)]
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], "vec_id long, embedding array<float>, x string, sums string").repartition(5)


def brute(rows):
    """(n, deviation of each, matrix of whitened components, explained) by numpy, exact where whole numbers are."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in rows]
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, deviation, centred @ vectors[:, :8] / np.sqrt(values[:8]), values[:8] / values.sum()


def compare(found, ids, vectors):
    n, deviation, whitened, explained = brute(vectors)
    by = {}
    for r in found:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, min(8, len(vectors[0])) + 1)) and len({r["identity_error"] for r in found}) == 1 and 0 <= found[0]["identity_error"] < 1e-9
    for c, rows in by.items():
        assert len(rows) == n and all(r["n"] == n and abs(r["explained"] / explained[c - 1] - 1) < 1e-9 for r in rows)
        want = sorted(zip(map(str, ids), deviation, strict=True))
        assert sorted((str(r["vec_id"]), int(r["deviation"])) for r in rows) == want
        own = {(str(r["vec_id"]), int(r["deviation"])): r["whitened"] for r in rows}
        sign = 1 if sum(own[str(i), d] * w for i, d, w in zip(ids, deviation, whitened[:, c - 1], strict=True)) > 0 else -1
        assert all(abs(own[str(i), d] - sign * w) < 1e-7 for i, d, w in zip(ids, deviation, whitened[:, c - 1], strict=True))


def test_whitening_of_dirty_rows(spark):
    rows = dirty(spark)
    kept = [r for r in rows.collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    assert len(kept) == 403
    compare(whitening.whiten(rows).collect(), [r["vec_id"] for r in kept], [r["embedding"] for r in kept])


def test_whitening_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    kept = [r for r in rows if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    out = queries.op13_whitening(spark, sf)
    assert dict(out.dtypes)["deviation"] == "bigint"
    compare(out.collect(), [r["vec_id"] for r in kept], [r["embedding"] for r in kept])


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    flat = [(1, [1.0, 5.0, 2.0]), (2, [2.0, 5.0, 4.0]), (3, [4.0, 5.0, 8.0]), (4, [-1.0, 5.0, 0.5])]
    out = whitening.whiten(spark.createDataFrame(flat, schema)).collect()
    assert {r["component"] for r in out} == {1, 2} and all(abs(sum(r["whitened"] for r in out if r["component"] == c)) < 1e-9 for c in (1, 2))
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [3e30]), (2, [1.0])]):
        with pytest.raises(Exception, match="several lengths|too large"):
            whitening.whiten(spark.createDataFrame(bad, schema)).collect()


def test_deviations_beyond_a_long():
    x = np.array([[2**40, 5], [0, 7]], np.int64)
    s = [2**40, 12]
    assert whitening.deviations(x, 2, s) == [2**80 + 4, 2**80 + 4]
    assert whitening.deviations(x // 2**20, 2, [2**20, 12]) == [2**40 + 144, 2**40 + 144]
