"""The join against brute force over all pairs."""

import random

import numpy as np
import pytest

from tidemark.llm import jaccard as J

from .conftest import rows_of


def shingles(text, width):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, t):
    """doc_id, n_shingles, component_id of every row."""
    sets = [shingles(text, width) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and t.whole * shared >= t.part * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, s in enumerate(sets):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], len(s), least[find(i)] if s else rows[i][0]) for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    shared = rng.choices(words, k=60)
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([5, 12, 30, 80, 200, 500]))
        if rng.random() < 0.5:
            base = base + shared
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy[: rng.randint(int(len(copy) * 0.85), len(copy))])
    rng.shuffle(texts)
    return [(i * 3, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "width", "t"), [(1, 3, J.Threshold(90, 100)), (2, 5, J.Threshold(80, 100)), (3, 1, J.Threshold(60, 100))])
def test_against_brute_force(spark, seed, width, t):
    rows = corpus(seed)
    found = J.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width, t)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(((a, b, c) for a, b, c in brute(rows, width, t)), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_large_group_in_blocks(spark, monkeypatch):
    """Near copies far apart from the first, with blocks of two nodes and components over rounds."""
    monkeypatch.setattr(J, "BLOCK", 2)
    monkeypatch.setattr(J, "LOCAL_LINKS", 0)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(12):
        base = list(base)
        base[5 * i] = f"x{i}"
        rows.append((i, " ".join(base)))
    found = J.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), 1, J.Threshold(90, 100))
    assert {r["component_id"] for r in found.collect()} == {0}


def test_edges(edge, clashing, empty):
    t = J.Threshold(90, 100)
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    want = sorted(brute(rows, 3, t), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert rows_of(J.join_documents(edge, 3, t), "doc_id", "n_shingles", "component_id") == want
    assert rows_of(J.join_documents(clashing, 3, t), "doc_id", "n_shingles", "component_id") == want
    assert J.join_documents(empty, 3, t).count() == 0


def test_keep_one(edge, clashing, empty):
    kept = J.keep_one(edge)
    assert rows_of(kept, "doc_id") == sorted([(None,), (1,), (3,), (4,), (5,), (6,), (7,), (8,), (9,), (9,)], key=lambda r: (r[0] is not None, str(r[0])))
    assert kept.columns == edge.columns and J.keep_one(clashing).columns == clashing.columns
    assert J.keep_one(clashing).count() == 10 and J.keep_one(empty).count() == 0


def test_bands_cover_every_pair():
    for t in (J.Threshold(90, 100), J.Threshold(80, 100), J.Threshold(1, 2)):
        bands = J.bands_upto(t, 5000)
        assert [b.low for b in bands[1:]] == [b.high + 1 for b in bands[:-1]]
        assert all(b.parts >= t.difference(b.high) + b.slack for b in bands if b.parts)


def test_bound_never_undercounts():
    rng = np.random.default_rng(1)
    t = J.Threshold(90, 100)
    for _ in range(200):
        a = np.unique(rng.integers(0, 400, 300).astype(np.uint64) * np.uint64(7919))
        b = np.unique(np.concatenate([a[: rng.integers(150, len(a))], rng.integers(10**6, 10**7, 10).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        assert J.shared_count(a, b) == shared
        maps = [J.bitmap(x) for x in (a, b)]
        bits = [J.folded([m], min(map(len, maps))) for m in maps]
        assert all((J.folded([J.bitmap(x)], 32) == np.bitwise_or.reduce(np.frombuffer(J.bitmap(x), np.uint64).reshape(-1, 4))).all() for x in (a, b))
        if t.linked(len(a), len(b), shared):
            assert J.bound(np.array([len(a)]), np.array([len(b)]), *bits, t)[0]


def test_equal_sets_of_different_texts(spark):
    """Texts that differ in case or spaces are one node: whichever of them gives the set, no link is lost."""
    words = [f"w{i}" for i in range(40)]
    near = " ".join([*words, "tail"])
    rows = [(5, " ".join(words).upper()), (4, "  ".join(words)), (3, near), (2, near.upper()), (9, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(J.join_documents(docs), "doc_id", "component_id") == [(2, 2), (3, 2), (4, 2), (5, 2), (9, 9)]
    assert rows_of(J.keep_one(docs), "doc_id") == [(2,), (9,)]
