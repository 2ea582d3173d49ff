"""Nearest neighbours against comparing all rows, with any values missing; and how many comparisons that took."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import neighbours
from tidemark.operators.issues import ROW_ID

SCHEMA = f"{ROW_ID} long, t double, f array<double>"


def distance(a, b):
    both = [abs(x - y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
    return sum(both) / len(both) if both else math.inf


def brute(rows, k):
    have = [r for r in rows if r[1] is not None]
    out = {}
    for i, t, f in rows:
        if t is None:
            near = sorted((d, j, u) for j, u, g in have if (d := distance(f, g)) < math.inf)[:k]
            out[i] = [(j, u) for _, j, u in near]
    return out


def found(df, features, k, **more):
    return {r[ROW_ID]: [(b["id"], b["t"]) for b in r["best"]] for r in neighbours.nearest(df, features, k, **more).collect()}


def made(n, features, missing, seed, gaps=0.1, grid=None):
    rng = random.Random(seed)
    value = (lambda j: float(rng.randint(0, grid))) if grid else (lambda j: rng.gauss(0, 1) * 3**j)
    return [(i, None if rng.random() < gaps else rng.random(), [None if rng.random() < missing else value(j) for j in range(features)]) for i in range(n)]


@pytest.mark.parametrize(("n", "features", "missing", "grid", "k"), [(600, 3, 0.3, None, 5), (600, 1, 0.0, 4, 3), (500, 4, 0.9, 2, 5), (400, 2, 0.3, 1, 7)])
def test_against_all_pairs(spark, monkeypatch, n, features, missing, grid, k):
    """Blocks of few rows, so that boxes decide; ties in number; rows without any feature."""
    monkeypatch.setattr(neighbours, "BLOCK", 25)
    monkeypatch.setattr(neighbours, "ROWS", 30)
    rows = made(n, features, missing, n + k, grid=grid)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), features, k) == brute(rows, k)


def test_comparisons_grow_slower_than_pairs(spark):
    """A tenth of rows lack the target, three in ten of each feature: fourfold rows take far less than sixteenfold comparisons."""
    counted = {}
    for n in (4000, 16_000):
        rows = made(n, 3, 0.3, n)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(neighbours, "BLOCK", 100)
            told = []
            got = found(spark.createDataFrame(rows, SCHEMA).repartition(4), 3, 5, tell=lambda _, c: told.append(c))
        counted[n] = sum(told)
        sample = [r for r in rows if r[1] is None][:25]
        want = brute([*(r for r in rows if r[1] is not None), *sample], 5)
        assert {i: got[i] for i in want} == want
        pairs = sum(r[1] is None for r in rows) * sum(r[1] is not None for r in rows)
        assert counted[n] < 0.4 * pairs, (n, counted[n] / pairs)
    assert counted[16_000] < 10 * counted[4000], counted


def test_bounds_are_below_every_distance():
    """Whatever is missing in the row or in the block."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        b = rng.normal(size=(6, 3))
        b[rng.random(b.shape) < 0.4] = np.nan
        q = rng.normal(size=(4, 3)) * 2
        q[rng.random(q.shape) < 0.4] = np.nan
        known = ~np.isnan(b)
        with np.errstate(all="ignore"):
            low, high = (np.array([[g(b[known[:, i], i]) if known[:, i].any() else np.nan for i in range(3)]]) for g in (np.min, np.max))
        box = neighbours.Boxes(np.array([0]), np.array([6]), low, high, known.any(axis=0)[None], known.all(axis=0)[None])
        bound = box.bounds(q)[:, 0]
        for i, row in enumerate(q.tolist()):
            near = min(distance([None if math.isnan(v) else v for v in row], [None if math.isnan(v) else v for v in g]) for g in b.tolist())
            assert bound[i] <= near + 1e-12 and (near < math.inf or bound[i] == math.inf or known.any())


def test_a_tree_parts_all_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    x[rng.random(x.shape) < 0.3] = np.nan
    tree = neighbours.grow(x, 32)
    counts = np.bincount(tree.blocks_of(x), minlength=32)
    assert len(counts) == 32 and counts.min() > 0 and counts.max() < 500
    same = neighbours.grow(np.ones((100, 2)), 8)
    assert set(same.blocks_of(np.ones((100, 2)))) == {0}


def test_large_blocks_are_dealt_into_shares(spark, monkeypatch):
    """Rows alike in all features can't be parted: they are shared out, and ties still go to the lowest ids."""
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    monkeypatch.setattr(neighbours, "ROWS", 7)
    rows = [(i, None if i % 4 == 0 else float(i), [1.0, None]) for i in range(200)]
    assert found(spark.createDataFrame(rows, SCHEMA), 2, 3) == brute(rows, 3)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, [1.0]), (2, None, [None])], SCHEMA)
    assert found(df, 1, 3) == {1: [], 2: []}
    assert found(df.limit(0), 1, 3) == {}
    assert found(df.withColumn("t", F.lit(1.0)), 1, 3) == {}
    rows = [(1, None, [1.0]), (2, None, [None]), (3, 5.0, [None]), (4, 6.0, [9.0])]
    assert found(spark.createDataFrame(rows, SCHEMA), 1, 3) == {1: [(4, 6.0)], 2: []}
