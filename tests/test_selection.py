"""Heads of columns, medians of groups: what they give, against plain Python, and what they move."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import groups, heads
from tidemark.operators import issues as I

ID = I.ROW_ID


def cells_of(rows, names, n):
    """The first n known values of each column by row id."""
    out = {}
    for c in names:
        known = sorted((r[ID], r[c]) for r in rows if r[c] is not None)
        out[c] = [(str(v), i + 1) for i, (_, v) in enumerate(known[:n])]
    return out


def found(df, names, n):
    out = {c: [] for c in names}
    for r in heads.first_known(df, names, n).collect():
        out[r["column"]].append((r["value"], r["place"]))
    return {c: sorted(v, key=lambda x: x[1]) for c, v in out.items()}


@pytest.fixture(scope="module")
def table(spark):
    """Columns of all, few, late and no known values."""
    rows = [(i, f"v{i}", i if i % 3 == 0 else None, "late" + str(i) if i > 900 else None, None) for i in range(1000)]
    return spark.createDataFrame(rows, f"{ID} long, all string, some long, late string, none string")


NAMES = ["all", "some", "late", "none"]


@pytest.mark.parametrize("n", [7, 400])
def test_first_known(spark, table, n, tmp_path):
    rows = table.collect()
    want = cells_of(rows, NAMES, n)
    path = str(tmp_path / "t")
    table.repartitionByRange(40, ID).sortWithinPartitions(ID).write.parquet(path)
    ordered = spark.read.parquet(path)
    for df in (table, ordered, table.repartition(9, "all"), table.orderBy(F.desc(ID))):
        assert found(df, NAMES, n) == want


def test_ordered_frames_move_only_the_head(spark, table):
    """Of ascending row ids at most 2 * n cells of a column are looked at further, and nothing is dealt before that."""
    df = table.repartitionByRange(40, ID).sortWithinPartitions(ID).cache()
    assert all(ascends for *_, ascends in heads.spans(df)) and len(heads.spans(df)) > 30
    counts = {r["column"]: r["count"] for r in heads.cells(df, NAMES[:3], 20).groupBy("column").count().collect()}
    assert all(20 <= n < 40 for n in counts.values()) and len(counts) == 3
    assert "Exchange" not in heads.cells(table, NAMES[:3], 20)._jdf.queryExecution().executedPlan().toString()
    limits = heads.bounds(df, NAMES, 20)
    assert limits["none"] is None and limits["all"] < 100 and limits["late"] > 900
    df.unpersist()


def test_partitions_are_left_when_enough_is_known(spark):
    """Of many rows only the first batches are read: the reader is asked for no more."""
    asked = spark.sparkContext.accumulator(0)
    df = spark.range(200_000, numPartitions=2).select(F.col("id").alias(ID), F.lit("x").alias("c"))
    run = heads._leading({0, 100_000}, 1, 5)

    def counting(batches):
        def tell():
            for b in batches:
                asked.add(1)
                yield b

        return run(tell())

    rows = heads._flags(df, ["c"]).mapInArrow(counting, heads._FOUND).collect()
    assert [r["found"] for r in rows] == [[5], [5]] and asked.value == 2


def test_a_frame_dealt_anew_between_jobs(table, monkeypatch):
    """Partitions that are not found again make no wrong bound."""
    spans = heads.spans
    monkeypatch.setattr(heads, "spans", lambda df: [(a + 1, b, s) for a, b, s in spans(df)])
    assert found(table, NAMES, 7) == cells_of(table.collect(), NAMES, 7)


def test_no_rows_and_no_columns(table):
    assert heads.first_known(table.limit(0), NAMES, 5).count() == 0 and heads.first_known(table, [], 5).count() == 0


# --- medians of groups


def plain(rows, key):
    by = {}
    for r in rows:
        by.setdefault(key(r), []).append(r)
    return {k: (len(v), *[statistics.median(x) if (x := [r[c] for r in v if r[c] is not None]) else None for c in ("x", "y")]) for k, v in by.items()}


def medians(df):
    out = {}
    for r in groups.medians(df, [F.col("k"), F.col("j")], {"x": F.col("x"), "y": F.col("y")}).collect():
        assert (r["__key0"], r["__key1"]) not in out
        out[r["__key0"], r["__key1"]] = (r["__size"], r["__med_x"], r["__med_y"])
    return out


@pytest.fixture(scope="module")
def skewed(spark):
    """One group of most rows; groups of one row, of nulls, of one value, of two far apart; null keys."""
    rng = random.Random(4)
    rows = [("hot", 1, rng.gauss(0, 1), float(rng.randint(0, 9))) for _ in range(6000)]
    rows += [("cool", i % 3, rng.random() * 10 ** rng.randint(-9, 9), None) for i in range(900)]
    rows += [(None, None, float(i), -float(i)) for i in range(31)] + [(None, 1, 5.0, None), ("one", None, 1.5, 2.5), ("null", 0, None, None)]
    rows += [("same", 0, 7.25, 7.25)] * 501 + [("two", 0, float(-(10**300)) if i % 2 else 1e300, float("inf") if i % 2 else -1.0) for i in range(400)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, j int, x double, y double").repartition(6)


@pytest.mark.parametrize(("cuts", "listed"), [(200, 20_000), (20, 100)])
def test_medians(skewed, monkeypatch, cuts, listed):
    """At any number of cuts and listed values, so with no, one and many rounds."""
    monkeypatch.setattr(groups, "CUTS", cuts)
    monkeypatch.setattr(groups, "LISTED", listed)
    assert medians(skewed) == plain(skewed.collect(), lambda r: (r["k"], r["j"]))


def test_a_sketch_that_is_far_out(skewed, monkeypatch):
    monkeypatch.setattr(groups, "LISTED", 1000)
    monkeypatch.setattr(groups, "ACCURACY", 8)
    monkeypatch.setattr(groups, "SLACK", 1)
    assert medians(skewed) == plain(skewed.collect(), lambda r: (r["k"], r["j"]))


def test_no_more_than_the_listed_values_meet(skewed, monkeypatch):
    """What a round lists of a group stays within the bound, also for the group of most rows."""
    monkeypatch.setattr(groups, "LISTED", 400)
    sizes = []
    measures = groups._measures
    monkeypatch.setattr(groups, "_measures", lambda x, s: sizes.append(1) or F.transform(F.array(measures(x, s)), lambda m: F.when(F.size(m["values"]) <= 400, m).otherwise(F.raise_error(F.lit("too many")).cast("void")))[0])
    assert medians(skewed) == plain(skewed.collect(), lambda r: (r["k"], r["j"])) and sizes


def test_median_edges(skewed):
    assert medians(skewed.limit(0)) == {}
    with pytest.raises(ValueError):
        groups.medians(skewed, [], {"x": F.col("x")})
