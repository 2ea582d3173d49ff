"""Distinct counts by sketches against sets, and the decisions that rest on them."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile as P
from tidemark.operators import sketches
from tidemark.operators.issues import ROW_ID

COLUMNS = {"id": 30_000, "few": 7, "sixty": 60, "sixtyone": 61, "one": 1, "none": 0, "halves": 15_000, "blank": 2}


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    return spark.range(30_000, numPartitions=5).select(
        i.alias(ROW_ID), i.cast("string").alias("id"), (i % 7).alias("few"), F.concat(F.lit("v"), i % 60).alias("sixty"), F.when(i % 3 > 0, i % 61).alias("sixtyone"),
        F.lit("x").alias("one"), F.lit(None).cast("string").alias("none"), (i % 15_000).alias("halves"), F.when(i % 2 == 0, "").otherwise("a").alias("blank"),
    )


def test_estimates_and_bounds(table):
    for r in sketches.counts(sketches.sketches(table)).collect():
        want = COLUMNS[r["column"]]
        assert r["low"] <= want <= r["high"] and abs(r["estimate"] - want) <= want * sketches.ERROR and r["rows"] == 30_000
    assert sketches.exact(table, list(COLUMNS)) == COLUMNS == P.distinct_counts(table)


def test_sketches_of_parts_merge(spark, table, tmp_path):
    """Sketches of parts, also from runs that were written at different times, say what one of the whole says."""
    path = str(tmp_path / "sketches")
    for k in range(3):
        sketches.append(sketches.sketches(table.filter(F.col(ROW_ID) % 3 == k)), path, f"run {k}")
    merged = {r["column"]: r for r in sketches.counts(sketches.read(spark, path)).collect()}
    whole = {r["column"]: r for r in sketches.counts(sketches.sketches(table)).collect()}
    for c, r in whole.items():
        assert (merged[c]["rows"], merged[c]["known"]) == (r["rows"], r["known"]) and abs(merged[c]["estimate"] - r["estimate"]) <= 2 * sketches.ERROR * r["estimate"]
        assert merged[c]["low"] <= COLUMNS[c] <= merged[c]["high"]


@pytest.mark.parametrize(("at_most", "share"), [(60, None), (1, None), (0, None), (None, 0.5), (29_999, None), (7, 0.001)])
def test_decisions_are_those_of_exact_counts(table, at_most, share):
    found = sketches.distinct(table, list(COLUMNS), at_most, share)
    known = {r["column"]: r["known"] for r in sketches.sketches(table).collect()}
    for c, n in COLUMNS.items():
        if at_most is not None:
            assert (found[c] <= at_most) == (n <= at_most), c
        if share is not None:
            assert (found[c] <= share * known[c]) == (n <= share * known[c]), c


def test_only_open_columns_are_counted(table, monkeypatch):
    asked = []
    exact = sketches.exact
    monkeypatch.setattr(sketches, "exact", lambda df, names: asked.extend(names) or exact(df, names))
    sketches.distinct(table, list(COLUMNS), at_most=60)
    assert set(asked) <= {"sixty", "sixtyone"} and asked
    assert P.few_valued(table, {c: F.col(c) for c in COLUMNS}, 60)[:3] == ["few", "sixty", "sixtyone"] and "id" not in P.few_valued(table, {"id": F.col("id")}, 60)


def test_rates_and_warnings(spark, table):
    r = P.rates(table)
    assert r["none"] == {"missing_rate": 1.0, "unique_rate": 0.0, "top_freq": 0.0} and r["one"]["top_freq"] == 1.0 and r["id"]["unique_rate"] == 1.0
    assert abs(r["sixtyone"]["missing_rate"] - 1 / 3) < 1e-9 and r["blank"]["top_freq"] == 0.5
    assert P.rates(table.limit(0))["id"] == {"missing_rate": 0.0, "unique_rate": 0.0, "top_freq": 0.0}
    assert P.input_warnings(table) == ["empty columns: none", "constant columns: one"]
    assert P.input_warnings(table.limit(0))[0] == "only 0 rows"


def test_no_columns(table):
    only = table.select(ROW_ID)
    assert sketches.sketches(only).count() == 0 and sketches.distinct(only, []) == {}


def test_values_are_computed_before_they_are_aggregated(spark, monkeypatch):
    """Aggregates get columns of a projection, not the expressions, which they would compute anew at each place."""
    seen = []
    measure = P.measure
    monkeypatch.setattr(P, "measure", lambda df, wanted: seen.append(df.columns) or measure(df, wanted))
    value = (F.col("id") % 7).cast("double")
    df = spark.range(30)
    assert P.few_valued(df, {"a": value}, 60) == ["a"] and P.quantiles_of(df, {"a": value}, [0.5]) == {"a": [3.0]}
    assert seen == [["x0"]] * 3
