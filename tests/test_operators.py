"""Operators on small dirty frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import export, impute, neighbours, names, patterns, quality, relations, scorecard, semantics, structure
from tidemark.operators import issues as I
from tidemark.functions import text as X
from tidemark.operators import profile as P
from tidemark.sources.stores import LearningMemory, QualityHistory, SemanticHistory


def frame(spark, rows, schema):
    return I.with_row_id(spark.createDataFrame(rows, schema).coalesce(1))


def texts(issues):
    return sorted((r["row"], r["column"], r["issue"]) for r in issues.collect())


def test_names(spark):
    assert [names.normalize(x) for x in ("E-Mail", " Unit  Price ", None, "Größe!", "A__b")] == ["e_mail", "unit_price", "", "gre", "a_b"]
    df = spark.createDataFrame([("a", None, 1), (None, "b", 2)], "`E-Mail` string, `user email` string, Cost int")
    out, report = names.apply(df)
    assert out.columns == ["email", "price"] and [r[0] for r in out.collect()] == ["a", "b"] and report["merged"] == ["email"]
    assert names.plan(["foo"], advised={"foo": {"alias": "Bar", "confidence": 0.9}}) == ["bar"]
    assert names.plan(["foo"], advised={"foo": {"alias": "Bar", "confidence": 0.7}}) == ["foo"]
    both, missing = names.union_by_name({"x": spark.createDataFrame([(1,)], "b int"), "y": spark.createDataFrame([("u", 2)], "b string, a int")})
    assert both.columns == ["a", "b"] and dict(both.dtypes)["b"] == "string" and missing["missing"] == {"x": ["a"], "y": []}
    assert names.align(out, ["price"]).columns == ["price", "email"]


def test_profile(spark):
    df = frame(spark, [(float(i), "x" if i % 3 else None) for i in range(9)] + [(1000.0, "y")], "v double, s string")
    v, s = P.profile(df)
    assert (v.missing, v.unique, v.outliers, v.max) == (0, 10, 1, 1000.0)
    assert (s.missing, s.unique, s.top) == (3, 2, [("x", 6), ("y", 1)])
    assert P.mode_of(frame(spark, [("b",), ("a",), (None,)], "s string"), ["s"]) == {"s": "a"}
    assert "only 2 rows" in P.input_warnings(frame(spark, [(1, None), (1, None)], "a int, b string"))
    assert P.drift(df, {"s": {"missing_rate": 0.0, "unique_rate": 0.2}})["s"]["level"] == "high"
    empty = df.limit(0)
    assert [p.rows for p in P.profile(empty)] == [0, 0]
    assert P.nan_to_null(spark.createDataFrame([(float("nan"),)], "v double")).first()[0] is None
    summary = P.dataset_summary(df)
    assert summary[0]["mostly_numeric"] and not summary[1]["mostly_numeric"]
    assert set(P.intelligence(df)) == {"v", "s"}


@pytest.mark.parametrize("most", [20_000, 300, 5])
def test_quantiles_are_exact(spark, monkeypatch, most):
    """Against numpy, with ties and nulls, sorted at once, in one round, and (few sorted values, few cuts) in several."""
    import numpy as np

    monkeypatch.setattr(P, "SORTED", most)
    if most == 5:
        monkeypatch.setattr(P, "CUTS", 20)
    rng = np.random.default_rng(7)
    data = {"a": rng.normal(size=997), "b": np.repeat([1.0, 2.0], [500, 497]), "c": np.full(997, 3.0), "d": np.floor(rng.exponential(2, 997)), "e": np.arange(997.0)}
    df = spark.createDataFrame([(*(float(v[i]) for v in data.values()), None) for i in range(997)] + [(None,) * 6], "a double, b double, c double, d double, e double, f double")
    points = [0.0, 0.01, 0.25, 0.5013, 0.99, 1.0]
    found = P.quantiles_of(df, {c: F.col(c) for c in df.columns}, points)
    for c, v in data.items():
        assert found[c] == pytest.approx(np.quantile(v, points).tolist())
    assert found["f"] is None and P.quantiles_of(df.limit(0), {"a": F.col("a")}, points) == {"a": None} and P.quantiles_of(df, {}, points) == {}


def test_custom_pattern_that_java_refuses(spark):
    """Python's named groups are no expression for Spark: such a pattern is left out, and the built-in rules stay."""
    df = frame(spark, [("a@b.org",), ("a@b.org",), ("ab",)], "email string")
    found = I.find(df, patterns.rules(df, {"email": {"regex": r"(?P<user>\w+)@.*"}}))
    assert {r["issue"] for r in found.collect()} >= {"email pattern: invalid @ count"}


def test_city_fill_and_null_tokens(spark):
    df = frame(spark, [("Rome",), ("Rome",), ("Oslo",), ("unknown",), (None,)], "city string")
    config = quality.Config(fill_city=True, required_ids=(), null_inflation=1e9)
    out, _ = quality.apply(df, quality.fit(df, config), config)
    assert [r["city"] for r in out.orderBy(I.ROW_ID).collect()][:4] == ["Rome", "Rome", "Oslo", "Rome"]
    assert [r[0] for r in df.select(X.is_null_token(F.col("city"))).collect()] == [False, False, False, True, True]


def test_fixes_and_limits(spark):
    df = spark.createDataFrame([(" AbC ", "http://x")], "a string, b string")
    got = df.select(patterns.fix_text(F.col("a"), "lowercase"), patterns.fix_text(F.col("b"), "replace_prefix", "https://", "http://"), patterns.fix_text(F.col("b"), "prepend", "http://")).first()
    assert tuple(got) == ("abc", "https://x", "http://x")
    forced = names.force_schema(df, {"b": "string", "c": "int"})
    assert forced.columns == ["a", "b", "c"] and forced.first()["c"] is None


def test_structure(spark):
    rows = [(f"N{i}", float(i) if i % 4 else None, f"2024-01-{i % 28 + 1:02d}", " Ann " if i % 2 else None) for i in range(40)]
    df = frame(spark, rows, "code string, v double, on string, who string")
    plan = structure.fit(df, structure.Config(id_words=[]))
    assert plan.roles == {"code": "id", "v": "numeric", "on": "id", "who": "categorical"}
    config = structure.Config(protect_ids=False, rounding=1)
    plan = structure.load(structure.save(structure.fit(df, config)))
    assert plan.roles["on"] == "datetime"
    out, _ = structure.apply(df, plan, config)
    row = out.orderBy(I.ROW_ID).first()
    assert row["v"] == plan.medians["v"] and row["who"] == " Ann " and row["on"] == dt.datetime(2024, 1, 1)
    assert out.columns == df.columns and out.count() == 40
    told = structure.report(df, plan, config)
    assert told["missing"]["v"]["count"] == 10 and told["missing"]["v"]["strategy"] == "median"
    with pytest.raises(ValueError, match="unseen"):
        structure.apply(df.withColumn("new", F.lit(1)), plan, structure.Config(allow_unseen=False))
    kept, warned = structure.before_cutoff(df, structure.Config(date_column="on", cutoff="2024-01-03"))
    assert kept.count() == 6 and not warned
    assert structure.before_cutoff(df, structure.Config(date_column="no", cutoff="2024-01-03"))[1]
    with pytest.raises(ValueError):
        structure.Config(outlier_factor=0)


def test_quality(spark):
    rows = [("1,200" if i % 2 else "₹ 300", "yes" if i % 2 else "no", "red" if i % 3 else "blue") for i in range(30)]
    df = frame(spark, rows, "amount string, is_new string, colour string")
    config = quality.Config(gating=False, required_ids=())
    plan = quality.fit(df, config)
    assert plan.vocabularies["colour"] == ["blue", "red"]
    out, report = quality.apply(df, plan, config)
    assert report["roles"]["amount"] == "money" and {r["amount"] for r in out.collect()} == {1200.0, 300.0}
    assert {r["is_new"] for r in out.collect()} == {0.0, 1.0}
    gated, report = quality.apply(df, plan, quality.Config(required_ids=()))
    assert {r["amount"] for r in gated.collect()} == {"1,200", "₹ 300"}
    assert any(v["rule"] == "low_confidence_skip" for v in report["violations"])
    typo = frame(spark, [("rde",), ("red",), ("zzzz",), ("red",), ("blue",), ("blue",), ("red",), ("red",)], "colour string")
    fixed, changed = quality.repair_categories(typo, {"colour": ["blue", "red"]})
    assert [r[0] for r in fixed.orderBy(I.ROW_ID).select("colour").collect()] == ["red", "red", None, "red", "blue", "blue", "red", "red"] and changed == ["colour"]
    assert quality.inflation(0, 1, 0.25) == (False, 1.0) and quality.inflation(8, 10, 0.25)[0]
    with pytest.raises(ValueError):
        quality.apply(df, plan, quality.Config(strict=True, required_ids=("order_id",)))
    mixed = frame(spark, [("5",), ("x",), ("7",), ("8",)], "age string")
    reverted, report = quality.apply(mixed, quality.fit(mixed, config), config)
    assert reverted.columns == ["age", I.ROW_ID] and reverted.count() == 4


def test_memory_and_history(tmp_path):
    m = LearningMemory(str(tmp_path / "m.json"))
    for _ in range(5):
        m.record("C", "money", 0.5, False)
    m.save()
    assert LearningMemory(str(tmp_path / "m.json")).penalty("c", "money") == 0.25
    assert LearningMemory(rule="long").penalty("c", "money") == 0.0
    h = SemanticHistory(str(tmp_path / "h.json"))
    for _ in range(2):
        h.update("Age", "AGE", 0.9, [])
    h.save()
    ranked, meta = SemanticHistory(str(tmp_path / "h.json")).boost("age", [{"type": "TEXT", "confidence": 0.6}])
    assert ranked[0] == {"type": "AGE", "confidence": 0.98} and not meta["stale"]
    q = QualityHistory(str(tmp_path / "q.json"))
    q.add("f", 90.0)
    assert QualityHistory(str(tmp_path / "q.json")).add("f", 92.5)["delta_score"] == 2.5
    (tmp_path / "bad.json").write_text("{")
    assert QualityHistory(str(tmp_path / "bad.json")).runs == []


def test_semantics(spark):
    rows = [(float(i) if i else -1.0, 1990.0 + i % 20, "a" if i % 2 else "b", "2024-01-05") for i in range(50)]
    df = frame(spark, rows, "age double, year double, kind string, day string")
    decided = semantics.decide(df)
    assert [decided[c]["type"] for c in ("age", "year", "kind", "day")] == ["AGE", "YEAR", "CATEGORY", "DATE"]
    out, found, report = semantics.apply(df)
    assert texts(found) == [(0, "age", "below minimum")]
    assert out.filter("age is null").count() == 1 and not report["reverted"]
    many = frame(spark, [(-1.0,), (-2.0,), (3.0,)], "age double")
    out, _, report = semantics.apply(many)
    assert report["reverted"] == ["age"] and out.filter("age is null").count() == 0
    assert semantics.rank("x", None) == [{"type": "TEXT", "confidence": 1.0}]
    assert semantics.junk_name("Unnamed: 3") and not semantics.junk_name("name")


def test_relations(spark):
    assert relations.date_pairs(["trip_start_date", "trip_end_date"])[0][2] == "high"
    assert relations.date_pairs(["start_date", "end_date"]) == [] and relations.date_pairs(["order_date", "return_date"]) == []
    assert relations.bound_pairs(["price_min", "price_max"]) == [("price_min", "price_max", "medium", 0.92)]
    rows = [(5.0, 1.0, 140.0, "x@y", "12", None), (1.0, 5.0, 50.0, "a@b.c", "12345678", "k")]
    df = frame(spark, rows, "price_min double, price_max double, tax_percent double, email string, phone string, order_id string")
    out, found, report = relations.apply(df)
    assert texts(found.filter("row is not null")) == [(0, "email", "invalid email format"), (0, "phone", "phone length suspicious"), (0, "price_max", "price_min is greater than price_max"), (0, "tax_percent", "percentage out of range")]
    assert [r["issue"] for r in found.filter("row is null").collect()] == ["high null rate for primary key"]
    assert [(r["price_min"], r["price_max"], r["tax_percent"]) for r in out.orderBy(I.ROW_ID).collect()] == [(1.0, 5.0, 100.0), (1.0, 5.0, 50.0)]
    dates = frame(spark, [("05/01/2024", "04/01/2024"), ("05/01/2024", "06/01/2024"), (None, None)] + [("05/01/2024", "05/01/2024")] * 9, "trip_start_date string, trip_end_date string")
    assert texts(I.find(dates, relations.rules(dates)[0])) == [(0, "trip_end_date", "trip_end_date is before trip_start_date")]
    assert texts(I.find(dates, relations.rules(dates, tolerance_days=1)[0])) == []
    swapped = relations.swap(frame(spark, [(3.0, 2.0, 1.0)], "a double, b double, c double"), [("a", "b"), ("b", "c")])
    assert tuple(swapped.first())[:3] == (2.0, 1.0, 3.0)


def test_patterns(spark):
    rows = [("a@b.co", "x.org", "12345"), ("ab.co", "https://y.org", "12345"), ("c@d.co", None, "123"), ("e@f.co", "HTTP://z", "12345")]
    df = frame(spark, rows, "email string, url string, zip string")
    out, found, _ = patterns.apply(df, fix=True)
    assert texts(found) == [(0, "url", "url pattern: missing scheme"), (1, "email", "email pattern: invalid @ count"), (1, "email", "email pattern: invalid format"), (1, "email", "email pattern: missing domain"), (2, "zip", "zip_us pattern: invalid format")]
    assert [r["url"] for r in out.orderBy(I.ROW_ID).collect()] == ["https://x.org", "https://y.org", None, "HTTP://z"]
    assert [patterns.kind_of(x) for x in ("shipping", "user_name", "full_name", "city")] == ["postal", "username", "name", "category"]
    custom = frame(spark, [("A1",), ("B2",), ("zz",), ("C3",)], "code string")
    assert texts(I.find(custom, patterns.rules(custom, {"code": {"regex": r"[A-Z]\d", "pattern_name": "code"}}))) == [(2, "code", "code pattern: invalid format")]
    assert I.find(custom, patterns.rules(custom, {"code": {"regex": "(", "pattern_name": "x"}})).count() == 0


def test_rare_lengths_are_all_found(spark):
    """More rare lengths than are counted by name: each is an issue, and the share is of all rows."""
    rows = [("1234567890",)] * 900 + [("7" * n,) for n in range(11, 161)]
    df = frame(spark, rows, "phone string")
    found = [r for r in I.find(df, patterns.rules(df)).collect() if r["issue"] == "phone pattern: rare length"]
    assert len(found) == 150 and {r["details"]["top_ratio"] for r in found} == {str(900 / 1050)}


def test_impute(spark):
    rows = [("a" if i % 2 else "b", float(i), float(i) if i % 5 else None, None if i % 3 else 1.0) for i in range(60)]
    df = frame(spark, rows, "g string, x double, v double, s double")
    out, found, report = impute.apply(df)
    assert report["groups"] == ["g"] and report["skipped_sparse"] == ["s"]
    assert out.filter("v is null").count() == 0 and out.columns == df.columns and out.count() == 60
    kinds = {r["issue"]: r["count"] for r in found.groupBy("issue").count().collect()}
    assert kinds == {"too sparse to safely impute": 1, "filled missing value using group median": 12}
    lone = frame(spark, [(float(i), float(i) if i != 5 else None) for i in range(9)], "x double, v double")
    out, found, _ = impute.apply(lone, impute.Config(k=2))
    assert out.filter("x = 5").first()["v"] == 5.0 and found.first()["issue"].startswith("filled missing value using kNN")
    only = frame(spark, [(1.0,), (3.0,), (None,)], "v double")
    out, found, _ = impute.apply(only)
    assert out.filter(f"{I.ROW_ID} = 2").first()["v"] == 2.0
    assert impute.apply(only, impute.Config(enabled=False))[2] == {"enabled": False}


def test_nearest_in_blocks(spark, monkeypatch):
    rows = [(float(i * 7 % 50), float(i) if i % 4 else None) for i in range(50)]
    df = frame(spark, rows, "x double, v double")
    one = sorted(map(tuple, impute.nearest(df, "v", ["x"], 3).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 5)
    assert sorted(map(tuple, impute.nearest(df, "v", ["x"], 3).collect())) == one
    known = [(i, r) for i, r in enumerate(rows) if r[1] is not None]
    for i, r in enumerate(rows):
        if r[1] is None:
            best = sorted((abs(r[0] - x[0]), j, x[1]) for j, x in known)[:3]
            assert dict(one)[i] == sorted(b[2] for b in best)[1]


def test_nearest_against_brute_force(spark, monkeypatch):
    """Several features with nulls and ties, many blocks and shares: the same as comparing all rows."""
    import random

    rng = random.Random(5)
    rows = [(rng.choice([None, float(rng.randrange(40))]), None if i % 9 == 4 else float(rng.randrange(1000)), float(rng.randrange(3)), None if i % 5 == 0 else float(i)) for i in range(400)]
    rows += [(None, None, None, None), (None, None, 1.0, None)]
    df = frame(spark, rows, "x double, y double, z double, v double")
    known = [(i, r) for i, r in enumerate(rows) if r[3] is not None]

    def apart(a, b):
        both = [abs(p - q) for p, q in zip(a[:3], b[:3], strict=True) if p is not None and q is not None]
        return sum(both) / len(both) if both else None

    want = {}
    for i, r in enumerate(rows):
        if r[3] is None:
            best = sorted(((d, j, x[3]) for j, x in known if (d := apart(r, x)) is not None))[:5]
            values = sorted(b[2] for b in best)
            want[i] = values[len(values) // 2] if values else None
    for block, blocks, chunk in ((10_000, 100, 5_000), (20, 100, 3), (20, 4, 7)):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours, "BLOCKS", blocks)
        monkeypatch.setattr(neighbours, "ROWS", chunk)
        assert dict(map(tuple, impute.nearest(df, "v", ["x", "y", "z"], 5).collect())) == want


def test_impute_seeks_all_rows(spark):
    """More rows than one block holds: each gap is filled from its own neighbours, whatever their hash."""
    n = 12_000
    df = spark.range(n).select(F.col("id").alias(I.ROW_ID), F.col("id").cast("double").alias("x"), F.when(F.col("id") % 1000 != 500, F.col("id").cast("double")).alias("v"))
    out, _, _ = impute.apply(df, impute.Config(k=2))
    filled = out.filter(f"{I.ROW_ID} % 1000 = 500").collect()
    assert len(filled) == 12 and all(r["v"] == r["x"] for r in filled if 500 < r["x"] < n - 500)


def test_export(spark):
    df = frame(spark, [("2024-01-05", dt.datetime(2024, 1, 5, 3), "20240105"), ("2024-01-06", None, "x")], "a string, t timestamp_ntz, b string")
    out, report = export.apply(df)
    assert tuple(out.orderBy(I.ROW_ID).first())[:3] == ("2024-01-05 00:00:00", "2024-01-05 03:00:00", "20240105")
    assert report["columns"]["a"]["loss"] == 0 and set(report["columns"]) == {"a", "t"}


def test_issues_and_scorecard(spark):
    df = frame(spark, [(1.0, None), (2.0, "x")], "a double, b string")
    one = I.Rule(F.col("a") > 1, "a", "semantic", "error", "big", 0.5)
    found = I.find(df, [one, one])
    assert found.count() == 2 and I.distinct(found).count() == 1
    whole = I.globals_(spark, [I.Rule(F.lit(True), "b", "pattern", "warn", "odd", 1.0)])
    card = scorecard.score(df, I.union(spark, [I.distinct(found), whole]))
    assert card["scores"] == {"completeness": 75.0, "validity": 68.75, "pattern": 100.0, "consistency": 100.0, "uniqueness": 100.0}
    assert card["overall_score"] == 84.38 and card["grade"] == "C" and card["warnings"]["count"] == 1
    assert card["analytics"]["worst_rows"] == [{"row": 1, "issue_count": 1, "severity_score": 3.188}]
    assert I.find(df, []).count() == 0 and I.first_per_rule(found, 1).count() == 1
    assert len(I.with_ids(found).first()["issue_id"]) == 12
    assert scorecard.score(df.limit(0), I.empty(spark))["overall_score"] == 0
