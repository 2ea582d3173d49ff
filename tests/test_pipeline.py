"""The whole pipeline: invariants, saving, runners, streams, command lines, registered queries."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile as P
from tidemark.operators import impute, semantics, structure
from tidemark.plans import advisor as A
from tidemark.plans.cli import main, summarise
from tidemark.plans.pipeline import CleaningPipeline, Options, fit_and_save, without_row_id
from tidemark.plans.runner import run, run_files
from tidemark.sources import files
from tidemark.streaming import apply as streams


@pytest.fixture
def dirty(spark):
    rows = [(f"INV-{i}", f"₹{i},200" if i % 3 else None, f"u{i}@x.com" if i % 7 else "bad", float(i % 120), i * 1.5 if i % 5 else None, float(i), 140.0 if i % 9 == 0 else 50.0) for i in range(60)]
    return spark.createDataFrame(rows, "`Invoice ID` string, `Amount Paid` string, `E-Mail` string, height double, score double, price_min double, tax_percent double")


def test_invariants(dirty, tmp_path):
    p = CleaningPipeline(Options())
    result = p.fit_transform(dirty, strict=True)
    out = without_row_id(result.df)
    assert out.count() == 60 and out.columns == ["invoice_id", "amount_paid", "email", "height", "score", "price_min", "tax_percent"]
    assert result.report["status"] == "success" and out.filter("score is null").count() == 0
    assert {r["stage"] for r in result.issues.select("stage").distinct().collect()} >= {"pattern", "relationship"}
    p.save(str(tmp_path / "m.json"))
    again = CleaningPipeline.load(str(tmp_path / "m.json")).transform(dirty.repartition(3), strict=True)
    assert sorted(map(tuple, without_row_id(again.df).collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
    with pytest.raises(RuntimeError):
        CleaningPipeline().transform(dirty)
    with pytest.raises(ValueError):
        Options(mode="wild")


def test_modes_and_advice(dirty):
    result = CleaningPipeline(Options(mode="conservative", structure=structure.Config(impute=False))).fit_transform(dirty)
    assert result.df.filter("score is null").count() == 12
    p = CleaningPipeline(Options(), A.StaticAdvisor({"Amount Paid": {"semantic_type": "MONEY", "confidence": 0.95}})).fit(dirty)
    assert p.plans["advisor"] == "ok"

    class Broken:
        def advise(self, summary):
            raise OSError("no endpoint")

    assert CleaningPipeline(Options(), Broken()).fit(dirty).plans["advisor"].startswith("failed")
    safe = A.safe({"columns": {"a": {"semantic_type": "nope", "confidence": 7, "regex": "("}, "zz": {}}, "mode": "x"}, ["a"])
    assert safe == {"columns": {"a": {"semantic_type": "TEXT", "confidence": 1.0, "protect": False}}, "mode": None}
    assert A.json_block('so: {"a": 1} ok') == {"a": 1} and A.json_block("none") is None
    tries = []

    @A.retry(3, 0)
    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert flaky() == "done"


def test_files_and_runs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name , qty\nann, 1\nbob, x\n" * 8)
    path = str(tmp_path / "a.csv")
    df = files.read(spark, path)
    assert df.columns == ["name", "qty"] and df.count() == 23
    with pytest.raises(ValueError):
        files.read(spark, "a.txt")
    found, errors = files.read_many(spark, [path, str(tmp_path / "no.csv")])
    assert list(found) == [path] and len(errors) == 1
    results, failures = run_files(spark, [path, str(tmp_path / "no.csv")])
    assert results[path]["scorecard"]["overall_score"] > 0 and len(failures) == 1
    done = run(df, timeout=300, history_path=str(tmp_path / "h.json"))
    assert done["scorecard"]["trend"]["previous_score"] is None
    with pytest.raises(TimeoutError):
        run(df, timeout=0.01)
    assert main(["train", path, str(tmp_path / "m.json")]) == 0
    assert main(["clean", path, str(tmp_path / "m.json"), str(tmp_path / "out")]) == 0
    report = json.loads((tmp_path / "out/report.json").read_text())
    assert summarise(report)[0] == "status: success" and main(["report", str(tmp_path / "out/report.json")]) == 0
    assert files.read_csv(spark, str(tmp_path / "out/cleaned.csv")).count() == 23


def test_streams(spark, dirty, tmp_path):
    dirty.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(dirty.schema).parquet(str(tmp_path / "in"))
    plan = structure.fit(files.ingest(dirty))
    out = streams.structural(stream, plan)
    q = out.writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cleaned").count() == 60
    p = CleaningPipeline(Options()).fit(dirty)
    got = []
    q = streams.per_batch(stream, p, lambda df, issues, n: got.append((n, df.count(), issues.count()))).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert got and got[0][1] == 60 and got[0][2] > 0


def test_fit_and_save(dirty, tmp_path):
    fit_and_save(dirty, str(tmp_path / "x/m.json"))
    (tmp_path / "empty.json").write_text('{"mode": "balanced", "plans": null}')
    with pytest.raises(ValueError):
        CleaningPipeline.load(str(tmp_path / "empty.json"))


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 6
    assert e.queries()["health_grade"](spark, "/root/testdata/sf0.001").filter(F.col("grade") == "A").count() > 0


def test_columns_are_renamed_by_name(spark):
    """Reordered, missing and added columns keep their own values."""
    train = spark.createDataFrame([(1.5 + i, f"town {i % 3}", f"k{i}") for i in range(30)], "`Height (m)` double, `Home Town` string, `E-Mail` string")
    fitted = CleaningPipeline(Options(aliases=None)).fit(train)
    for frame in (train.select("Home Town", "E-Mail", "Height (m)"), train.select("Home Town", "Height (m)"), train.select(train["Home Town"], train["Height (m)"], train["E-Mail"].alias("New One"))):
        out = fitted.transform(frame).df
        want = {"home_town", "height_m"} | ({"email"} if "E-Mail" in frame.columns else set()) | ({"new_one"} if "New One" in frame.columns else set())
        assert set(out.columns) - {P.ROW_ID} == want
        assert {r[0] for r in out.select("home_town").distinct().collect()} == {"town 0", "town 1", "town 2"}
        assert out.filter("height_m is null or height_m < 1").count() == 0


def test_modes_do_not_overrule_what_is_given(spark, tmp_path):
    """A mode sets the threshold and whether gaps are filled only where the caller leaves that open; configs handed in stay as they are."""
    mine, off = semantics.Config(threshold=0.5), impute.Config(enabled=False)
    o = Options(semantics=mine, impute=off)
    assert o.semantics is mine and mine.threshold == 0.5 and off.enabled is False
    assert Options(mode="aggressive").semantics.threshold == 0.60 and Options().impute_missing is True and Options(mode="conservative").impute_missing is False
    df = spark.createDataFrame([(float(i) if i % 5 else None, float(i)) for i in range(40)], "v double, w double")
    keep = structure.Config(impute=False)
    for options, gaps in ((Options(impute=off, structure=keep), 8), (Options(mode="conservative", structure=keep), 8), (Options(mode="conservative", impute_missing=True, structure=keep), 0), (Options(impute_missing=False, structure=keep), 8), (Options(structure=keep), 0)):
        p = CleaningPipeline(options).fit(df)
        p.save(str(tmp_path / "m.json"))
        again = CleaningPipeline.load(str(tmp_path / "m.json"))
        assert again.options.semantics == options.semantics and again.options.impute == options.impute and again.options.impute_missing == options.impute_missing
        assert again.transform(df, strict=True).df.filter("v is null").count() == gaps


def test_saved_options_and_unchanged_callers(spark, tmp_path):
    options = Options(mode="aggressive", numeric_tolerance=2.5, custom_patterns={"x": {"regex": "a+"}})
    options.structure.id_words = ["kennung"]
    options.quality.max_missing_rate = 0.3
    df = spark.createDataFrame([(float(i), f"v{i % 2}") for i in range(20)], "amount double, kind string")

    class Advisor:
        def advise(self, summary):
            return {"columns": {"amount": {"semantic_type": "PERCENTAGE", "confidence": 0.9, "min": 0, "max": 10, "alias": "anything"}, "kind": {"semantic_type": "BOOLEAN", "confidence": 0.9, "alias": "state"}}}

    fitted = CleaningPipeline(options, Advisor()).fit(df)
    assert options.quality.semantic_types == {} and "anything" not in str(fitted.plans["names"]) and fitted.plans["names"]["kind"] == "state"
    assert set(fitted.plans["quality_config"]["semantic_types"].values()) == {"percent", "bool"}
    fitted.save(str(tmp_path / "m.json"))
    again = CleaningPipeline.load(str(tmp_path / "m.json"))
    assert again.options.numeric_tolerance == 2.5 and again.options.structure.id_words == ["kennung"] and again.options.quality.max_missing_rate == 0.3 and again.options.mode == "aggressive"
    assert again.options.custom_patterns == options.custom_patterns


def test_advice_on_ambiguous_columns_of_each_data_set(spark):
    """At transform an advisor is asked about ambiguous columns alone, and its failure is told."""
    df = spark.createDataFrame([(f"P-{i}" if i % 10 else "odd one here", float(i % 7) + 0.25, i % 2 == 0) for i in range(60)], "stuff string, age double, flag boolean")
    asked = []

    class Advisor:
        def advise(self, summary):
            asked.append([s["column"] for s in summary])
            return {"columns": {"stuff": {"semantic_type": "CATEGORY", "confidence": 0.9, "regex": r"P-\d+", "alias": "none of ours"}, "age": {"semantic_type": "TEXT", "confidence": 0.1}}}

    p = CleaningPipeline(Options(), Advisor()).fit(df.drop("stuff").withColumnRenamed("age", "years old"))
    plans = dict(p.plans["custom_patterns"])
    result = p.transform(df)
    told = result.report["stages"]["semantics"]
    assert told["advisor"] == "ok" and asked[-1] == [c for c in told["asked"] if c in df.columns] and "stuff" in told["asked"] and "age" not in told["asked"]
    assert result.issues.filter("stage = 'pattern' and column = 'stuff'").count() == 6
    assert p.plans["custom_patterns"] == plans

    class Failing:
        def advise(self, summary):
            raise OSError("away")

    p.advisor = Failing()
    assert p.transform(df).report["stages"]["semantics"]["advisor"] == "failed: away"


def test_errors_in_rows_go_back_to_the_last_frame(spark, monkeypatch):
    """An error that only shows when rows are made is met at the next boundary, and reported."""
    from pyspark.sql import functions as F

    from tidemark.operators import relations

    df = spark.createDataFrame([(float(i), f"k{i % 3}") for i in range(30)], "weight double, kind string")
    p = CleaningPipeline().fit(df)

    def broken(d, *_):
        return d.withColumn("weight", F.when(F.col("weight") > 20, F.raise_error(F.lit("bad row")).cast("double")).otherwise(F.col("weight"))), None, {}

    monkeypatch.setattr(relations, "apply", broken)
    result = p.transform(df)
    assert result.report["status"] == "partial_success" and result.report["stages"]["relations"]["status"] == "failed"
    assert result.df.count() == 30 and result.report["rows"] == {"before": 30, "after": 30}
    with pytest.raises(Exception, match="bad row"):
        p.transform(df, strict=True)

    monkeypatch.setattr(relations, "apply", lambda d, *_: (d.limit(3), None, {}))
    result = p.transform(df)
    assert "3 rows of 30" in result.report["stages"]["relations"]["error"] and result.df.count() == 30


def test_size_warnings(spark):
    from tidemark.plans.runner import size_warnings

    df = spark.range(5)
    assert size_warnings(df) == [] and size_warnings(df, most_rows=5) == ["the input has 5 rows"] and len(size_warnings(df, 1, 5, rows=9)) == 2


def test_the_input_is_read_once(spark, tmp_path):
    """However many decisions fit and transform take, each row of the source is made once."""
    made = spark.sparkContext.accumulator(0)

    def seen(i):
        made.add(1)
        return f"k{i % 3}"

    kind = F.udf(seen, "string")
    df = spark.range(40).select(kind("id").alias("kind"), (F.col("id") * 1.5).alias("weight"))
    result = CleaningPipeline().fit_transform(df, strict=True)
    assert result.df.count() == 40 and made.value == 40
    assert result.report["columns"] == {"before": ["kind", "weight"], "after": ["kind", "weight"]}


def test_amounts_are_parsed_once(spark, monkeypatch):
    """The trial of a role, the guard of nulls and the result share one parse of each value."""
    from tidemark.operators import quality

    parsed = spark.sparkContext.accumulator(0)

    def parse(s):
        parsed.add(1)
        return float(s.strip("₹").replace(",", ""))

    monkeypatch.setitem(quality.PARSERS, "money", F.udf(parse, "double"))
    df = spark.createDataFrame([(i, f"₹{i},200") for i in range(1, 31)], f"{P.ROW_ID} long, price string")
    config = quality.Config(gating=False)
    out, _ = quality.apply(df, quality.fit(df, config), config)
    assert sorted(r["price"] for r in out.collect()) == [1000.0 * i + 200 for i in range(1, 31)]
    assert parsed.value == 30 and out.columns == [P.ROW_ID, "price"]
