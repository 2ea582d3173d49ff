"""Stores that runs share: additions side by side, URIs, files that are whole or not there."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from tidemark.plans.pipeline import CleaningPipeline
from tidemark.sources import files, scratch, shared
from tidemark.sources.stores import LearningMemory, QualityHistory, SemanticHistory


@pytest.fixture(params=["disk", "file", "store"])
def folder(request, spark, tmp_path):
    """A folder on the driver's disk, by path and by URI, and one that only Spark's file systems can open."""
    mount = f"m{abs(hash(tmp_path))}"
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{mount}.link./in", f"file://{tmp_path}")
    return {"disk": str(tmp_path), "file": f"file://{tmp_path}", "store": f"viewfs://{mount}/in"}[request.param]


def test_runs_side_by_side_lose_nothing(folder):
    """Runs that opened a store at the same time all add to it."""
    path = f"{folder}/memory.json"
    runs = [LearningMemory(path, "long") for _ in range(4)]
    for i, m in enumerate(runs):
        for k in range(5):
            m.record("Price", "money", 0.5 + i / 10, k < i)
            m.save() if k == 2 else None
    for m in runs:
        m.save()
    found = LearningMemory(path, "long").memory["price|money"]
    assert (found["seen"], found["failures"]) == (20, 14) and abs(found["avg_confidence"] - 0.65) < 1e-9
    assert LearningMemory(path, "long").penalty("price", "money") == 0.35

    histories = [SemanticHistory(f"{folder}/types.json") for _ in range(3)]
    for i, h in enumerate(histories):
        h.update("Age", "AGE", 0.8 + i / 100, [])
        h.update(f"own {i}", "TEXT", 0.6, [])
        h.save()
    again = SemanticHistory(f"{folder}/types.json")
    assert again.records["age"]["seen_count"] == 3 and abs(again.records["age"]["confidence"] - 0.82) < 1e-9 and {"own 0", "own 1", "own 2"} < again.records.keys()

    scores = [QualityHistory(f"{folder}/scores.json") for _ in range(3)]
    for i, q in enumerate(scores):
        q.add("f", 80.0 + i)
    assert [r["score"] for r in QualityHistory(f"{folder}/scores.json").runs] == [80.0, 81.0, 82.0]
    assert QualityHistory(f"{folder}/scores.json").add("f", 90.5)["delta_score"] == 8.5


def test_what_was_stored_before_counts(folder):
    """A file from before the journal is its beginning."""
    shared.write_text(f"{folder}/m.json", json.dumps({"c|money": {"seen": 4, "failures": 4, "avg_confidence": 0.5}}))
    m = LearningMemory(f"{folder}/m.json")
    m.record("c", "money", 0.5, False)
    m.save()
    assert LearningMemory(f"{folder}/m.json").penalty("c", "money") == 0.25
    shared.write_text(f"{folder}/m.json.d/0-broken.json", "{")
    assert LearningMemory(f"{folder}/m.json").penalty("c", "money") == 0.25


def test_texts_are_replaced_whole(folder, tmp_path):
    path = f"{folder}/a/b.txt"
    with pytest.raises(FileNotFoundError):
        shared.read_text(path)
    assert shared.names_in(f"{folder}/a") == []
    texts = [f"{i} é" * 1000 for i in range(12)]
    # The store behind viewfs here keeps checksums apart from files, and so can't take two writers at once.
    with ThreadPoolExecutor(1 if folder.startswith("viewfs") else 4) as pool:
        list(pool.map(lambda t: shared.write_text(path, t), texts))
    assert shared.read_text(path) in texts
    assert [n for n in shared.names_in(f"{folder}/a") if not n.endswith(".crc")] == ["b.txt"], "no part of a text is left"


def test_pipelines_and_reports_by_uri(spark, folder):
    df = spark.createDataFrame([(float(i), f"k{i % 3}") for i in range(30)], "weight double, kind string")
    fitted = CleaningPipeline().fit(df)
    fitted.save(f"{folder}/models/one.json")
    fitted.save(f"{folder}/models/one.json")
    assert CleaningPipeline.load(f"{folder}/models/one.json").plans == json.loads(json.dumps(fitted.plans, default=str))
    assert files.write_report({"a": 1}, f"{folder}/r.json") and json.loads(shared.read_text(f"{folder}/r.json")) == {"a": 1}
    assert not files.write_report({"a": 1}, "nostore://x/y")


def test_made_frames_tell_their_rows_and_nulls(spark):
    """One job writes the frame and counts; any column name and type comes back."""
    df = spark.sql("select id as `a b`, if(id % 3 = 0, null, id) as `c.d;`, cast(null as void) as `=`, timestamp_ntz'2024-01-01 00:00:00' as t, array(id) as l from range(100)")
    before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    out, rows, nulls = scratch.made(df, "test")
    assert spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() == before + 1
    assert out.schema.simpleString() == df.schema.simpleString() and rows == 100
    assert nulls == {"a b": 0, "c.d;": 34, "=": 100, "t": 0, "l": 0}
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
