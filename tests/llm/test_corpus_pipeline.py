"""Stages of the corpus pipeline on small tables, against their definitions."""

import corpus_pipeline as C
from pyspark.sql import functions as F

from .test_jaccard import brute, shingles


def stages(spark, docs, sf_dir, tmp_path):
    out = {}
    for name, f in C.STAGES:
        f(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = out[name] = spark.read.parquet(str(tmp_path / name))
    return out


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = stages(spark, docs, sf, tmp_path)
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    counts = [docs.count(), *(out[n].count() for n in ("toxicity", "quality", "near_duplicates"))]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert all(out[n].columns == docs.columns for n in ("toxicity", "quality", "near_duplicates"))
    rows = [(r["doc_id"], r["text"]) for r in out["quality"].collect()]
    want = {c for d, _, c in brute(rows, C.SHINGLE_WORDS, C.NEAR)}
    assert {r["doc_id"] for r in out["near_duplicates"].collect()} == want
    assert all(shingles(t, 5) is not None for _, t in rows)
    packed = {r["doc_id"] for r in out["packing"].select("doc_id").distinct().collect()}
    assert packed == want
    assert C.run(spark, sf).count() == out["packing"].count()


def test_edges(spark, clashing, empty, tmp_path):
    sf = str(tmp_path / "t")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    clashing.withColumn("n", F.lit(1)).write.parquet(f"{sf}/documents.parquet")
    out = stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf, tmp_path / "a")
    assert out["near_duplicates"].columns == [*clashing.columns, "n"]
    assert {r["text"] for r in out["near_duplicates"].collect()} <= {r["text"] for r in clashing.collect()}
    none = stages(spark, empty, sf, tmp_path / "b")
    assert none["packing"].count() == 0
