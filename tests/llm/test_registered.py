"""The registered queries themselves, on the smallest tables: the columns of their contracts."""

import hashlib
import zlib

import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize(("query", "threshold"), [(queries.op2_toxicity, 0.5), (queries.op6_quality, 0.3)])
def test_classifiers(spark, docs, query, threshold):
    rows = query(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)


def test_language(spark, docs):
    rows = queries.op10_language(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    known = {d["lang"] for d in docs.values()} | {"und"}
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and r["lang_pred"] in known and 0 <= r["score"] <= 1 for r in rows)


def test_sharding(spark, docs):
    rows = queries.op7_hilbert_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    slots = {}
    for r in rows:
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_media(spark, docs):
    rows = queries.op8_wav_peaks(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_pieces_lie_gapless(spark, docs):
    pieces, sequences = {}, {}
    for r in queries.op3_packing(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(pieces) == sorted(docs)
    for found in pieces.values():
        at = 0
        for start, length, total in sorted(found):
            assert start == at and total == found[0][2]
            at += length
        assert at == found[0][2]
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048


def test_token_files_and_links(spark, docs):
    at = 0
    for r in sorted(queries.op9_elias_fano(spark, SF).collect(), key=lambda r: r["doc_id"]):
        assert r["start"] == at
        at += r["n_tokens"]
    rows = queries.op1_ngram_jaccard(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and all(r["component_id"] <= r["doc_id"] for r in rows)
