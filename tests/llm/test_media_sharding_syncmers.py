"""Media columns, Hilbert shards and syncmer fingerprints."""

import hashlib
import itertools
import math
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import media, sharding, syncmers

from .conftest import rows_of


def test_wav_round_trip(edge, clashing, empty):
    found = media.digests(media.text_media(clashing)).collect()
    want = []
    for r in edge.collect():
        payload, n = media.padded(r["text"])
        assert len(payload) % 64 == 0 and len(payload) >= max(64, n) and payload[:n] == (r["text"] or "").encode()
        want.append((r["doc_id"], n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(map(str, (tuple(r)[:5] for r in found))) == sorted(map(str, want))
    assert {r["feature"] for r in found if r["doc_id"] in (1, 2)} == {next(r["feature"] for r in found if r["doc_id"] == 1)}
    assert media.digests(media.text_media(empty)).count() == 0
    for r in found:
        assert len(r["times"]) == len(r["codes"])
        assert r["feature"] == hashlib.sha256(np.array(r["times"], "<i4").tobytes() + np.array(r["codes"], "<i4").tobytes()).hexdigest()
        payload = media.padded(next((x["text"] for x in edge.collect() if x["doc_id"] == r["doc_id"] and len((x["text"] or "").encode()) == r["n_bytes"])))[0]
        assert r["media_bytes"] == len(media.to_wav(payload)) and r["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest()
    none = edge.select("doc_id", F.lit(1).cast("long").alias("n_bytes"), F.lit(None).cast("binary").alias("media"))
    assert {(r["feature"], tuple(r["times"])) for r in media.digests(none).collect()} == {(None, ())}
    arrays = media.fingerprints(media.text_media(edge))
    assert arrays.filter("size(times) <> size(codes)").count() == 0 and arrays.filter("size(times) > 0").count() > 0


def test_peaks_find_a_tone():
    t = np.arange(8000) / media.RATE
    tone = (np.sin(2 * np.pi * 1000 * t) * 60).astype(np.float32)
    assert set(media.spectrum(tone)[:, 1:].argmax(axis=1) + 1) == {16}
    times, codes = media.fingerprint(np.concatenate([np.zeros(640, np.float32), tone[:256], np.zeros(640, np.float32), tone[:256]]))
    assert len(times) and (np.diff(times) >= 0).all() and ((codes >> 13) <= 64).all()
    assert len(media.fingerprint(np.zeros(300, np.float32))[0]) == 0


def wav_by_hand(payload):
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
    return head + payload


def pairs_by_hand(payload):
    """times and codes from their definition, one window at a time."""
    samples = [b - 128 for b in payload] + [0] * max(128 - len(payload), 0)
    shape = np.hanning(128).astype(np.float32)
    powers = []
    for at in range(0, len(samples) - 127, 64):
        f = np.fft.rfft(np.array(samples[at : at + 128], np.float32) * shape)
        powers.append((f.real**2 + f.imag**2).tolist())
    found = []
    for low, high in ((1, 6), (6, 16), (16, 33), (33, 65)):
        tops = [max(p[low:high]) for p in powers]
        for t, top in enumerate(tops):
            if top > 1 and (t == 0 or top >= tops[t - 1]) and (t + 1 == len(tops) or top > tops[t + 1]):
                found.append((t, powers[t].index(top, low)))
    found.sort()
    pairs = [(t, f << 13 | g << 6 | u - t) for i, (t, f) in enumerate(found) for u, g in found[i + 1 : i + 4] if u - t <= 63]
    return sorted(pairs)


def test_media_by_hand(spark, edge):
    """File, digests and pairs of every given text, against a header packed field by field and loops over windows."""
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.001"
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    odd = [(r["doc_id"], r["text"]) for r in edge.collect() if r["doc_id"] in (3, 4, 8, 1)]
    rows = queries.op8_wav_peaks(spark, sf).collect() + media.digests(media.text_media(spark.createDataFrame(odd, "doc_id long, text string"))).collect()
    texts = [given[r["doc_id"]] for r in rows[: len(given)]] + [dict(odd)[r["doc_id"]] for r in rows[len(given) :]]
    for r, text in zip(rows, texts, strict=True):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = wav_by_hand(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        if len(raw) < 20_000:
            pairs = pairs_by_hand(payload)
            assert list(zip(r["times"], r["codes"], strict=True)) == pairs
            assert r["feature"] == hashlib.sha256(np.array([t for t, _ in pairs], "<i4").tobytes() + np.array([c for _, c in pairs], "<i4").tobytes()).hexdigest()


def test_blocks_of_windows(monkeypatch):
    """Any block size gives the same peaks, and a long clip takes little memory."""
    rng = np.random.default_rng(3)
    clips = [rng.integers(0, 255, n).astype(np.uint8) for n in (1, 64, 127, 128, 192, 5000)]
    want = [media.fingerprint(c, 128.0) for c in clips]
    for size in (1, 2, 3, 50):
        monkeypatch.setattr(media, "BLOCK_WINDOWS", size)
        assert all((a == b).all() for c, w in zip(clips, want, strict=True) for a, b in zip(media.fingerprint(c, 128.0), w, strict=True))
    monkeypatch.undo()
    stored = media.to_wav(rng.integers(32, 126, 20_000_000).astype(np.uint8).tobytes())
    tracemalloc.start()
    media.wav_fingerprint(stored)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(stored), peak / len(stored)


def index_by_hand(cell, bits):
    """The published scalar routine from axes to the transposed Hilbert index, on Python integers."""
    x, n, m = list(cell), len(cell), 1 << (bits - 1)
    q = m
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, m
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    digits = "".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x)
    return int(digits, 2)


def cell_by_hand(value, values):
    """Cell of 32 of a category: its place among the different values, equal values' places spread out."""
    different = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
    if value is None:
        return 0
    n = len(different)
    starts = sorted({k * 32 // n for k in range(n)})
    return starts.index(different.index(value) * 32 // n) * 32 // len(starts)


def size_cell(n):
    return min(31, math.floor(2 * math.log2(n + 1)))


def test_shards_by_hand(spark):
    """Shards and slots of the query, against a plain sort."""
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sources, langs = [r["source"] for r in docs], [r["lang"] for r in docs]

    def key(r):
        raw = (r["text"] or "").encode()
        return index_by_hand((cell_by_hand(r["source"], sources), cell_by_hand(r["lang"], langs), size_cell(len(raw))), 5), zlib.crc32(raw), r["doc_id"]

    order = [r["doc_id"] for r in sorted(docs, key=key)]
    n, want = len(order), {}
    for shard in range(16):
        for slot, doc_id in enumerate(order[shard * n // 16 : (shard + 1) * n // 16]):
            want[doc_id] = (shard, slot)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in queries.op7_hilbert_sharding(spark, sf).collect()} == want


def test_min_and_max_exclude_shards(spark):
    """Shards left by their min and max for each source, language and size, against rows dealt at random."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "lang", "text")
    docs = docs.withColumn("size", F.octet_length("text")).drop("text")
    cells = [*(sharding.category_cell(F.col(c), sharding.category_cuts(docs, c)) for c in ("source", "lang")), sharding.log_cell(F.col("size"))]
    curve = sharding.shard(docs, cells, ["doc_id"])
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    sizes = [0, 100, 500, 2000, 10_000]

    def left(rows):
        bounds = rows.groupBy("shard").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("source", "lang", "size") for f in (F.min, F.max)]).collect()
        found = {}
        for c, values in (("source", [f"src{i}" for i in range(20)]), ("lang", ["de", "en", "es", "fr"]), ("size", sizes)):
            found[c] = np.mean([sum(b[f"min_{c}"] <= v <= b[f"max_{c}"] for b in bounds) for v in values])
        return found

    near, random_ = left(curve), left(dealt)
    assert random_["source"] > 15.5 and random_["lang"] > 15.5
    assert near["source"] < 9 and near["lang"] < 9 and near["size"] < random_["size"], (near, random_)
    together = curve.join(docs.select("doc_id"), "doc_id").count()
    assert together == docs.count()


def test_equal_texts_lie_side_by_side(spark):
    rows = [(i, ["same", "other text", None][i % 3] if i % 2 else f"t{i}", "en", "a") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    out = sharding.shard(docs, sharding.document_cells(docs), ["crc", "doc_id"], 4).orderBy("shard", "slot").collect()
    for text in ("same", "other text", None):
        at = [i for i, r in enumerate(out) if r["text"] == text]
        assert len(at) == 20 and at == list(range(at[0], at[0] + 20))


def test_category_cells(spark):
    rows = spark.createDataFrame([(v,) for v in [None, "b", "a", "a", "d", "c"] + [f"k{i:03}" for i in range(100)]], "v string")
    cuts = sharding.category_cuts(rows, "v")
    cells = sorted(((r["v"], r["c"]) for r in rows.select("v", sharding.category_cell(F.col("v"), cuts).alias("c")).collect()), key=lambda r: (r[0] is not None, r[0] or ""))
    numbers = [c for _, c in cells]
    assert numbers == sorted(numbers) and numbers[0] == 0 and numbers[-1] == 31 and len(set(numbers)) == 32 == len(cuts)
    assert sharding.category_cuts(rows.limit(0), "v") == []
    assert rows.select(sharding.category_cell(F.col("v"), []).alias("c")).distinct().collect()[0]["c"] == 0


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (4, 2), (1, 4)])
def test_hilbert_curve(n, bits):
    """A bijection whose neighbours along the curve differ by one step in one dimension."""
    cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards(small, clashing, empty, tmp_path):
    for docs, n in ((small, small.count()), (clashing, 13), (empty, 0)):
        out = sharding.shard(docs, sharding.document_cells(docs), ["doc_id", "text"], 16)
        assert out.count() == n and set(docs.columns) - {"shard", "slot"} <= set(out.columns)
        by = {}
        for r in out.collect():
            by.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        if n:
            sizes = [len(by.get(s, [])) for s in range(16)]
            assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n
    sharding.write_shards(sharding.shard(small, sharding.document_cells(small), ["doc_id"]), str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("shard=*"))) == 16
    pairs = sharding.shard(small, sharding.document_cells(small), ["doc_id"]).groupBy("shard").agg(F.count_distinct("lang").alias("langs"))
    assert pairs.agg(F.avg("langs")).first()[0] < 3


def by_hand(text):
    """(place, run) of the closed syncmers of a text, from their definition; runs that reach into the padding first."""
    raw = (text or "").lower().encode()
    k, s = syncmers.RUN, syncmers.INNER
    found = [(0, raw[:n]) for n in range(1, min(len(raw), k - 1) + 1)]
    order = [syncmers.order(raw[i : i + s]) for i in range(len(raw) - s + 1)]
    chosen = set()
    for i in range(len(raw) - k + 1):
        inner = order[i : i + k - s + 1]
        for edge in (0, k - s):
            if inner.index(min(inner)) == edge:
                chosen.add((i + edge, edge, raw[i : i + k]))
    return found + [(place, run) for place, _, run in sorted(chosen)]


TEXTS = [" ".join(f"w{i * i % 97}" for i in range(n)) for n in range(1, 41)] + ["x", "abcd", "unbroken" * 9, "a" * 90, "漢字かな交じり文🙂です" * 5, " A\t b\n", "Ünïcödé " * 9, "tie " * 60 + "jq" * 40 + "k" * 70, "aside " * 30, "", None]


def test_syncmers_by_hand(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in syncmers.fingerprint(df).collect()}
    runs = {}
    for i, t in enumerate(TEXTS):
        want = by_hand(t)
        assert found[i]["places"] == [p for p, _ in want], t
        assert len(found[i]["fingerprint"]) == 8 * len(want) and bool(found[i]["anchors"]) == bool(t)
        for (_, run), h in zip(want, found[i]["anchors"], strict=True):
            assert runs.setdefault(run, h) == h
    assert len(set(runs.values())) == len(runs)
    words = " ".join(f"w{i * i % 37}" for i in range(400))
    pair = spark.createDataFrame([(1, words), (2, "New beginning: " + words + " and a tail"), (3, "w " * 2000), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r.asDict() for r in syncmers.fingerprint(pair).collect()}
    assert set(got[1]["anchors"][syncmers.RUN :]) <= set(got[2]["anchors"]), "a passage keeps its anchors in any context"
    sides = "struct<places array<int>, anchors array<int>>"
    moved = spark.createDataFrame([(got[1], got[2], "mine"), (got[3], got[3], "mine"), (got[1], got[4], "mine"), (got[4], got[4], "mine")], f"a {sides}, b {sides}, _shared string")
    out = [(r["shift"], round(r["likeness"], 1), r["_shared"]) for r in syncmers.shifts(moved).collect()]
    assert out[0][0] == 15 and out[0][1] > 0.7 and out[1:] == [(0, 1.0, "mine"), (None, 0.0, "mine"), (None, 1.0, "mine")]


def likeness_by_hand(a, b):
    """Of (run, bytes to the next place)."""
    items = []
    for text in (a, b):
        raw, found = (text or "").lower().encode(), by_hand(text)
        places = [p for p, _ in found[1:]] + [len(raw)]
        first = min(len(raw), syncmers.RUN - 1)
        items.append({(run, q - p if i >= first else None) for i, ((p, run), q) in enumerate(zip(found, places, strict=True))} if found else set())
    x, y = items
    return len(x & y) / len(x | y) if x | y else 1.0


def test_likeness_by_hand(spark):
    """Both likenesses of the query against sets of runs and gaps, around 14 to 20 words too."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["text"]) for r in df.collect())
    for r in syncmers.compare_edited(df).collect():
        k = next(k for k, (i, _) in enumerate(rows) if i == r["doc_id"])
        text, after = rows[k][1], rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert r["near_edited"] == pytest.approx(likeness_by_hand(text, edited)) and r["near_next"] == pytest.approx(likeness_by_hand(text, after))


def test_compare_edited(edge, clashing, empty, small):
    rows = small.select("doc_id", "text").collect()
    ordered = sorted((r["doc_id"], r["text"] or "") for r in rows)
    found = {r["doc_id"]: r for r in syncmers.compare_edited(small).collect()}
    near = []
    for i, (doc_id, text) in enumerate(ordered):
        m = len(text) // 4
        edited = text[: len(text) - m] + ordered[(i + 1) % len(ordered)][1][:m]
        r = found[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        near.append((r["near_edited"], r["near_next"]))
    assert np.mean([a > b for a, b in near]) > 0.97
    got = syncmers.compare_edited(clashing).collect()
    assert len(got) == 13 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    same = {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1 and syncmers.compare_edited(empty).count() == 0
    assert rows_of(syncmers.compare_edited(edge), "doc_id", "fingerprint") == sorted(((r["doc_id"], r["fingerprint"]) for r in got), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_near_copies_of_all_lengths(spark):
    """One rule at all lengths: near copies are alike on both sides of any length."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r["doc_id"]: set(r["anchors"]) for r in syncmers.fingerprint(df).collect()}
    for n in range(2, 39):
        a, b = found[n], found[n + 1]
        assert len(a & b) / len(a | b) > 0.4, "one word more leaves most anchors, at 15 and 16 words too"
    assert all(r["near_edited"] > 0.3 for r in syncmers.compare_edited(df.filter("text <> ''")).collect())


def test_null_ids_go_by_partition(spark):
    docs = spark.createDataFrame([(None, f"text number {i}") for i in range(40)] + [(1, "some text"), (2, "other text")], "doc_id long, text string").repartition(8)
    found = syncmers.compare_edited(docs).collect()
    assert len(found) == 42 and all(r["near_next"] == 0 for r in found if r["doc_id"] is None)
    assert {r["doc_id"] for r in found if r["doc_id"]} == {1, 2}
