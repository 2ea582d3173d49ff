"""Packing, byte-level BPE and token files against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, token_files, tokenizing
from tidemark.llm.common import by_bytes

from .conftest import rows_of

BYTE, WORD, RANKS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
TEXT = st.text(st.one_of(st.sampled_from(" \n\t\x1c'sabcABC123²½éßñĲŉſİΣ中🙂‍　\xa0.,_!﷐\x00"), st.characters(codec="utf-8")), max_size=60)


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


@pytest.mark.parametrize(("path", "spaced", "split"), [(BYTE, True, tokenizing.by_spaces), (WORD, False, tokenizing.by_white_space)])
def test_cache_gives_the_librarys_ids(path, spaced, split):
    ids = library(path)
    cache = tokenizing.library_cache(path, spaced)

    @settings(max_examples=300, deadline=None)
    @given(TEXT)
    def check(text):
        assert numbers(tokenizing.encode_texts(cache, split, [text])[0]) == ids(text)

    check()
    for text in ["<|endoftext|> <|startoftext|>", "hello <|endoftext|> world, it's<|endoftext|>", "x<|ENDOFTEXT|>y<|startoftext|><|endoftext|>  z", "é<|endoftext|>é\u0301 <|endoftext|>", "a" * 3000, " " * 500, "don't  stop\n now"]:
        assert numbers(tokenizing.encode_texts(cache, split, [text])[0]) == ids(text)


@pytest.mark.parametrize(("path", "spaced", "split"), [(BYTE, True, tokenizing.by_spaces), (WORD, False, tokenizing.by_white_space)])
def test_texts_together_have_the_librarys_ids(path, spaced, split, monkeypatch):
    monkeypatch.setattr(tokenizing, "GATHERED", 7)
    ids = library(path)
    cache = tokenizing.library_cache(path, spaced)
    odd = ["", "Word word. WORD, word., .word ,", "ŉ ŉ. İ, ſ Éé, ß. µ ªº", "it's don't, 'S.", "a\x1cb c", "x<|endoftext|>. <|ENDOFTEXT|>", "one " * 40, "中 , . é e\u0301, "]

    @settings(max_examples=100, deadline=None)
    @given(st.lists(st.one_of(TEXT, st.sampled_from(odd)), max_size=8))
    def check(texts):
        assert list(map(numbers, tokenizing.encode_together(cache, split, texts))) == list(map(ids, texts))

    check()
    check.hypothesis.inner_test(odd)


def test_repeated_words_are_encoded_once(monkeypatch):
    """Whatever their capitals and marks, and however many texts hold them."""
    tokenizing.library_cache.cache_clear()
    cache = tokenizing.library_cache(WORD, False)
    made, one = [], cache.one
    cache.one = lambda cache, chunk: made.append(chunk) or one(cache, chunk)
    texts = ["Word, word. WORD other", "word other. Other,", "Word"] * 5
    assert list(map(numbers, tokenizing.encode_together(cache, tokenizing.by_white_space, texts))) == list(map(library(WORD), texts))
    assert sorted(made) == [",", ".", "other", "word"]
    tokenizing.library_cache.cache_clear()


def test_cache_starts_again(monkeypatch):
    monkeypatch.setattr(tokenizing, "CACHE_CHUNKS", 3)
    tokenizing.library_cache.cache_clear()
    cache = tokenizing.library_cache(BYTE)
    text = "one two three four five six one two"
    assert numbers(tokenizing.encode_texts(cache, tokenizing.by_spaces, [text])[0]) == library(BYTE)(text)
    assert len(cache) <= 4


def test_packing(edge, clashing, empty):
    ids = library(BYTE)
    pieces = packing.pack(edge, BYTE)
    rows = pieces.collect()
    want = {}
    for r in edge.collect():
        want.setdefault((r["doc_id"], tuple([*ids(r["text"] or ""), 1])), 0)
        want[(r["doc_id"], tuple([*ids(r["text"] or ""), 1]))] += 1
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    total = sum(n * len(k[1]) for k, n in want.items())
    assert sum(r["length"] for r in rows) == total
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for (doc_id, tokens), n in want.items():
        pieces_of = sorted(by_doc[(doc_id, len(tokens))], key=lambda r: r["start"])
        assert [x for r in pieces_of[::n] for x in r["ids"]] == list(tokens)
    assert packing.pack(clashing, BYTE).count() == len(rows) and packing.pack(empty, BYTE).count() == 0
    assert packing.piece_lengths(2048 * 2 + 5) == [2048, 2048, 4, 1] and packing.piece_lengths(0) == []
    with pytest.raises(ValueError):
        packing.piece_lengths(1, 100)


def test_byte_bpe(edge, clashing, empty, small):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.codec(RANKS, P.PATTERN)

    @settings(max_examples=300, deadline=None)
    @given(TEXT)
    def check(text):
        ids = numbers(own.encode([text])[0])
        assert ids == plain.encode_ordinary(text) and own.decode(ids) == text.encode()

    check()
    for docs in (edge, small):
        want = []
        for r in docs.collect():
            ids = plain.encode_ordinary(r["text"] or "")
            want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        found = rows_of(bpe.round_trip(docs, RANKS, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
        assert found == sorted(want, key=lambda r: tuple((x is not None, str(x)) for x in r))
    back = bpe.decode(bpe.encode(clashing, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert rows_of(back, "doc_id", "decoded") == sorted(((r["doc_id"], bytearray((r["text"] or "").encode())) for r in edge.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=40).map(sorted), st.integers(0, 5))
def test_elias_fano(values, repeat):
    values = sorted(values + values[:repeat])
    code = token_files.EliasFano.of(np.array(values, np.int64))
    again, rest = token_files.EliasFano.read(memoryview(code.to_bytes() + b"rest"))
    assert bytes(rest) == b"rest" and again.values().tolist() == values
    assert [again.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    rng = random.Random(1)
    starts = np.cumsum([rng.randint(1, 2000) for _ in range(5000)])
    code = token_files.EliasFano.of(starts)
    assert len(code.to_bytes()) < 5000 * 2 and [code.select(i) for i in (0, 255, 256, 4999)] == starts[[0, 255, 256, 4999]].tolist()
    with pytest.raises(IndexError):
        code.select(5000)


def test_select_reads_one_value(monkeypatch):
    """A single value's low bits are read at once, not by arrays of one bit each."""
    code = token_files.EliasFano.of(np.arange(3000) * 1100)
    monkeypatch.setattr(token_files.EliasFano, "_low", None)
    assert [code.select(i) for i in range(3000)] == (np.arange(3000) * 1100).tolist()


def test_texts_go_by_bytes():
    batch = pa.RecordBatch.from_pydict({"doc_id": range(7), "text": ["aé", None, "", "b" * 9, "c", "dd", "e"]})
    assert [x["doc_id"].to_pylist() for k in (0, 1) for x in by_bytes(batch.slice(k), "text", 4)] == [[0, 1, 2], [3], [4, 5, 6], [1, 2], [3], [4, 5, 6]]


def test_token_files(edge, clashing, empty, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    ids = library(WORD)
    docs = sorted(((r["doc_id"], [*ids(r["text"] or ""), 2]) for r in edge.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for frame in (edge, clashing):
        rows = sorted(token_files.write_and_read(frame, WORD).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in rows] == [d for d, _ in docs]
        at = 0
        for r in rows:
            assert r["start"] == at
            at += r["n_tokens"]
        assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for _, x in docs)
    assert token_files.write_and_read(empty, WORD).count() == 0
    with pytest.raises(ValueError):
        token_files.open_file(b"something else")


ODD_LINES = ["a\nb", "a.\nB\nc", "\na", "a\n", "a\n\nb", "a \nb", "a\n b", "a\r\nb", "a\t\nb", "a\xa0\nb", "\n", "\n\n", "it's.\n'S", "x\n﷐y"]
ODD_WORDS = ["", None, " ", "a  b", "a  ", " a", "word. word, WORD's word's' ''s", "(a) a-b a1 1a a.b .", "é, É. ŉ İ. ª! µ\xd7 \xd7, é. 中, 🙂.", "x<|endoftext|>. <|endoftext|> y<| |>", "w\x00. \x00 a", "x" * 300 + ", " + "x" * 300, "a\x1cb. c"]


def test_columns_have_the_librarys_ids(monkeypatch):
    """Words with marks and lines, cut by Arrow, whatever stands beside them and however few are held or encoded at once."""
    ids = library(BYTE)
    cache = tokenizing.library_cache(BYTE)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.one_of(st.none(), TEXT, st.sampled_from(ODD_LINES + ODD_WORDS)), max_size=8), st.booleans())
    def check(texts, large):
        column = pa.array([None, *texts], pa.large_string() if large else pa.string()).slice(1)
        assert list(map(numbers, tokenizing.encode_spaced(cache, column))) == [ids(t or "") for t in texts]

    check()
    check.hypothesis.inner_test(ODD_LINES + ODD_WORDS, False)
    for name, value in (("GATHERED", 7), ("WORDS_AT_ONCE", 2), ("CACHE_CHUNKS", 3)):
        monkeypatch.setattr(tokenizing, name, value)
        cache.clear()
        check.hypothesis.inner_test(ODD_LINES + ODD_WORDS, False)
        assert len(cache) <= tokenizing.CACHE_CHUNKS + 1
    cache.clear()


def test_packing_encodes_words_together():
    """A word is encoded once for all its marks, and new words go to the library in one call, not in one each."""
    tokenizing.library_cache.cache_clear()
    cache = tokenizing.library_cache(BYTE)
    alone, together = [], []
    one, words = cache.one, cache.words
    cache.one = lambda cache, chunk: alone.append(chunk) or one(cache, chunk)
    cache.words = lambda keys: together.append(sorted(keys)) or words(keys)
    texts = ["word, word. other\nword", "word other! word###", None] * 5
    assert list(map(numbers, tokenizing.encode_spaced(cache, pa.array(texts)))) == [library(BYTE)(t or "") for t in texts]
    assert together == [sorted(["word", "other", tokenizing.FIRST + "word"])]
    assert not any(c.strip(tokenizing.FIRST).isalpha() for c in alone) and len(alone) == len(set(alone))
    tokenizing.library_cache.cache_clear()
