"""Speculated BPE against the tokenizers library, and against merging alone."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from tidemark.llm import queries, speculative

from .conftest import rows_of
from .test_tokens import TEXT, numbers

WORD = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def own():
    return speculative.WordBpe(WORD)


def check(own, library, texts):
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert numbers(ids) == want, text
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_any_text(own, library):
    settings(max_examples=400, deadline=None)(given(TEXT)(lambda t: check(own, library, [t])))()
    check(own, library, ["", " ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "É<|endoftext|>́e", "x" * 5000, "ab" * 3000, "it's don't I'LL", "日本語" * 400, "Σ ΑΣ İi ŉ", "\x1cone\x1dtwo"])


def test_given_words(own, library, spark):
    """Every different word of the given documents, and of made-up ones; some fail the check and are merged."""
    docs = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    own.seen = own.failed = 0
    check(own, library, docs)
    assert 0 < own.failed < own.seen
    rng = random.Random(3)
    tokens = [t.removesuffix("</w>") for t in own.merges.vocabulary if t.isascii()]
    made_up = ["".join(rng.choices(tokens, k=rng.randint(1, 5))) for _ in range(20_000)]
    check(own, library, made_up)
    words = [w for t in made_up for w in own._parts(t)]
    assert own.merges.encode(words)[1] == sum(own.merges.propose(w) != own.merges.merge(w) for w in words), "no word is merged in vain"


def test_clash_is_what_merging_says(own):
    """The verdict on a pair is whether merging both tokens' symbols keeps their boundary."""
    m = own.merges
    rng = np.random.default_rng(5)
    inner = np.array([i for t, i in m.inner.items() if m.sure[i]])
    last = np.array([i for i in m.last.values() if m.sure[i]])
    names = {i: t for t, i in m.vocabulary.items()}
    a, b = rng.choice(inner, 20_000), rng.choice(last, 20_000)
    for x, y, clash in zip(a.tolist(), b.tolist(), m.clash(a, b).tolist(), strict=True):
        assert (m.merge(names[x] + names[y].removesuffix("</w>")) != [x, y]) == clash


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_small_vocabularies(data):
    """Vocabularies that no training would give: several ways to one token, merges out of order, equal pairs in a row."""
    symbols = "abc"
    names = list(symbols)
    merges = []
    for _ in range(data.draw(st.integers(0, 12))):
        a, b = data.draw(st.sampled_from(names)), data.draw(st.sampled_from(names))
        if (a, b) not in merges:
            merges.append((a, b))
            names += [a + b] if a + b not in names else []
    data.draw(st.randoms()).shuffle(merges)
    vocabulary = {n: i for i, n in enumerate(names)}
    library = Tokenizer(models.BPE(vocab=vocabulary, merges=merges))
    own = speculative.Merges(vocabulary, merges)
    words = data.draw(st.lists(st.text(symbols, min_size=1, max_size=14), min_size=1, max_size=20))
    want = [library.encode(w).ids for w in words]
    assert own.encode(words)[0] == want
    with pytest.MonkeyPatch.context() as m:
        m.setattr(speculative, "SHORT", 0)
        assert [own.merge(w) for w in words] == want


def test_frames(spark, edge, clashing, empty, library):
    want = sorted(((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids) for r in edge.collect()), key=str)
    for docs in (edge, clashing):
        encoded = speculative.encode(docs, WORD)
        assert sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=str) == want
        decoded = speculative.decode(encoded, WORD)
        assert sorted(((r["doc_id"], r["decoded"]) for r in decoded.collect()), key=str) == sorted(((d, library.decode(i, skip_special_tokens=False)) for d, i in want), key=str)
    assert speculative.round_trip(empty, WORD).count() == 0
    odd = spark.createDataFrame([(1, [49407, 7, -1, 10**6, None]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert rows_of(speculative.decode(odd, WORD), "doc_id", "decoded") == [(1, "<|endoftext|> " + library.id_to_token(7)), (2, ""), (3, "")]


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = []
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(queries.op11_speculative_bpe(spark, "/root/testdata/sf0.001"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_files_of_another_kind():
    with pytest.raises(ValueError):
        speculative.WordBpe(P.path("byte_bpe_50k.json"))
