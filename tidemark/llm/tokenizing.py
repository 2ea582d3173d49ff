"""Token ids of whole texts through a cache of the chunks between single spaces.

Corpora repeat their words, so the library encodes each chunk once and a text's
ids are the joined ids of its chunks.  A split is made only where the tokenizer
would split as well; texts where that is in doubt are encoded whole.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: Chunks kept per Python worker; the cache starts again when it is full.
CACHE_CHUNKS = 500_000
#: Chunks longer than this (characters) are not kept.
CACHE_CHARS = 256
#: Chunks whose ids are gathered at once; bounds memory, whatever the texts hold.
GATHERED = 2_000_000

#: The pattern of byte-level pre-tokenizers; a fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Marks a text's first chunk, which no space precedes (a code point that is never assigned).
FIRST = "\ufdd0"

#: Unicode white space as tokenizers see it, and what is white space to Python alone.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: A space after other white space may belong to the run before it.
_DOUBT = [f"{c} " for c in WHITE_SPACE] + [*SEPARATORS, FIRST]


def as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class ChunkCache(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit bytes, found when first asked for.

    whole gives the ids of a text; one those of a chunk, and may look its pieces up here.
    apart: a chunk of WORD has the ids of its letters in lower case, and then those of its mark.
    words: gives the ids of many chunks of letters, where a chunk of SPACED_WORD has those of its letters and then those of its marks.
    """

    apart = False
    words: Callable[[list[str]], list[bytes]] | None = None

    def __init__(self, whole: Callable[[str], bytes], one: Callable[[ChunkCache, str], bytes]):
        super().__init__()
        self.whole, self.one = whole, one

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        ids = self.one(self, chunk)
        if len(chunk) <= CACHE_CHARS:
            self[chunk] = ids
        return ids


def after_space(chunk: str) -> str:
    return chunk[1:] if chunk[:1] == FIRST else f" {chunk}"


def by_spaces(text: str) -> list[str] | None:
    """Chunks that follow a space (the first: the text's start); None where a byte-level pattern may join across them."""
    if any(map(text.__contains__, _DOUBT)):
        return None
    chunks = text.split(" ")
    chunks[0] = FIRST + chunks[0]
    return chunks


def by_white_space(text: str) -> list[str] | None:
    """Words between white space, for tokenizers that drop white space."""
    return None if any(map(text.__contains__, SEPARATORS)) else text.split()


def encode_texts(cache: ChunkCache, split: Callable[[str], list[str] | None], texts: list[str]) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""
    out = []
    for text in texts:
        chunks = split(text) if text else []
        out.append(cache.whole(text) if chunks is None else b"".join(map(cache.__getitem__, chunks)))
    return out


#: Letters whose case no Unicode version has changed, with or without a mark behind them.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
WORD = f"^[{LETTERS}]+[.,]?$"


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


#: Letters after a space or at a text's start, with or without marks behind them.
SPACED_WORD = rf"^{FIRST}?[{LETTERS}]+[!-/:-@\[-`{{-~]*$"
_BEFORE_MARKS = FIRST + "".join(re.findall(f"[{LETTERS}]", "".join(map(chr, range(0x180)))))
#: Words that the library encodes at once.
WORDS_AT_ONCE = 10_000


def _take(found: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joined ids of found[code] for each code, and how many each has."""
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
    return _take_flat(np.frombuffer(b"".join(found), np.uint32), lengths, codes)


def _take_flat(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = lengths[codes]
    # How far the ids of a code lie from where they go.
    moved = (np.cumsum(lengths) - lengths)[codes] - (np.cumsum(counts) - counts)
    return ids[np.arange(counts.sum()) + np.repeat(moved, counts)], counts


def _word_ids(cache: ChunkCache, words: list[str]) -> list[bytes]:
    """Ids of each of different words; those not in the cache are encoded together."""
    found = list(map(cache.get, words))
    new = [k for k, ids in enumerate(found) if ids is None]
    for at in range(0, len(new), WORDS_AT_ONCE):
        some = new[at : at + WORDS_AT_ONCE]
        if len(cache) + len(some) > CACHE_CHUNKS:
            cache.clear()
        for k, ids in zip(some, cache.words([words[k] for k in some]), strict=True):
            found[k] = ids
            if len(words[k]) <= CACHE_CHARS and len(cache) < CACHE_CHUNKS:
                cache[words[k]] = ids
    return found


def _spaced_ids(cache: ChunkCache, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Joined ids of different chunks of by_spaces, and how many each has; a word is looked up once for all its marks."""
    is_word = pc.match_substring_regex(chunks, SPACED_WORD)
    words = chunks.filter(is_word)
    coded = pc.utf8_rtrim(words, string.punctuation).dictionary_encode()
    marks = pc.utf8_ltrim(words, _BEFORE_MARKS).dictionary_encode()
    found = _word_ids(cache, _strings(coded.dictionary))
    ends = [cache[FIRST + m] for m in _strings(marks.dictionary)]
    others = list(map(cache.__getitem__, _strings(chunks.filter(pc.invert(is_word)))))
    # A chunk's word and its marks, or the chunk and nothing.
    is_word = is_word.to_numpy(zero_copy_only=False)
    codes = np.empty((len(chunks), 2), np.int64)
    codes[is_word, 0] = coded.indices
    codes[is_word, 1] = marks.indices.to_numpy() + len(found)
    codes[~is_word, 0] = np.arange(len(others)) + len(found) + len(ends)
    codes[~is_word, 1] = len(found) + len(ends) + len(others)
    ids, counts = _take([*found, *ends, *others, b""], codes.ravel())
    return ids, counts.reshape(-1, 2).sum(axis=1)


def _ids_of(cache: ChunkCache, chunks: pa.Array) -> list[bytes]:
    """Ids of each of different chunks; a word is looked up once for all its capitals and marks."""
    if not cache.apart:
        return list(map(cache.__getitem__, _strings(chunks)))
    is_word = pc.match_substring_regex(chunks, WORD).to_numpy(zero_copy_only=False)
    out = np.empty(len(chunks), object)
    out[~is_word] = list(map(cache.__getitem__, _strings(chunks.filter(pa.array(~is_word)))))
    words = chunks.filter(pa.array(is_word))
    coded = pc.utf8_lower(pc.utf8_rtrim(words, ".,")).dictionary_encode()
    found = list(map(cache.__getitem__, _strings(coded.dictionary)))
    marks = [b"", cache["."], cache[","]]
    mark = sum(k * pc.ends_with(words, m).to_numpy(zero_copy_only=False).astype(np.int8) for k, m in ((1, "."), (2, ",")))
    out[is_word] = [found[k] + marks[m] if m else found[k] for k, m in zip(coded.indices.to_numpy().tolist(), mark.tolist(), strict=True)]
    return out.tolist()


def _gather(cache: ChunkCache, chunks: pa.Array) -> tuple[bytes, np.ndarray]:
    """Joined ids of chunks, and how many each has; a chunk that occurs often is looked up once."""
    coded = chunks.dictionary_encode()
    codes = coded.indices.to_numpy()
    ids, counts = _take_flat(*_spaced_ids(cache, coded.dictionary), codes) if cache.words else _take(_ids_of(cache, coded.dictionary), codes)
    return ids.tobytes(), counts


def encode_together(cache: ChunkCache, split: Callable[[str], list[str] | None], texts: list[str]) -> list[bytes]:
    """What encode_texts gives, with each different chunk of the texts looked up once; pays for many texts."""
    out: list[bytes] = []
    columns: list[pa.Array] = []
    held: list[tuple[int, int]] = []  # a text's place in out, and where its chunks end
    total = 0

    def gather() -> None:
        nonlocal total
        chunks = pa.concat_arrays(columns) if columns else []
        parts = [_gather(cache, chunks[at : at + GATHERED]) for at in range(0, total, GATHERED)]
        ids = b"".join(x for x, _ in parts)
        ends = np.concatenate([[0], *(n for _, n in parts)]).cumsum() * 4
        begin = 0
        for place, last in held:
            end = int(ends[last])
            out[place], begin = ids[begin:end], end
        columns.clear()
        held.clear()
        total = 0

    for text in texts:
        chunks = split(text) if text else []
        if chunks is None:
            out.append(cache.whole(text))
            continue
        if total + len(chunks) > GATHERED:
            gather()
        total += len(chunks)
        held.append((len(out), total))
        out.append(b"")
        columns.append(pa.array(chunks, pa.large_string()))
        del chunks  # of a long text, many strings
    gather()
    return out


_WHITE = re.escape(WHITE_SPACE)
#: Where by_spaces gives up.
_IN_DOUBT = f"[{_WHITE}] |[{SEPARATORS}{FIRST}]"
#: Line ends beside other white space or at an end of the text.
_ODD_LINES = f"[{_WHITE}]\\n|\\n[{_WHITE}]|^\\n|\\n$"


def encode_spaced(cache: ChunkCache, texts: pa.Array) -> list[bytes]:
    """What encode_texts gives by by_spaces (null: empty), for a column; the texts are cut by Arrow and each different chunk is looked up once."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    doubtful = pc.match_substring_regex(texts, _IN_DOUBT)
    rest = pc.if_else(doubtful, "", texts)
    # A line end between other characters than white space is a piece of its own, and what follows it starts as a text does.
    rest = pc.if_else(pc.match_substring_regex(rest, _ODD_LINES), rest, pc.replace_substring(rest, "\n", f" {FIRST}\n {FIRST}"))
    first, nothing = (pa.scalar(x, pa.large_string()) for x in (FIRST, ""))
    cut = pc.split_pattern(pc.binary_join_element_wise(first, rest, nothing), " ")
    chunks, ends = cut.flatten(), np.diff(cut.offsets.to_numpy()).cumsum()
    parts = [_gather(cache, chunks[at : at + GATHERED]) for at in range(0, len(chunks), GATHERED)]
    ids = b"".join(x for x, _ in parts)
    bounds = 4 * np.concatenate([[0], *(n for _, n in parts)]).cumsum()[np.concatenate([[0], ends])]
    out = [ids[a:b] for a, b in pairwise(bounds.tolist())]
    for k in np.flatnonzero(doubtful.to_numpy(zero_copy_only=False)).tolist():
        out[k] = cache.whole(texts[k].as_py())
    return out


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


#: Characters whose case and class no Unicode version has changed; chunks of others go through the whole library.
PLAIN = re.compile("[ \n\t!-~¡-įı-ſ]*").fullmatch


@lru_cache(maxsize=4)
def library_cache(path: str, spaced: bool = True) -> ChunkCache:
    """Of a tokenizers file, for chunks of by_spaces or by_white_space; one per Python worker.

    Plain chunks are cut by the file's own pattern and their pieces handed to the
    library's model, which spares them the library's bookkeeping of offsets; all others
    are encoded by the whole library, in its default setting: strings of added tokens in
    a text become these tokens.
    """
    import json
    import os

    import regex

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    chars = byte_characters()
    spelled = {b: c for b, c in enumerate(chars) if chr(b) != c}
    tokenize = tokenizer.model.tokenize

    def whole(text: str) -> bytes:
        return as_bytes(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    text_of = after_space if spaced else str

    with open(path, encoding="utf-8") as f:
        setup = json.load(f)
    parts = setup["pre_tokenizer"].get("pretokenizers", [setup["pre_tokenizer"]])
    steps = (setup["normalizer"] or {}).get("normalizers", [])
    added = [t["content"] for t in setup["added_tokens"]]
    if any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in setup["added_tokens"]):
        raise ValueError("added tokens that take or hold white space")
    # Most chunks lack the character that all added tokens begin with, and need no further look.
    marks = {t[:1] for t in added}
    mark = marks.pop() if len(marks) == 1 else ""
    byte_level = parts[-1]["type"] == "ByteLevel" and not parts[-1]["add_prefix_space"]
    if byte_level and len(parts) == 1 and parts[0]["use_regex"] and not steps:
        pattern, lower = regex.compile(BYTE_LEVEL), False
    elif byte_level and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["invert"] and parts[0]["behavior"] == "Removed" and [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and not spaced:
        pattern, lower = regex.compile(parts[0]["pattern"]["Regex"]), True
    else:
        return ChunkCache(whole, lambda _, chunk: whole(text_of(chunk)))
    find, plain = pattern.findall, PLAIN
    space = chars[32]

    def spell(piece: str) -> str:
        if piece.isascii():
            if piece.isalpha():
                return piece
            if piece[:1] == " " and piece[1:].isalpha():
                return space + piece[1:]
        return piece.encode().decode("latin-1").translate(spelled)

    def model_ids(piece: str) -> bytes:
        return as_bytes([t.id for t in tokenize(spell(piece))])

    def chunk_of(piece: str) -> str:
        return piece if not spaced else piece[1:] if piece[:1] == " " else FIRST + piece

    def one(cache: ChunkCache, chunk: str) -> bytes:
        text = text_of(chunk)
        if not plain(text) or mark in text and any(map(text.__contains__, added)):
            return whole(text)
        if lower:
            text = text.lower()
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():
            return model_ids(text)
        out = []
        for piece in find(text):
            ids = cache.get(key := chunk_of(piece))
            if ids is None:
                ids = model_ids(piece)
                if len(key) <= CACHE_CHARS:
                    cache[key] = ids
            out.append(ids)
        return b"".join(out)

    def word_ids(words: list[str]) -> list[bytes]:
        spelling = letters[np.frombuffer("\0".join(map(text_of, words)).encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(by_words.encode_batch_fast([spelling], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == between)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), len(data)], strict=True)]

    letters = np.array(list(map(ord, chars)), "<u2")
    cache = ChunkCache(whole, one)
    cache.apart = lower and not any(re.fullmatch(f"[{LETTERS}.,]+", t) for t in added)
    # The model alone, on words that are spelled already and stand between bytes 0.
    between = tokenizer.token_to_id(chars[0])
    if spaced and between is not None and not any(re.fullmatch(rf"[{LETTERS}]*[{re.escape(string.punctuation)}]*", t) for t in added):
        by_words = Tokenizer(tokenizer.model)
        by_words.pre_tokenizer = pre_tokenizers.Split(chars[0], "isolated")
        cache.words = word_ids
    return cache


kept(library_cache.cache_clear)
