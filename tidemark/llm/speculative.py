"""BPE with word ends by speculation: propose, verify, and merge exactly only what fails.

A word's proposal is its greedy longest match against the vocabulary.  Merging by rank
gives exactly that proposal if no two neighbours of it would have merged across their
boundary, and whether two tokens would depends on these two alone: on the symbols that
face each other while both tokens come into being.  So a batch's different pairs are
verified together, by array lookups that walk both tokens' derivations backwards; the
words of clashing pairs, and only those, are merged symbol by symbol.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_arrow
from .tokenizing import CACHE_CHARS, CACHE_CHUNKS, PLAIN, as_bytes, by_white_space, byte_characters

_NEVER = np.iinfo(np.int64).max
_SHIFT = 32
_NONE = (_NEVER, -1)
#: Words of at most so many symbols are merged without a heap.
SHORT = 64
#: Symbols by which the longest token that may follow is looked up.
HEAD = 3


class Merges:
    """The merges of a BPE vocabulary, as arrays over token ids.

    parts are the two tokens that each token is merged from, rank the place of that merge
    (-1: a symbol, or not made by merging); sure tells the tokens that have one derivation,
    in order of rank, which merging their own symbols arrives at.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocabulary, self.suffix = vocabulary, suffix
        size = max(vocabulary.values(), default=-1) + 1
        self.parts = np.full((size, 2), -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        sure = np.ones(size, bool)
        for r, (a, b) in enumerate(merges):
            left, right, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if (left, right) in self.ranks:
                continue
            self.ranks[left, right] = (r, made)
            if self.rank[made] >= 0:
                sure[made] = False
            else:
                self.rank[made], self.parts[made] = r, (left, right)
        keys = np.array([a << _SHIFT | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array([r for r, _ in self.ranks.values()], np.int64)[order]
        made = np.flatnonzero(self.rank >= 0)
        left, right = self.parts[made].T
        sure[made] &= (self.rank[left] < self.rank[made]) & (self.rank[right] < self.rank[made]) & ~self.clash(left, right, self.rank[made])
        for t in made[np.argsort(self.rank[made])].tolist():
            sure[t] = sure[t] and sure[self.parts[t, 0]] and sure[self.parts[t, 1]]
        for text, t in vocabulary.items():
            if self.rank[t] < 0 and len(text.removesuffix(suffix) if suffix else text) != 1:
                sure[t] = False
        self.sure = sure
        self.inner = {t: i for t, i in vocabulary.items() if not (suffix and t.endswith(suffix) and len(t) > len(suffix))}
        self.last = vocabulary if not suffix else {t[: -len(suffix)]: i for t, i in vocabulary.items() if t.endswith(suffix) and len(t) > len(suffix)}
        self.longest = max(map(len, self.last), default=1)
        #: The longest inner token by its first symbols.
        self.reach: dict[str, int] = {}
        for t in self.inner:
            if len(t) >= HEAD:
                self.reach[t[:HEAD]] = max(self.reach.get(t[:HEAD], 0), len(t))

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of a with b; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int64)
        key = a << _SHIFT | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], -1)

    def clash(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = _NEVER) -> np.ndarray:
        """Whether merging the symbols of a and b would cross their boundary before rank until.

        Goes back in time: of the two symbols that face each other, the one made later is
        taken apart.  A merge of theirs comes first if its rank is below the merge that
        takes up the left one, and not above that of the right one (equal ranks go from
        left to right).
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_ends = np.full(len(x), until, np.int64) if np.isscalar(until) else until.astype(np.int64)
        y_ends = x_ends.copy()
        out = np.zeros(len(x), bool)
        at = np.arange(len(x))
        while len(at):
            m = self.pair_ranks(x, y)
            bad = (m >= 0) & (m < x_ends) & (m <= y_ends)
            out[at[bad]] = True
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            at, x, y, x_ends, y_ends, rx, ry = (v[go] for v in (at, x, y, x_ends, y_ends, rx, ry))
            undo_y = ry >= rx
            x_ends, y_ends = np.where(undo_y, x_ends, rx), np.where(undo_y, ry, y_ends)
            x, y = np.where(undo_y, x, self.parts[x, 1]), np.where(undo_y, self.parts[y, 0], y)
        return out

    def propose(self, word: str) -> list[int] | None:
        """The greedy longest match of a spelled word; None where a symbol has no token."""
        out, at, end = [], 0, len(word)
        inner, last, reach = self.inner.get, self.last.get, self.reach.get
        stop_at = end - 1 if self.suffix else end
        while at < end:
            if end - at <= self.longest and (token := last(word[at:])) is not None:
                out.append(token)
                return out
            for stop in range(min(at + reach(word[at : at + HEAD], HEAD - 1), stop_at), at, -1):
                if (token := inner(word[at:stop])) is not None:
                    out.append(token)
                    at = stop
                    break
            else:
                return None
        return out

    def merge(self, word: str) -> list[int]:
        """The word's tokens by merging: always the pair of lowest rank, the leftmost of equal ones.

        Symbols that have no token are left out.
        """
        symbols = [self.inner.get(c) for c in word]
        if word and self.suffix:
            symbols[-1] = self.last.get(word[-1])
        ids = [s for s in symbols if s is not None]
        if len(ids) <= SHORT:
            return self._merge_short(ids)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(found[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (found := self.ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i] = self.ranks[a, b][1]
            ids[j] = -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (found := self.ranks.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (found[0], left, ids[left], ids[right]))
        return [t for t in ids if t >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """As merge; looks over all pairs for each merge, which is fastest for a word of usual length."""
        found = self.ranks.get
        steps = [found(pair, _NONE) for pair in zip(ids, ids[1:], strict=False)]
        while steps:
            best = min(steps)
            if best is _NONE:
                break
            i = steps.index(best)
            ids[i : i + 2] = [best[1]]
            del steps[i]
            if i:
                steps[i - 1] = found((ids[i - 1], ids[i]), _NONE)
            if i < len(steps):
                steps[i] = found((ids[i], ids[i + 1]), _NONE)
        return ids

    def encode(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Tokens of each word, and how many words failed the check and were merged."""
        proposed = [self.propose(w) for w in words]
        sizes = np.array([len(p) if p else 0 for p in proposed], np.int64)
        flat = np.fromiter((t for p in proposed if p for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        fails = sizes == 0
        fails[owner[~self.sure[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, of = np.unique(flat[inside] << _SHIFT | flat[inside + 1], return_inverse=True)
        bad = self.clash(pairs >> _SHIFT, pairs & ((1 << _SHIFT) - 1))
        fails[owner[inside[bad[of]]]] = True
        out = [self.merge(w) if failed else p for w, p, failed in zip(words, proposed, fails.tolist(), strict=True)]
        return out, int(fails.sum())


class WordBpe:
    """Encoder and decoder of a tokenizers file of BPE with byte-level pieces.

    The file's own normaliser and splitter give the words; texts are cut at white space,
    which the splitter drops, and chunks met before come from a bounded cache.  Strings of
    added tokens in a text are these tokens, as in the library's default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            setup = json.load(f)
        model = setup["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or setup["decoder"]:
            raise ValueError("not a plain BPE file")
        steps = [s["type"] for s in (setup["normalizer"] or {}).get("normalizers", [])]
        parts = (setup["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"] or not parts[0]["invert"] or parts[0]["behavior"] != "Removed":
            raise ValueError("not a file that drops white space and lower-cases")
        added = setup["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens must be plain strings")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: np.asarray([t["id"]], "<u4").tobytes() for t in added}
        self.find_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.find_words = regex.compile(parts[0]["pattern"]["Regex"]).findall
        self.spelled = {b: c for b, c in enumerate(byte_characters()) if chr(b) != c}
        names = model["vocab"] | {t["content"]: t["id"] for t in added}
        self.tokens: list[str | None] = [None] * (max(names.values()) + 1)
        for name, i in names.items():
            self.tokens[i] = name
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.seen = self.failed = 0

    def _pieces(self, chunk: str) -> list[str]:
        """Spelled words of a chunk without added tokens."""
        if PLAIN(chunk):
            found = self.find_words(chunk.lower())
            return found if chunk.isascii() else [w.encode().decode("latin-1").translate(self.spelled) for w in found]
        return [w for w, _ in self.split(self.normalize(chunk))]

    def _parts(self, chunk: str) -> list[str | bytes]:
        """Spelled words, and the ids of added tokens as bytes."""
        if self.find_special is None or not self.find_special.search(chunk):
            return self._pieces(chunk)
        out, at = [], 0
        for m in self.find_special.finditer(chunk):
            out += [*self._pieces(chunk[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return out + self._pieces(chunk[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit bytes; new words of all of them are proposed and verified together."""
        chunked = [(by_white_space(t) if t else []) for t in texts]
        chunked = [[t] if c is None else c for t, c in zip(texts, chunked, strict=True)]
        wanted = set().union(*chunked)
        if len(self.cache) + len(wanted) > CACHE_CHUNKS:
            self.cache.clear()
        if len(self.words) > CACHE_CHUNKS:
            self.words.clear()
        parts = {c: self._parts(c) for c in wanted.difference(self.cache)}
        words = list({p for ps in parts.values() for p in ps if isinstance(p, str)}.difference(self.words))
        found, failed = self.merges.encode(words)
        self.seen, self.failed = self.seen + len(words), self.failed + failed
        self.words.update(zip(words, map(as_bytes, found), strict=True))
        known = self.words
        self.cache.update((c, known[ps[0]] if len(ps) == 1 and isinstance(ps[0], str) else b"".join([known[p] if isinstance(p, str) else p for p in ps])) for c, ps in parts.items())
        out = [b"".join(map(self.cache.__getitem__, c)) for c in chunked]
        for kept, new in ((self.cache, parts), (self.words, words)):
            for c in new:
                if len(c) > CACHE_CHARS:
                    del kept[c]
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as the library does for a file without a decoder; ids of no token are left out."""
        tokens = self.tokens
        return " ".join([t for i in ids if 0 <= i < len(tokens) and (t := tokens[i]) is not None])


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    """One per Python worker."""
    return WordBpe(path)


kept(codec.cache_clear)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text of docs(doc_id, text).

    A null or empty text has no ids.  Null ids and repeated rows are encoded like any
    other row; other columns are ignored; an empty table gives no rows.
    """

    def make():
        bpe = codec(path)

        def step(batch):
            ids = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))], names=["doc_id", "ids"])

        return step

    return map_arrow(_input(docs), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded string of encoded(doc_id, ids); null ids count as none."""

    def make():
        bpe = codec(path)

        def step(batch):
            found = [bpe.decode([i for i in ids or [] if i is not None]) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "decoded"])

        return step

    return map_arrow(encoded.select(F.col("doc_id").cast("long"), "ids"), make, "doc_id long, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit), decoded_sha256 (UTF-8) of every whole text.

    encode and decode in one pass, keeping digests only; edge cases as in encode.
    """

    def make():
        bpe = codec(path)

        def step(batch):
            rows = []
            for ids in bpe.encode([t or "" for t in batch.column(1).to_pylist()]):
                text = bpe.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            n, ids_sha, decoded_sha = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_arrow(_input(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
