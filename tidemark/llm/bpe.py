"""Byte-level BPE run by sentencepiece, on a model built from a rank file.

No training takes place: the model is written field by field.  Each token's bytes
are mapped to printable characters (one per byte), its score is its negative rank,
normalisation is the identity.  sentencepiece then merges the neighbours of lowest
rank first, leftmost on ties, as byte-level BPE does.  Decoding inverts the mapping.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_arrow
from .tokenizing import CACHE_CHARS, CACHE_CHUNKS, after_space, as_bytes, by_spaces, byte_characters


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; ranks must be 0..n-1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes | None] = [None] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if None in tokens:
        raise ValueError("ranks are not 0..n-1")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; piece i + 1 is token i, piece 0 the unknown piece it insists on."""
    chars = byte_characters()
    unknown = "⁇unk⁇"
    pieces = [_field(1, unknown.encode()) + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(rank)) for rank, t in enumerate(tokens)]
    # Trainer: BPE (2), vocabulary size, no other control pieces, the unknown piece's string.
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43)) + _field(45, unknown.encode())
    # Normaliser: identity, no dummy prefix, white space neither removed nor escaped.
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.pattern = regex.compile(pattern)
        self.table = {b: c for b, c in enumerate(byte_characters()) if chr(b) != c}
        self.cache: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Each match of the pattern on its own, all matches of all texts in one call."""
        found = [self.pattern.findall(x) for x in texts]
        flat = [m.encode("utf-8", "replace").decode("latin-1").translate(self.table) for ms in found for m in ms]
        ids = iter(self.processor.encode(flat, num_threads=1) if flat else [])
        return [as_bytes([i - 1 for _ in ms for i in next(ids)]) for ms in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit bytes; new chunks of all of them are encoded together."""
        chunked = [by_spaces(t) if t else [] for t in texts]
        known = set().union(*(c for c in chunked if c))
        if len(self.cache) + len(known) > CACHE_CHUNKS:
            self.cache.clear()
        new = list(known.difference(self.cache))
        self.cache.update(zip(new, self._encode([after_space(c) for c in new]), strict=True))
        whole = iter(self._encode([t for t, c in zip(texts, chunked, strict=True) if c is None]))
        out = [next(whole) if c is None else b"".join(map(self.cache.__getitem__, c)) for c in chunked]
        for c in new:
            if len(c) > CACHE_CHARS:
                del self.cache[c]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


kept(codec.cache_clear)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text of docs(doc_id, text).

    A null or empty text has no ids.  Null ids and repeated rows are encoded like any
    other row; other columns are ignored.
    """

    def make():
        bpe = codec(path, pattern)

        def step(batch):
            ids = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"])

        return step

    return map_arrow(_input(docs), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded binary of encoded(doc_id, ids); null ids count as none."""

    def make():
        bpe = codec(path, pattern)

        def step(batch):
            found = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "decoded"])

        return step

    return map_arrow(encoded.select(F.col("doc_id").cast("long"), "ids"), make, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 of every whole text.

    encode and decode in one pass, keeping digests only; edge cases as in encode.
    """

    def make():
        bpe = codec(path, pattern)
        decimal = [str(i) for i in range(len(bpe.tokens))]

        def step(batch):
            rows = []
            for ids in bpe.encode([t or "" for t in batch.column(1).to_pylist()]):
                numbers = np.frombuffer(ids, "<u4").tolist()
                joined = " ".join(map(decimal.__getitem__, numbers)).encode()
                rows.append((len(numbers), hashlib.sha256(joined).hexdigest(), hashlib.sha256(bpe.decode(numbers)).hexdigest()))
            n, ids_sha, decoded_sha = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_arrow(_input(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
