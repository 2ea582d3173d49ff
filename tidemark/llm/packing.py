"""Packing without crossing documents: pieces of power-of-two lengths, bucketed by length.

A document of n ids is cut into n // 2**top pieces of 2**top ids and one piece for
each set bit of the rest, longest first.  Every piece is a sequence of its own, so
nothing is padded and no sequence holds two documents; a training job draws its
batches from one length bucket at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow
from .tokenizing import encode_spaced, library_cache

MAX_TOKENS = 2048
END_ID = 1
#: Bytes of texts that are encoded at once.
TEXT_BYTES = 8 << 20

_FIELDS = "start long, length long, bucket int, ids_crc32 long, doc_tokens long"


def piece_lengths(n: int, max_tokens: int = MAX_TOKENS) -> list[int]:
    """Lengths, in document order, of the pieces of n ids; max_tokens is a power of two."""
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    full, rest = divmod(n, max_tokens)
    return [max_tokens] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of every document of docs(doc_id, text), one row each.

    Columns: doc_id, start and length (in the document's ids, end id included), bucket
    (log2 of the length), ids_crc32, doc_tokens, ids array<int> (if with_ids),
    sequence_id (unique in this result), offset (always 0).

    A null or empty text is one piece holding the end id.  Repeated rows and null ids
    are packed like any other row, each into sequences of its own.  An empty table
    gives no pieces.  Other columns of docs are ignored.
    """
    piece_lengths(0, max_tokens)
    tail = np.asarray([end_id], "<u4").tobytes()

    def make():
        cache = library_cache(tokenizer_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            flat: list[bytes] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_spaced(cache, batch.column(1)), strict=True):
                ids += tail
                total = len(ids) // 4
                at = 0
                for n in piece_lengths(total, max_tokens):
                    piece = ids[4 * at : 4 * (at + n)]
                    out.append((doc_id, at, n, n.bit_length() - 1, zlib.crc32(piece), total))
                    flat.append(piece)
                    at += n
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([r[2] for r in out])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), "<u4").astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, names=names)

        return step

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "bucket", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    pieces = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, f"doc_id long, {_FIELDS}" + ", ids array<int>" * with_ids, lambda batch: by_bytes(batch, "text", TEXT_BYTES))
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces as Parquet, one folder per length, ready for same-length batches."""
    pieces.write.partitionBy("bucket").parquet(path)
