"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A file holds the ids of consecutive documents (ascending doc_id) as 16- or 32-bit
numbers, and two monotone lists in Elias-Fano code: where each document's ids begin,
and the documents' ids.  A list of n values up to u takes about n * (2 + log2(u / n))
bits; a sample of the positions of its ones answers select(i) without decoding the rest.

Layout (little-endian): magic, then unsigned 64-bit n_documents, n_null_ids, n_ids,
id_bytes, n_before (ids of the same part in the files before); the two lists; the ids.  A list: unsigned 64-bit n, base (two's complement),
low_bits, n_low_bytes, n_high_bytes, n_samples; then its low bits, its high bits, and
32-bit samples (bit position of each SAMPLE-th one).
"""

from __future__ import annotations

import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, scratch_path, stash
from .tokenizing import by_white_space, encode_together, library_cache

MAGIC = b"EFTOKEN1"
SAMPLE = 256
#: A file is closed when its ids reach this many bytes.
FILE_BYTES = 8 << 20
#: Texts that are encoded at once hold about this many bytes.
TEXT_BYTES = 8 << 20
END_ID = 2


class EliasFano:
    """A non-decreasing list of integers."""

    def __init__(self, base: int, low_bits: int, n: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.base, self.low_bits, self.n, self.low, self.high, self.samples = base, low_bits, n, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        base = int(values[0])
        v = values.view(np.uint64) - np.uint64(base % (1 << 64))
        span = int(v[-1])
        low_bits = max(0, (span // n).bit_length() - 1) if span else 0
        low = np.zeros(0, np.uint8)
        if low_bits:
            bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(base, low_bits, n, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, words of 64 bits are counted until its one is reached."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = start >> 3
        word = self._bits(self.high, byte, 8) >> (start & 7) << (start & 7)
        while left >= (ones := word.bit_count()):
            left -= ones
            byte += 8
            word = self._bits(self.high, byte, 8)
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        at = i * self.low_bits
        low = self._bits(self.low, at >> 3, (self.low_bits + 14) >> 3) >> (at & 7) & (1 << self.low_bits) - 1
        return self.base + ((one - i) << self.low_bits | low)

    @staticmethod
    def _bits(data: np.ndarray, byte: int, n: int) -> int:
        """n bytes, or those that are left, as a number."""
        return int.from_bytes(data[byte : byte + n].tobytes(), "little")

    def values(self) -> np.ndarray:
        i = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        high = (ones - i).astype(np.uint64) << np.uint64(self.low_bits)
        return ((high | self._low(i)) + np.uint64(self.base % (1 << 64))).view(np.int64)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.base % (1 << 64), self.low_bits, len(self.low), len(self.high), len(self.samples)], "<u8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        """A list at the start of data, and what follows it."""
        n, base, low_bits, n_low, n_high, n_samples = (int(x) for x in np.frombuffer(data[:48], "<u8"))
        base -= (base >> 63) << 64
        at = np.cumsum([48, n_low, n_high, 4 * n_samples])
        low, high = (np.frombuffer(data[at[k] : at[k + 1]], np.uint8) for k in (0, 1))
        return cls(base, low_bits, n, low, high, np.frombuffer(data[at[2] : at[3]], "<u4")), data[at[3] :]


def pack_file(doc_ids: list[int | None], ids: list[bytes], id_bytes: int, before: int = 0) -> bytes:
    """A file of documents in order (null ids first); ids as unsigned 32-bit bytes of each."""
    known = [d for d in doc_ids if d is not None]
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)
    head = np.array([len(doc_ids), len(doc_ids) - len(known), starts[-1], id_bytes, before], "<u8")
    body = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{id_bytes}")
    return MAGIC + head.tobytes() + EliasFano.of(starts).to_bytes() + EliasFano.of(np.array(known, np.int64)).to_bytes() + body.tobytes()


def open_file(data: bytes) -> tuple[list[int | None], EliasFano, np.ndarray, int]:
    """doc_ids, boundaries (n_documents + 1 of them), ids and n_before of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n, n_null, n_ids, id_bytes, before = (int(x) for x in np.frombuffer(data[8:48], "<u8"))
    starts, rest = EliasFano.read(memoryview(data)[48:])
    known, rest = EliasFano.read(rest)
    return [None] * n_null + known.values().tolist(), starts, np.frombuffer(rest, f"<u{id_bytes}", n_ids), before


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Token files of every whole text of docs(doc_id, text) in folder, and the table of the files.

    Documents go in ascending doc_id (null ids first, equal ids by a hash of the text);
    each is followed by end_id; a null or empty text is end_id alone.  Ids take 16 bits
    where the vocabulary allows.  Repeated rows are written repeatedly; an empty table
    gives no files.  folder is a URI that executors can write to; a task writes a file
    under another name and then renames it, so a repeated task only replaces its own.
    Returns file, part, number, n_documents, n_ids.
    """
    tail = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        cache = library_cache(tokenizer_path, False)
        store, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        held_docs: list = []
        held_ids: list[bytes] = []
        held, number, before = 0, 0, 0

        def close():
            largest = max((int(np.frombuffer(x, "<u4").max()) for x in held_ids), default=0)
            name = f"part-{part:06d}-{number:06d}.eft"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(other := f"{root}/_{name}.{uuid.uuid4().hex}") as f:
                f.write(pack_file(held_docs, held_ids, 2 if largest < 1 << 16 else 4, before))
            store.move(other, f"{root}/{name}")
            return pa.RecordBatch.from_pylist([{"file": name, "part": part, "number": number, "n_documents": len(held_docs), "n_ids": held // 4}], schema)

        for batch in batches:
            for some in by_bytes(batch, "text", TEXT_BYTES):
                doc_ids, texts = (c.to_pylist() for c in some.columns)
                for doc_id, ids in zip(doc_ids, encode_together(cache, by_white_space, [t or "" for t in texts]), strict=True):
                    held_docs.append(doc_id)
                    held_ids.append(ids + tail)
                    held += len(ids) + 4
                    if held >= 2 * FILE_BYTES:
                        yield close()
                        held_docs, held_ids, held, number, before = [], [], 0, number + 1, before + held // 4
        if held_docs:
            yield close()

    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("n_documents", pa.int64()), ("n_ids", pa.int64())])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long"), "text").withColumn("_tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    return stash(dealt.mapInArrow(run, "file string, part int, number int, n_documents long, n_ids long"), "token-files")


def read(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file of every document of the files that write() told of.

    Only the files in the table are opened, whatever else lies in the folder.  The bounds
    of a document are selected from its file's Elias-Fano list.  Null and repeated ids come
    back as they were written; no files give no rows.  Each file tells how many
    ids of its part come before it; what comes before a part is summed on the driver, from
    one row for each part.
    """
    spark = files.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"
    sums = sorted((r["part"], r["n"], r["files"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("files")).collect())
    if not sums:
        return spark.createDataFrame([], schema)
    before_part = {p: total - n for (p, n, _), total in zip(sums, accumulate(n for _, n, _ in sums), strict=True)}
    kinds = [pa.int64()] * 4 + [pa.string()]

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    doc_ids, boundaries, ids, before = open_file(f.read())
                before += before_part[part]
                for at in range(0, len(doc_ids), 4096):
                    some = doc_ids[at : at + 4096]
                    bounds = [boundaries.select(i) for i in range(at, at + len(some) + 1)]
                    rows = [(doc_id, before + x, y - x, zlib.crc32(ids[x:y].astype("<u4").tobytes()), name) for doc_id, x, y in zip(some, bounds, bounds[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    # A file for each task, as far as there are so many tasks.
    n = min(sum(k for *_, k in sums), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("part", "file").repartition(n, "file").mapInArrow(run, schema)


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Files in the session's shared folder, read back."""
    folder = scratch_path(docs.sparkSession, "ids")
    return read(write(docs, folder, tokenizer_path, end_id), folder)
