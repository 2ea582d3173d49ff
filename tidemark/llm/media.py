"""Audio columns: WAV in a binary column, and fingerprints of pairs of spectral peaks.

A clip is cut into overlapping windows; a short-time Fourier transform gives each
window's spectrum, of which the strongest bin of each band is a peak if no
neighbouring window is louder there.  Each peak is paired with the next few; a pair's
code holds both frequencies and the time between, beside the time of the first.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

RATE = 8000
WINDOW = 128
HOP = 64
#: First bins of the bands, and the end.
BANDS = (1, 6, 16, 33, 65)
#: Windows whose spectra are held at once.
BLOCK_WINDOWS = 8192
#: Peaks that each peak is paired with, and the windows within which they must lie.
PARTNERS, REACH = 3, 63


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Bytes as one channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    """UTF-8 of a text with bytes 0 up to a positive multiple of unit, and its own length."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(-len(raw) % unit if raw else unit), len(raw)


def spectrum(samples: np.ndarray) -> np.ndarray:
    """Power of each window (rows) and bin; a short clip is one window, filled with silence."""
    if len(samples) < WINDOW:
        samples = np.concatenate([samples, np.zeros(WINDOW - len(samples), samples.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    spectra = np.fft.rfft(windows * np.hanning(WINDOW).astype(np.float32))
    return spectra.real**2 + spectra.imag**2


def peaks(samples: np.ndarray, zero: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Windows and bins of the spectral peaks, in order; zero is the samples' silence.

    Works through blocks of windows, each with a neighbour at both sides, so that a long
    clip takes little more memory than its peaks.
    """
    n = max((len(samples) - WINDOW) // HOP + 1, 1)
    times, bins = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for start in range(0, n, BLOCK_WINDOWS):
        stop = min(start + BLOCK_WINDOWS, n)
        low, high = max(start - 1, 0), min(stop + 1, n)
        power = spectrum(samples[low * HOP : (high - 1) * HOP + WINDOW].astype(np.float32) - np.float32(zero))
        found_t, found_f = [], []
        for first, end in zip(BANDS, BANDS[1:], strict=False):
            band = power[:, first:end]
            best = band.argmax(axis=1)
            loud = band[np.arange(len(band)), best]
            peak = loud > 1.0
            peak[1:] &= loud[1:] >= loud[:-1]
            peak[:-1] &= loud[:-1] > loud[1:]
            at = np.flatnonzero(peak[start - low : stop - low])
            found_t.append(at + start)
            found_f.append(best[at + start - low] + first)
        t, f = np.concatenate(found_t).astype(np.int32), np.concatenate(found_f).astype(np.int32)
        order = np.lexsort((f, t))
        times.append(t[order])
        bins.append(f[order])
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: np.ndarray, zero: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """times and codes of the peak pairs, in order of time; none for silence."""
    t, f = peaks(samples, zero)
    found_t, found_c = [], []
    for k in range(1, PARTNERS + 1):
        apart = t[k:] - t[:-k]
        near = apart <= REACH
        found_t.append(t[:-k][near])
        found_c.append((f[:-k][near] << 13 | f[k:][near] << 6 | apart[near]))
    t, c = np.concatenate(found_t), np.concatenate(found_c)
    order = np.lexsort((c, t))
    return t[order], c[order]


def wav_fingerprint(media: bytes) -> tuple[np.ndarray, np.ndarray]:
    """times and codes of an 8-bit mono WAV file."""
    return fingerprint(np.frombuffer(from_wav(media), np.uint8), 128.0)


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media binary: every whole text of docs(doc_id, text) as a WAV file.

    A null or empty text is 64 samples of byte 0.  Null ids and repeated rows are treated
    like any other row; other columns are ignored.
    """

    def make():
        def step(batch):
            made = [padded(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([to_wav(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_bytes long, media binary")


def fingerprints(media: DataFrame) -> DataFrame:
    """doc_id, times array<int>, codes array<int> of media(doc_id, media); a null clip has none."""

    def make():
        def step(batch):
            none = np.zeros(0, np.int32)
            found = [wav_fingerprint(m) if m is not None else (none, none) for m in batch.column(1).to_pylist()]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(t) for t, _ in found])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i] for x in found]))) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "times", "codes"])

        return step

    return map_arrow(media.select(F.col("doc_id").cast("long"), "media"), make, "doc_id long, times array<int>, codes array<int>")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, codes array<int>"


def digests(media: DataFrame) -> DataFrame:
    """What text_media stored, read back: digests of payload and file, and the fingerprint arrays themselves.

    times and codes are those of fingerprints(); feature is the SHA-256 of both
    (little-endian 32-bit, times first).  A null clip has null digests and empty arrays;
    null ids, repeated rows and long clips are treated like any other; an empty table
    gives no rows; other columns are ignored.
    """

    def make():
        none = np.zeros(0, np.int32)

        def step(batch):
            rows, arrays = [], []
            for doc_id, n, stored in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stored is None:
                    rows.append((doc_id, n, *[None] * 6))
                    arrays.append((none, none))
                    continue
                payload = from_wav(stored)
                t, c = wav_fingerprint(stored)
                feature = hashlib.sha256(t.astype("<i4").tobytes() + c.astype("<i4").tobytes()).hexdigest()
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
                arrays.append((t, c))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(t) for t, _ in arrays])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i] for x in arrays]))) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), *lists], names=names)

        return step

    names = [f.split()[0] for f in DIGEST.split(", ")]
    return map_arrow(media.select(F.col("doc_id").cast("long"), "n_bytes", "media"), make, DIGEST)
