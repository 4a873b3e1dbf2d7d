"""Media columns: WAV in a binary column, short-time spectra, and fingerprints of spectral-peak pairs.

A fingerprint is a pair of arrays: times (frame of the earlier peak) and codes (earlier bin, later bin, distance in
frames, packed in 24 bits). Peaks are a frame's strongest bin where no neighbouring frame is stronger.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm.common import documents, saved, slices

BLOCK = 192  # payloads are padded to a multiple of this; also the frame length
HOP = 96
FAN = 3  # later peaks that each peak is paired with
REACH = 63  # and how many frames away they may be
RATE = 8000
WINDOW = np.hanning(BLOCK).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    """8-bit mono samples in a WAV container: the bytes as they are."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("expected 8-bit mono samples")
        return w.readframes(w.getnframes())


def peaks(payload: bytes, frames: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of each spectral peak; frames are transformed a block at a time, so memory is bounded."""
    x = np.frombuffer(payload, np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(x, BLOCK)[::HOP]
    bins, power = np.empty(len(view), np.int32), np.empty(len(view), np.float32)
    for i in range(0, len(view), frames):
        s = np.fft.rfft((view[i : i + frames].astype(np.float32) - 128) * WINDOW, axis=1)[:, 2:]  # without the mean
        m = s.real**2 + s.imag**2
        b = m.argmax(axis=1)
        bins[i : i + frames] = b + 2
        power[i : i + frames] = m[np.arange(len(b)), b]
    wide = np.concatenate([[-1], power, [-1]])
    at = np.flatnonzero((power >= wide[:-2]) & (power > wide[2:]))
    return at.astype(np.int32), bins[at]


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """times, codes in order of time, then of the later peak."""
    at, bins = peaks(payload)
    times, codes = [], []
    for k in range(1, FAN + 1):
        gap = at[k:] - at[:-k]
        near = gap <= REACH
        times.append(at[:-k][near])
        codes.append((bins[:-k][near] << 16) | (bins[k:][near] << 8) | gap[near])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.argsort(t, kind="stable")
    return t[order].astype(np.int32), c[order].astype(np.int32)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8, padded with blanks to a positive multiple of BLOCK, as WAV.

    Null and empty texts give one block of blanks; very long ones are encoded whole, in memory that follows the longest
    text. Repeated rows stay repeated, a null id stays null; other columns are ignored; an empty table gives no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            raw = [t or b"" for t in texts]
            media = [to_wav(t.ljust(max(BLOCK, -(-len(t) // BLOCK) * BLOCK))) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def describe_media(media: DataFrame) -> DataFrame:
    """Digests and fingerprints (fp_times, fp_codes) from the stored bytes alone; feature names a fingerprint."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fp_times", "fp_codes", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stored in slices(batches, "media"):
            rows = []
            for id_, n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), stored):
                p = from_wav(m)
                times, codes = fingerprint(p)
                feature = f"{len(times)}:{hashlib.sha256(times.tobytes() + codes.tobytes()).hexdigest()}"
                rows.append((id_, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), times, codes, feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fp_times array<int>, fp_codes array<int>, feature string"
    return media.mapInArrow(describe, schema)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = saved(encode_media(documents(spark, sf_dir)), "media")
    return describe_media(stored)
