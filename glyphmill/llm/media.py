"""Media columns: WAV through the wave module, short-time Fourier transforms, peak-pair fingerprints.

A payload is stored losslessly as unsigned 8-bit mono samples of a WAV file, read back from the
stored bytes, and fingerprinted: the spectrum of consecutive frames, in each of a few bands the
strongest bin of each frame where it stands out, and pairs of such peaks of one band a few frames
apart. A code holds, from the high bits, the frame (time), the band's first and second bin, and
the distance in frames; codes come ordered by time.

Null text counts as empty; the payload of an empty text is 64 zero bytes. Equal texts give equal
values, so repeated rows give repeated results; empty tables give empty ones; extra columns are ignored. Where two bins of a frame are
equally strong, the lower one is the peak. Rows go out in groups of about equal bytes. Frames are taken in blocks, so a very long text needs no more memory than its own size a few times.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import byte_slices

RATE = 8000
UNIT = 64
FRAME = 256
BLOCK_FRAMES = 4096
#: Bin ranges in which a frame has one peak at most.
BANDS = ((2, 24), (24, 64), (64, 129))
REACH = 3

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprints array<long>, media binary"

_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def store_wav(payload: bytes) -> bytes:
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(payload)
        return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def fingerprints(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs of 8-bit samples as int64."""
    x = np.frombuffer(samples, np.uint8)
    frames = -(-len(x) // FRAME)
    peaks = np.zeros((frames, len(BANDS)), np.int64)  # bin, 0 for none
    for a in range(0, frames, BLOCK_FRAMES):
        b = min(frames, a + BLOCK_FRAMES)
        part = np.zeros((b - a) * FRAME, np.float32)
        got = x[a * FRAME : b * FRAME]
        part[: len(got)] = got
        part = part.reshape(-1, FRAME)
        part -= part.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(part * _WINDOW, axis=1)) ** 2
        for k, (low, high) in enumerate(BANDS):
            band = power[:, low:high]
            best = band.argmax(axis=1)
            stands = band[np.arange(len(band)), best] > 4 * band.mean(axis=1) + 1e-3
            peaks[a:b, k] = np.where(stands, best + low, 0)
    codes = []
    for d in range(1, min(REACH, frames - 1) + 1):
        first, second = peaks[:-d], peaks[d:]
        t, k = np.nonzero((first > 0) & (second > 0))
        codes.append((t << 20) | (first[t, k] << 12) | (second[t, k] << 4) | d)
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): the WAV, figures of the bytes read back, and the fingerprint array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in byte_slices([len(t or "") + 1 for t in texts]):
                part = batch.slice(a, b - a)
                rows = []
                for text in texts[a:b]:
                    payload, n = payload_of(text)
                    media = store_wav(payload)
                    back = read_wav(media)
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), fingerprints(back), media if keep_media else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def with_feature(media: DataFrame) -> DataFrame:
    """The fingerprint array as a string: the number of pairs and the sha256 of the codes."""
    codes = F.array_join(F.col("fingerprints").cast("array<string>"), ",")
    return media.withColumn("feature", F.concat(F.size("fingerprints").cast("string"), F.lit(":"), F.sha2(codes, 256)))
