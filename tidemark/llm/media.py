"""Operator 3: media columns.

Bytes are stored as 8-bit samples in WAV files, held by a binary column of a
table. The stored files are read back by the wave module, and a short-time
Fourier transform over the samples gives spectral peaks, whose pairs are the
fingerprint: an array of numbers that code the time, the two frequencies and the
distance in time of each pair.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Samples between frames, and in a frame.
HOP, FRAME = 576, 1152
RATE = 8000
#: Peaks of a frame, next ones that a peak is paired with, and frames that these may be away.
PEAKS, FAN, REACH = 3, 4, 4
#: Least height of a peak over the mean of its frame.
HEIGHT = 2.0
#: Frames that are transformed at a time.
BLOCK = 512


def pad(data: bytes, unit: int = HOP) -> bytes:
    """The payload: bytes 255 are appended up to a positive multiple of ``unit``."""
    return data + b"\xff" * (-len(data) % unit or (0 if data else unit))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono file of 8-bit samples, one for each byte."""
    with wave.open(out := io.BytesIO(), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency of the peaks, at most ``PEAKS`` a frame, the highest of a frame first.

    A peak is higher than its neighbours and ``HEIGHT`` times the mean of its frame.
    """
    frames = max(1, (len(samples) - FRAME) // HOP + 1)
    if len(samples) < FRAME:
        samples = np.concatenate((samples, np.full(FRAME - len(samples), 255, dtype=samples.dtype)))
    window, times, found = np.hanning(FRAME), [], []
    views = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, frames, BLOCK):
        part = views[at : at + BLOCK].astype(np.float64)
        part = (part - part.mean(axis=1, keepdims=True)) * window
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        high = (inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > HEIGHT * power.mean(axis=1, keepdims=True) + 1e-3)
        height = np.where(high, inner, 0)
        best = np.argpartition(-height, PEAKS, axis=1)[:, :PEAKS]
        tall = np.take_along_axis(height, best, axis=1)
        order = np.lexsort((best, -tall), axis=1)
        best, tall = np.take_along_axis(best, order, axis=1), np.take_along_axis(tall, order, axis=1)
        t, k = np.nonzero(tall > 0)
        times.append(t + at)
        found.append(best[t, k] + 1)
    return np.concatenate(times), np.concatenate(found)


def landmarks(samples: np.ndarray) -> np.ndarray:
    """Codes of the pairs in order of time: time << 32 | first << 20 | second << 8 | distance in frames.

    A peak is paired with the ``FAN`` next ones, by time and height, up to ``REACH`` frames away.
    """
    times, bins = peaks(samples)
    codes = []
    for k in range(1, FAN + 1):
        other = np.arange(len(times)) + k
        ok = np.flatnonzero(other < len(times))
        ok = ok[times[other[ok]] - times[ok] <= REACH]
        first, second = ok, other[ok]
        codes.append((times[first] << 32) | (bins[first] << 20) | (bins[second] << 8) | (times[second] - times[first]))
    return np.sort(np.concatenate(codes)).astype(np.int64)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text (null: empty) as a WAV file."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for keys, texts in common.small_parts(batch, 1):
                data = [t or b"" for t in texts]
                yield pa.RecordBatch.from_arrays([keys, pa.array([len(d) for d in data], pa.int64()), pa.array([to_wav(pad(d)) for d in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """What the stored files hold, read back: digests of payload and file, and the fingerprint."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, n_pairs int, landmarks array<long>"
    )

    def one(media: bytes):
        payload = from_wav(media)
        codes = landmarks(np.frombuffer(payload, dtype=np.uint8))
        feature = f"{len(payload) // HOP}:{len(codes)}:{xxhash.xxh64_hexdigest(codes.astype('<i8').tobytes())}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(codes), codes.tolist()

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pairs", "landmarks"]
        for batch in batches:
            for keys, sizes, files in common.small_parts(batch, 2):
                cols = zip(*(one(f) for f in files), strict=True)
                yield pa.RecordBatch.from_arrays([keys, sizes, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return stored.mapInArrow(run, schema)


def media_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as a file in a media column, written to the shared folder, and read it back with features.

    Null and empty texts become one unit of padding. Equal texts give equal
    values; repeated rows are stored as often as they come. An empty table gives
    no rows. Other columns are ignored.
    """
    return features(common.materialize(store(docs, key, text), "media"))
