"""Media columns: a text's bytes as 8-bit WAV samples, and spectral-peak pair fingerprints of what is stored."""

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

from .common import extended, in_arrow, named

UNIT, RATE = 64, 8000
#: Samples a frame, between frames; limits of the frequency bands; distances of paired frames.
FRAME, HOP, BANDS, AHEAD = 256, 128, (1, 8, 24, 56, 129), (1, 2)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes filled up with zeros to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def fingerprint(samples: bytes) -> np.ndarray:
    """Codes of spectral-peak pairs, each with its frame: frame * 2**20 + gap * 2**16 + bin * 2**8 + later bin.

    Per frame of a short-time Fourier transform the strongest bin of each band is a peak; it is paired with the peak of
    the same band one and two frames ahead. Silent pairs (both without energy) are left out.
    """
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1) if len(x) else 1
    x = np.pad(x, (0, (n - 1) * HOP + FRAME - len(x)))
    codes, window = [], np.hanning(FRAME).astype(np.float32)
    step = 4096  # frames at a time, for bounded memory with very long samples
    for at in range(0, n, step):
        upto = min(n, at + step + max(AHEAD))
        frames = np.lib.stride_tricks.sliding_window_view(x[at * HOP : (upto - 1) * HOP + FRAME], FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * window, axis=1))
        peaks = np.stack([power[:, a:b].argmax(1) + a for a, b in zip(BANDS, BANDS[1:])], 1).astype(np.int64)
        loud = np.stack([power[:, a:b].max(1) > 1e-3 for a, b in zip(BANDS, BANDS[1:])], 1)
        t = np.arange(at, upto, dtype=np.int64)[:, None]
        for gap in AHEAD:
            own = min(at + step, n) - at
            k = min(own, len(peaks) - gap)
            if k > 0:
                c = (t[:k] << 20) + (gap << 16) + (peaks[:k] << 8) + peaks[gap : gap + k]
                codes.append(c[loud[:k] | loud[gap : gap + k]])
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def text_to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes (UTF-8 length), media (binary WAV). Null text is stored as an empty one: UNIT zero samples."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = [payload_of(x) for x in part.column(1).to_pylist()]
                media = pa.array([to_wav(p) for _, p in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in rows], pa.int64()), media], names=[key, "n_bytes", "media"])

    return in_arrow(docs.select(named(key), named(text)), store, extended(docs, [key], "n_bytes long, media binary"))


def media_features(media: DataFrame, keep: list[str]) -> DataFrame:
    """Read the column ``media`` back with the wave module: keep, media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32, fingerprint, feature.

    fingerprint is an array of time-coded peak pairs (see fingerprint()); feature is its length and digest. A null
    media gives nulls.
    """
    names = ["media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "fingerprint", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string()]

    def one(stored: bytes | None) -> tuple:
        if stored is None:
            return (None,) * len(names)
        payload = from_wav(stored)
        codes = fingerprint(payload)
        sha = hashlib.sha256(codes.astype("<i8").tobytes()).hexdigest()
        return len(stored), hashlib.sha256(stored).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), codes, f"{len(codes)}:{sha}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = [one(x.as_py()) for x in part.column(len(keep))]
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *cols], names=[*keep, *names])

    schema = "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, fingerprint array<bigint>, feature string"
    return in_arrow(media.select(*map(named, keep), F.col("media")), read, extended(media, keep, schema))
