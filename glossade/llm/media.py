"""Operator 2: media columns. Bytes as 8-bit WAV, read by the wave module; short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_texts, texts

RATE, FRAME, HOP = 8000, 256, 128
#: Frames transformed at once, so that memory does not grow with the recording.
BLOCK = 4096
#: Peaks looked for in each band of a frame, and later frames that a peak is paired with.
BANDS = ((1, 8), (8, 16), (16, 32), (32, 64), (64, 129))
FAN, REACH = 2, 6


def padded(payload: bytes, unit: int = 64) -> bytes:
    """payload with bytes 0 up to a positive multiple of unit."""
    return payload + bytes(-len(payload) % unit if payload else unit)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("8-bit mono is expected")
        return w.readframes(w.getnframes())


def spectrogram(samples: bytes, frame: int = FRAME, hop: int = HOP):
    """Log power by frame (blocks of at most BLOCK frames with their first frame's number); the end is filled with silence."""
    x = np.frombuffer(samples, dtype=np.uint8)
    frames = max(1, -(-max(0, len(x) - frame) // hop) + 1)
    window = np.hanning(frame).astype(np.float32)
    for at in range(0, frames, BLOCK):
        n = min(BLOCK, frames - at)
        part = x[at * hop : (at + n - 1) * hop + frame].astype(np.float32) - 128
        part = np.concatenate([part, np.zeros((n - 1) * hop + frame - len(part), dtype=np.float32)])
        cut = np.lib.stride_tricks.sliding_window_view(part, frame)[::hop]
        spectrum = np.fft.rfft(cut * window, axis=1)
        yield at, np.log1p(spectrum.real**2 + spectrum.imag**2)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of the spectral peaks, by frame: the loudest bin of each band that exceeds the recording's mean peak of that band."""
    best, loud = [], []
    for _, power in spectrogram(samples):
        best.append(np.stack([power[:, a:b].argmax(axis=1) + a for a, b in BANDS], axis=1))
        loud.append(np.stack([power[:, a:b].max(axis=1) for a, b in BANDS], axis=1))
    bins, level = np.concatenate(best), np.concatenate(loud)
    keep = level >= level.mean(axis=0, dtype=np.float64)
    t, band = np.nonzero(keep)
    return t, bins[t, band]


def fingerprints(samples: bytes) -> np.ndarray:
    """Landmarks as time-coded longs, in order: frame << 32 | first bin << 20 | second bin << 8 | frames between.

    A peak is paired with the first FAN peaks of later frames, at most REACH frames on.
    """
    t, f = peaks(samples)
    out = []
    after = np.searchsorted(t, t, side="right")
    for k in range(FAN):
        j = after + k
        ok = j < len(t)
        i, j = np.nonzero(ok)[0], j[ok]
        near = t[j] - t[i] <= REACH
        i, j = i[near], j[near]
        out.append(t[i].astype(np.int64) << 32 | f[i].astype(np.int64) << 20 | f[j].astype(np.int64) << 8 | (t[j] - t[i]))
    return np.sort(np.concatenate(out))


def media_columns(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, landmarks, and the WAV itself as media if wanted.

    A null or empty text is 64 zero samples. The payload columns come from the samples read back. feature holds the number
    of frames and landmarks and the landmarks' digest: equal texts, equal features. Rows that repeat stay; a null doc_id stays null.
    No shuffle.
    """

    def run(batch: pa.RecordBatch, values: list[str]):
        rows: list[list] = [[] for _ in range(9)]
        for v in values:
            raw = v.encode()
            stored = to_wav(padded(raw))
            back = from_wav(stored)
            marks = fingerprints(back)
            frames = max(1, -(-max(0, len(back) - FRAME) // HOP) + 1)
            feature = f"{frames}:{len(marks)}:{hashlib.blake2b(marks.astype('<i8').tobytes(), digest_size=16).hexdigest()}"
            for col, x in zip(rows, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, marks, stored if with_media else None)):
                col.append(x)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "landmarks", "media"]
        n = 9 if with_media else 8
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows[:n], kinds))], names=["doc_id", *names[:n]])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, landmarks array<long>"
    return map_texts(texts(docs), run, schema + ", media binary" * with_media)
