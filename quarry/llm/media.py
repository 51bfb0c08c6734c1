"""Media columns: payloads stored as WAV files in a binary column, and fingerprints of their spectra.

A payload is cut into 8-bit mono samples, written and read by the wave module. Short-time Fourier transforms give
spectral peaks; each peak is paired with the next few, and the pairs are kept as an array of time-coded integers.

Nulls and ties: a null text is empty, and an empty text becomes one frame of zero bytes. Equal payloads give equal
media and fingerprints; of equally high bins in a frame the lower one is the peak. Payloads of any length are taken
whole, in slabs of bounded size. Repeated rows stay; columns other than those named are not read.
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

from quarry.llm.common import map_arrow, slices

UNIT = 64
RATE = 8000
FRAME, HOP = 256, 128
#: Peaks are the highest bins of so many frequency bands in each frame; a peak is paired with those of the next frames.
BANDS = ((1, 8), (8, 24), (24, 64), (64, 128))
FAN_OUT = 2
#: Frames transformed at once: 4096 take some 20 MB.
SLAB = 4096


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Appends bytes 0 up to a positive multiple of unit."""
    return data + bytes((-len(data)) % unit or (0 if data else unit))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """The highest bin of each band in each frame of the short-time Fourier transform: int array (frames, bands)."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    padded = np.full((n - 1) * HOP + FRAME, 128, np.uint8)
    padded[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    out = np.empty((n, len(BANDS)), np.int64)
    for at in range(0, n, SLAB):
        slab = (frames[at : at + SLAB].astype(np.float32) - 128) * window
        power = np.abs(np.fft.rfft(slab, axis=1))
        power = np.round(power, 3)  # equal bins stay equal whatever the order of the sums
        for b, (low, high) in enumerate(BANDS):
            out[at : at + SLAB, b] = power[:, low:high].argmax(axis=1) + low
    return out


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Pairs of spectral peaks as time << 24 | first bin << 16 | second bin << 8 | distance in frames, by time."""
    found = peaks(samples)
    n = len(found)
    codes = [np.zeros(0, np.int64)]
    for gap in range(1, FAN_OUT + 1):
        if n > gap:
            first, second = found[:-gap], found[gap:]
            time = np.arange(n - gap, dtype=np.int64)[:, None]
            codes.append((time << 24 | first << 16 | second << 8 | gap).ravel())
    return np.sort(np.concatenate(codes))


def store(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a WAV file in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(pad(t)) for t in texts], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    docs = documents.select("doc_id", "text")
    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, prints): all from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for media in part.column("media").to_pylist():
                    payload = from_wav(media)
                    prints = fingerprints(np.frombuffer(payload, np.uint8))
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), prints))
                size, sha, tail, stored_size, stored_sha, prints = zip(*rows) if rows else ((),) * 6
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prints])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int64), *prints])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("n_bytes"), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64()),
                        pa.array(stored_size, pa.int64()), pa.array(stored_sha, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    ],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "prints"],
                )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return map_arrow(stored, run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, prints array<long>")
