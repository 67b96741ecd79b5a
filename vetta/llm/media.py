"""Media columns: bytes kept as 8-bit WAV, and spectral-peak pair fingerprints of the samples.

encode() appends a binary column with each payload as a WAV file; features()
reads such a column with the wave module, takes the short-time Fourier
transform of the samples, keeps the strongest bin of each frequency band in
each block of frames, and pairs every peak with the peaks of the next blocks.
A pair is stored with its time: arrays pair_time (block) and pair_code (both
bins, their bands and the distance in blocks). Equal samples give equal arrays.

Texts: null counts as empty and empty texts become 64 zero bytes. Each row is
read by itself, so order, ties, repeated rows and other columns don't matter. A
null media value has null results. A band without sound has its lowest bin as
peak, so silence has pairs too, the same for every silence of its length.
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

RATE = 8000
UNIT = 64
FRAME, HOP = 256, 128
BLOCK = 4  # frames
BANDS = (1, 11, 43, 129)  # bins where bands begin, and the end
REACH = 2  # blocks ahead that a peak is paired with
WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def padded(data: bytes) -> bytes:
    return data + bytes(UNIT - len(data) if len(data) < UNIT else -len(data) % UNIT)


def spectrum(samples: np.ndarray) -> np.ndarray:
    """Magnitudes, a row for each frame; samples shorter than a frame are padded with silence."""
    x = samples.astype(np.float32) - 128
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    # In slabs, so that a long recording needs no more memory than its samples.
    return np.concatenate([np.abs(np.fft.rfft(frames[k : k + 4096] * WINDOW, axis=1)).astype(np.float32) for k in range(0, len(frames), 4096)])


def peak_pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the pairs, in order of time, then code."""
    loud = spectrum(samples)
    blocks = -(-len(loud) // BLOCK)
    loud = np.maximum.reduceat(loud, np.arange(0, len(loud), BLOCK), axis=0)
    peaks = np.stack([lo + loud[:, lo:hi].argmax(axis=1) for lo, hi in zip(BANDS, BANDS[1:])], axis=1)
    # Peaks of neighbouring bands in one block are pairs too, so that short recordings have some.
    times = [np.arange(blocks, dtype=np.int32)] * (peaks.shape[1] - 1)
    codes = [(band << 20 | peaks[:, band] << 8 | peaks[:, band + 1]).astype(np.int32) for band in range(peaks.shape[1] - 1)]
    for ahead in range(1, REACH + 1):
        for band in range(peaks.shape[1]):
            first, second = peaks[: blocks - ahead, band] if ahead < blocks else peaks[:0, band], peaks[ahead:, band]
            times.append(np.arange(len(first), dtype=np.int32))
            codes.append((band << 20 | ahead << 16 | first << 8 | second).astype(np.int32))
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media, the padded text as WAV."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [to_wav(padded(x.as_buffer().to_pybytes() if x.is_valid else b"")) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", size.alias("n_bytes"), F.encode("text", "utf-8").alias("data")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pair_time array<int>, pair_code array<int>"


def features(stored: DataFrame) -> DataFrame:
    """What reading the media column of encode() gives: digests of both forms, and the peak pairs."""

    def one(media: bytes) -> tuple:
        payload = from_wav(media)
        times, codes = peak_pairs(np.frombuffer(payload, np.uint8))
        feature = hashlib.sha256(times.tobytes() + codes.tobytes()).hexdigest()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(times)}:{feature}", times, codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = [x.strip().split()[0] for x in FEATURES.split(",")]
        for batch in batches:
            rows = [one(x.as_buffer().to_pybytes()) if x.is_valid else (None,) * 8 for x in batch.column(2)]
            cols = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def media_features(docs: DataFrame) -> DataFrame:
    return features(encode(docs))
