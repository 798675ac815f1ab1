"""Media columns: texts' bytes as 8-bit WAV, short-time Fourier transform, spectral-peak pair fingerprints.

Stored form: one channel, one byte a sample, 8000 samples a second, written and read by the ``wave``
module. Frames of 512 samples, half overlapping, Hann window, zeros after the end, so that every byte is in frames;
payloads under 768 bytes have frames 32 samples apart. In every frame the strongest local
maxima of the magnitude spectrum are its peaks; each peak is paired with the peaks of the next frames.
A pair is coded as one integer, time first: ``frame << 20 | bin << 11 | other bin << 2 | frames between``,
so a fingerprint is a sorted array that can be cut by time.

Defined results: null and empty texts are 64 zero bytes (no peaks, so an empty array); silent frames have
no peaks; equal magnitudes go to the lower bin; repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

FRAME, HOP, PEAKS, REACH, RATE = 512, 256, 2, 3, 8000
#: Of payloads under FRAME + HOP bytes, which also get half a frame of zeros in front.
SHORT_HOP = 32
#: Frames transformed at once, which bounds the memory for a long text.
BLOCK = 2048
WINDOW = np.hanning(FRAME).astype(np.float32)

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, fingerprint array<long>"
)


def payload_of(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


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


def spectral_peaks(samples: np.ndarray) -> np.ndarray:
    """frames x PEAKS bins of the strongest local maxima, -1 where there is none."""
    hop = HOP
    if len(samples) < FRAME + HOP:
        hop, samples = SHORT_HOP, np.concatenate([np.zeros(FRAME // 2, samples.dtype), samples])
    n = -(-len(samples) // hop)  # the last sample is in the first half of the last frame
    samples = np.concatenate([samples, np.zeros((n - 1) * hop + FRAME - len(samples), samples.dtype)])
    found = np.full((n, PEAKS), -1, np.int64)
    for at in range(0, n, BLOCK):
        many = min(BLOCK, n - at)
        part = samples[at * hop : (at + many - 1) * hop + FRAME]
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::hop].astype(np.float32)
        frames -= frames.mean(axis=1, keepdims=True)
        spectrum = np.fft.rfft(frames * WINDOW, axis=1)
        power = np.floor(np.abs(spectrum)).astype(np.float32)  # whole numbers: far coarser than rounding errors
        inner = power[:, 1:-1]
        rises = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        rows = np.arange(many)
        for k in range(PEAKS):
            best = rises.argmax(axis=1)
            height = rises[rows, best]
            found[at : at + many, k] = np.where(height > 0, best + 1, -1)
            rises[rows, best] = 0
    return found


def pair_fingerprint(peaks: np.ndarray) -> np.ndarray:
    """Sorted time-coded pairs of peaks."""
    codes = []
    for gap in range(1, REACH + 1):
        a, b = peaks[:-gap], peaks[gap:]
        time = np.arange(len(a))
        for i in range(PEAKS):
            for j in range(PEAKS):
                ok = (a[:, i] >= 0) & (b[:, j] >= 0)
                codes.append((time[ok] << 20) | (a[ok, i] << 11) | (b[ok, j] << 2) | gap)
    return np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def describe(data: bytes) -> tuple:
    """What SCHEMA lists after doc_id."""
    media = to_wav(payload_of(data))
    back = from_wav(media)
    codes = pair_fingerprint(spectral_peaks(np.frombuffer(back, np.uint8)))
    feature = f"pairs={len(codes)};sha256={hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()[:32]}"
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, codes


def _describe_batches(batches):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", ")[1:])]
    for batch in batches:
        rows = [describe(x.as_py().encode()) for x in batch.column("text")]
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        ends = np.cumsum([0, *(len(r[7]) for r in rows)]).astype(np.int32)
        flat = np.concatenate([r[7] for r in rows]) if rows else np.zeros(0, np.int64)
        codes = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols, codes], names)


def media_columns(docs: DataFrame) -> DataFrame:
    """One row for each document; a map, so nothing is shuffled."""
    common.small_batches(docs.sparkSession)
    return common.texts(docs).mapInArrow(_describe_batches, SCHEMA)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(common.table(spark, sf_dir, "documents"))
