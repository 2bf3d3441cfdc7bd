"""Media columns: WAV bytes in a column, short-time spectra, and peak-pair fingerprints.

A payload is stored as the samples of a mono 8-bit WAV file, written and read by the
``wave`` module. Spectra are taken over frames of ``FRAME`` samples every ``HOP``;
each frame's strongest bin in each of two bands is a peak if it stands out of its band.
A peak is paired with the next ``FAN_OUT`` peaks, and a pair becomes the number
``time << 32 | bin << 20 | later bin << 8 | distance``: an array coded by time.

Rows: one result for each input row, repeated rows alike. A null or empty text is a
payload of padding alone. An empty table gives no row. Extra columns are left behind.
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

from weftgraph.llm import arrowkit

UNIT = 576
PAD = 255
TAIL = 32
RATE = 8000
FRAME = 576
HOP = 288
BANDS = ((4, 72), (72, 288))
STANDS_OUT = 4.0
FAN_OUT = 2
_FRAMES = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes) -> bytes:
    """``data`` and padding up to a positive multiple of ``UNIT``."""
    return data + bytes([PAD]) * (-len(data) % UNIT if data else UNIT)


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


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of each spectral peak, by frame and then bin."""
    n = max(0, (len(samples) - FRAME) // HOP + 1)
    times, bins = [], []
    for at in range(0, n, _FRAMES):  # long media in blocks
        m = min(_FRAMES, n - at)
        part = samples[at * HOP : (at + m - 1) * HOP + FRAME].astype(np.float32) - 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)) ** 2
        for low, high in BANDS:
            band = power[:, low:high]
            top = band.argmax(1)
            out = band[np.arange(m), top] > STANDS_OUT * (band.mean(1) + 1e-6)
            times.append(at + np.flatnonzero(out))
            bins.append(low + top[out])
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, b = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((b, t))
    return t[order].astype(np.int64), b[order].astype(np.int64)


def fingerprint(payload: bytes) -> np.ndarray:
    """Time-coded pairs of peaks, ascending."""
    t, b = peaks(np.frombuffer(payload, np.uint8))
    pairs = []
    for k in range(1, FAN_OUT + 1):
        if len(t) > k:
            gap = np.minimum(t[k:] - t[:-k], 255)
            pairs.append(t[:-k] << 32 | b[:-k] << 20 | b[k:] << 8 | gap)
    return np.sort(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)


MEDIA = "doc_id long, n_bytes long, media binary"
_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, fingerprint array<long>"
)
_FEATURES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
        ("fingerprint", pa.list_(pa.int64())),
    ]
)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrowkit.sliced(batches, 64):
        data = [x.encode("utf-8", "surrogatepass") for x in arrowkit.strings(batch, "text")]
        yield arrowkit.emit(
            {
                "doc_id": arrowkit.strings(batch, "doc_id"),
                "n_bytes": [len(x) for x in data],
                "media": [to_wav(padded(x)) for x in data],
            },
            _MEDIA,
        )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrowkit.sliced(batches, 64):
        rows: dict[str, list] = {k: [] for k in _FEATURES.names}
        rows["doc_id"], rows["n_bytes"] = (arrowkit.strings(batch, k) for k in ("doc_id", "n_bytes"))
        for media in arrowkit.strings(batch, "media"):
            payload = from_wav(media)
            pairs = fingerprint(payload)
            rows["payload_bytes"].append(len(payload))
            rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            rows["tail_crc32"].append(zlib.crc32(payload[-TAIL:]))
            rows["media_bytes"].append(len(media))
            rows["media_sha256"].append(hashlib.sha256(media).hexdigest())
            rows["feature"].append(f"{len(pairs)}:{hashlib.sha256(pairs.astype('<i8').tobytes()).hexdigest()[:32]}")
            rows["fingerprint"].append(pairs)
        yield arrowkit.emit(rows, _FEATURES)


def media_column(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and the WAV file of each text as a column."""
    arrowkit.small_batches(docs.sparkSession)
    return arrowkit.texts_of(docs, "doc_id").mapInArrow(_store, MEDIA)


def features(media: DataFrame) -> DataFrame:
    """Read the stored files back and take their fingerprints."""
    arrowkit.small_batches(media.sparkSession)
    return media.mapInArrow(_read, FEATURES)
