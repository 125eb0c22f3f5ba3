"""Media columns: clips stored as WAV, and audio features over them.

A clip is a byte payload, stored losslessly as unsigned 8-bit mono PCM in a
WAV file (``store``). ``features`` reads the stored bytes back and computes:

* polyphase resampling by up/down with a windowed-sinc filter, each output
  phase using only its own branch of the filter;
* overlapped log-mel filterbanks (Hann frames, power spectrum, triangular
  filters equally spaced in mel);
* hysteresis energy segmentation: a segment opens when a frame's level passes
  the upper threshold and closes when it falls below the lower one.

Log-mel frames are cut into blocks of one fixed shape, stored as an Arrow
fixed-shape tensor column with a time span for each block (as IPC bytes, see
``tensors``, since Spark's tables have no type of fixed shape), the last block
padded with the floor value.

Defined results: null or empty payload gives an empty clip (header only), no
block and no segment; equal bytes give equal values; long clips are framed in
pieces, so memory is a small multiple of one clip; repeated rows and null keys
pass through; columns other than the key, the payload and those in ``keep`` are
left out, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from tessella.llm.base import map_batches

RATE, UP, DOWN, TAPS = 16_000, 2, 3, 16
FRAME, HOP, MELS, BLOCK = 256, 128, 20, 32
FLOOR = np.float32(-12.0)
HEADER = 44


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM; an odd payload gets the pad byte that RIFF asks for."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def samples(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples) of a WAV file as ``wav`` writes it, any chunks before the data skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, RATE
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        if name == b"data":
            return rate, np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def branches(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """The polyphase branches (up x taps) of a Hann-windowed sinc low-pass."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(n * cut) * np.hanning(up * taps + 2)[1:-1]
    return (h * up / h.sum()).reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, bank: np.ndarray | None = None) -> np.ndarray:
    """Polyphase: output n uses branch (n * down) % up, at input n * down // up."""
    bank = branches(up, down) if bank is None else bank
    taps = bank.shape[1]
    length = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps + down, np.float32)])
    out = np.zeros(length, np.float32)
    for phase in range(min(up, length)):
        start, count = phase * down // up, -(-(length - phase) // up)
        acc = np.zeros(count, np.float32)
        for t in range(taps):
            acc += bank[phase * down % up, taps - 1 - t] * padded[start + t : start + t + (count - 1) * down + 1 : down]
        out[phase::up] = acc
    return out


def mel_filters(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


_WINDOW = np.hanning(FRAME).astype(np.float32)


def log_mel(y: np.ndarray, filters: np.ndarray, piece: int = 4096) -> np.ndarray:
    """(frames, mels); the last frame is filled with zeros."""
    if not len(y):
        return np.zeros((0, filters.shape[1]), np.float32)
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = []
    for at in range(0, n, piece):
        spectrum = np.fft.rfft(frames[at : at + piece] * _WINDOW)
        out.append(np.log(np.maximum((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ filters, np.exp(FLOOR))))
    return np.concatenate(out)


def segments(level: np.ndarray, high: float = 0.5, low: float = 0.2) -> list[tuple[int, int]]:
    """[first, last) frames of the segments; thresholds lie at these shares of the spread above the median level."""
    if not len(level):
        return []
    mid, top = float(np.median(level)), float(level.max())
    opens, stays = level > mid + high * (top - mid), level > mid + low * (top - mid)
    out: list[tuple[int, int]] = []
    cuts = np.flatnonzero(np.diff(np.concatenate([[0], stays.view(np.int8), [0]])))
    hits = np.concatenate([[0], np.cumsum(opens)])
    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
        if hits[b] > hits[a]:
            a += int(np.argmax(opens[a:b]))
            out.append((int(a), int(b)))
    return out


def tensor_bytes(mel: np.ndarray, seconds: float) -> bytes:
    """An IPC stream with start, end (seconds) and the block tensor."""
    n = -(-len(mel) // BLOCK)
    blocks = np.full((n, BLOCK, mel.shape[1]), FLOOR, np.float32)
    blocks.reshape(n * BLOCK, mel.shape[1])[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), (BLOCK, mel.shape[1]))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(blocks.ravel()), BLOCK * mel.shape[1])
    start = np.arange(n) * BLOCK * seconds
    batch = pa.RecordBatch.from_arrays([pa.array(start), pa.array(np.minimum(start + BLOCK * seconds, len(mel) * seconds)), pa.ExtensionArray.from_storage(kind, storage)], ["start", "end", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensors(data: bytes) -> pa.Table:
    """The table (start, end, log_mel fixed-shape tensor) behind a ``tensors`` value."""
    return pa.ipc.open_stream(data).read_all()


def features(clips: DataFrame, key: str = "doc_id", payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, the columns in ``keep``, media, tensors, frames, mel_mean array<double>, spans array<struct<start, end>>) for every payload."""

    def make():
        bank, rate_out = branches(), RATE * UP / DOWN
        filters, seconds = mel_filters(rate_out), HOP / rate_out

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            media, packed, frames, means, spans = [], [], [], [], []
            for value in batch.column(payload).to_pylist():
                media.append(wav(value or b""))
                _, raw = samples(media[-1])
                mel = log_mel(resample((raw.astype(np.float32) - 128) / 128, UP, DOWN, bank), filters)
                packed.append(tensor_bytes(mel, seconds))
                frames.append(len(mel))
                means.append(mel.mean(0, dtype=np.float64) if len(mel) else np.zeros(MELS))
                level = np.logaddexp.reduce(mel, axis=1) if len(mel) else np.zeros(0)
                spans.append([{"start": a * seconds, "end": b * seconds} for a, b in segments(level)])
            span = pa.struct([("start", pa.float64()), ("end", pa.float64())])
            columns = [*(batch.column(x) for x in (key, *keep)), pa.array(media, pa.binary()), pa.array(packed, pa.binary()), pa.array(frames, pa.int64()), pa.array(means, pa.list_(pa.float64())), pa.array(spans, pa.list_(span))]
            return pa.RecordBatch.from_arrays(columns, [key, *keep, "media", "tensors", "frames", "mel_mean", "spans"])

        return step

    span = StructType([StructField("start", DoubleType()), StructField("end", DoubleType())])
    schema = StructType([*(clips.schema[x] for x in (key, *keep)), StructField("media", BinaryType()), StructField("tensors", BinaryType()), StructField("frames", LongType()), StructField("mel_mean", ArrayType(DoubleType())), StructField("spans", ArrayType(span))])
    return map_batches(clips.select(key, *keep, payload), make, schema)


def decoded(media: Iterator[bytes]) -> Iterator[bytes]:
    """The payloads of stored clips."""
    for x in media:
        yield samples(x)[1].tobytes()
