"""Audio features of media columns (operator 9).

A payload of 8-bit samples is stored as a WAV file in a binary column and read back from there.
Features: polyphase resampling to a lower rate, log-mel filterbanks over overlapped frames, and
segments of raised energy found with two thresholds (a segment begins above the high one and ends
below the low one).  Frames are grouped into windows of one fixed shape, stored as fixed-shape
tensors in Arrow files beside their time spans.

Each text is computed on its own, so equal texts have equal values whatever else is in the batch;
long ones are worked off in blocks.

Defined results: a null or empty text is 64 zero bytes; rows that repeat a doc_id are each in the
result; other columns do not matter.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._shared import new_folder, ready, store


@dataclass(frozen=True)
class Settings:
    rate: int = 16_000
    up: int = 5
    down: int = 8
    taps: int = 16  # of each phase
    frame: int = 256
    hop: int = 128
    mels: int = 24
    window: int = 32  # frames in a tensor
    low: float = 0.1  # thresholds above the mean energy, in deviations
    high: float = 0.5

    @property
    def rate_out(self) -> int:
        return self.rate * self.up // self.down


def wav(payload: bytes, rate: int) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def samples(media: bytes) -> bytes:
    """The samples of such a file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data":
            if kind is None or (kind[0], kind[1], kind[5]) != (1, 1, 8) or at + 8 + size > len(media):
                raise ValueError("not mono 8-bit samples")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@functools.cache
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """The low-pass filter of a rate change, one row a phase."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hamming(n) * up
    return np.ascontiguousarray(h.reshape(taps, up).T.astype(np.float32))


def resample(x: np.ndarray, s: Settings, block: int = 1 << 16) -> np.ndarray:
    """``x`` at up / down times its rate: each output takes the phase of the filter that it falls on."""
    h = phases(s.up, s.down, s.taps)[:, ::-1]
    n = -(-len(x) * s.up // s.down)
    padded = np.concatenate([np.zeros(s.taps - 1, np.float32), x, np.zeros(s.taps + s.down, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(padded, s.taps)
    out = np.empty(n, np.float32)
    for r in range(s.up):
        begin, count = r * s.down // s.up, len(range(r, n, s.up))
        for i in range(0, count, block):
            j = min(count, i + block)
            rows = views[begin + i * s.down : begin + (j - 1) * s.down + 1 : s.down]
            out[r + i * s.up : r + (j - 1) * s.up + 1 : s.up] = rows @ h[r * s.down % s.up]
    return out


@functools.cache
def filterbank(rate: int, frame: int, mels: int) -> np.ndarray:
    """Triangles spaced evenly in mel, one column each."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, s: Settings, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (frames x mels) and the log energy of each; the last frame is padded."""
    n = max(1, -(-(len(x) - s.frame) // s.hop) + 1)
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * s.hop + s.frame - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, s.frame)[:: s.hop][:n]
    taper, bank = np.hanning(s.frame).astype(np.float32), filterbank(s.rate_out, s.frame, s.mels)
    mel, energy = np.empty((n, s.mels), np.float32), np.empty(n, np.float32)
    for i in range(0, n, block):
        part = frames[i : i + block] * taper
        power = np.abs(np.fft.rfft(part)).astype(np.float32) ** 2
        mel[i : i + block] = np.log(power @ bank + 1e-6)
        energy[i : i + block] = np.log((part * part).sum(1) + 1e-6)
    return mel, energy


def segments(energy: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """Stretches of frames from one above the high threshold until one below the low."""
    mean, spread = float(energy.mean(dtype=np.float64)), float(energy.std(dtype=np.float64))
    mark = np.where(energy > mean + s.high * spread, 1, np.where(energy < mean + s.low * spread, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.concatenate([[0], np.where(last >= 0, mark[last], 0), [0]])
    turn = np.diff(on)
    return list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()))


def features(payload: bytes, s: Settings) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Tensors (windows x frames x mels, half precision), the time span of each, and segments."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x, s), s)
    n = -(-len(mel) // s.window)
    tensors = np.zeros((n * s.window, s.mels), np.float16)
    tensors[: len(mel)] = mel
    time = lambda f: round(f * s.hop / s.rate_out, 6)
    spans = [(time(i * s.window), time(min(len(mel), (i + 1) * s.window))) for i in range(n)]
    return tensors.reshape(n, s.window, s.mels), spans, [(time(a), time(b)) for a, b in segments(energy, s)]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length and UTF-8 of a text, filled with zeros to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data + b"\0" * (-len(data) % 64 or 64 * (not data))


def media(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes and the stored form (``media``, binary) of every whole text."""
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            made = [payload_of(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([wav(p, s.rate) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return lean.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tensor_schema(s: Settings) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("begin_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", pa.fixed_shape_tensor(pa.float16(), (s.window, s.mels)))])


def describe(stored: DataFrame, s: Settings = Settings(), folder: str | None = None) -> DataFrame:
    """What the stored media hold, with their tensors written to Arrow files in ``folder``.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    n_windows, segments (begin and end in seconds) and tensor_file, the file in ``folder`` that has the
    row's tensors; files that no row names are left from tasks that were run again.  One pass, no
    shuffle.
    """
    spark = stored.sparkSession
    ready(spark)
    folder = folder or new_folder(spark, "tensors")

    def run(batches):
        writer = sink = None
        name = f"mel-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            rows, ids, spans, tensors = [], [], [], []
            for doc, n, data in zip(*[c.to_pylist() for c in batch.columns]):
                payload = samples(data)
                t, span, found = features(payload, s)
                ids += [doc] * len(span)
                spans += span
                tensors.append(t)
                mean = np.round(t.astype(np.float64).reshape(-1, s.mels).mean(0), 2).tolist()
                feature = f"w{len(span)};s{len(found)};" + ",".join(f"{x:g}" for x in mean) + ";" + hashlib.sha256(t.tobytes()).hexdigest()[:16]
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(span), [{"begin_s": a, "end_s": b} for a, b in found], name))
            if not rows:
                continue
            if writer is None:
                system, top = store(folder)
                system.create_dir(top, recursive=True)
                sink = system.open_output_stream(f"{top}/{name}")
                writer = pa.ipc.new_file(sink, tensor_schema(s), options=pa.ipc.IpcWriteOptions(compression="zstd"))
            tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(np.concatenate(tensors)))
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([a for a, _ in spans]), pa.array([b for _, b in spans]), tensor], schema=tensor_schema(s)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ROW.types)], schema=ROW)
        if writer is not None:
            writer.close()
            sink.close()

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_windows int, segments array<struct<begin_s: double, end_s: double>>, tensor_file string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


ROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_windows", pa.int32()), ("segments", pa.list_(pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())]))), ("tensor_file", pa.string())])
