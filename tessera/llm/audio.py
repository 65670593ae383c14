"""Media columns: texts stored as 8-bit PCM audio, and audio features of the stored bytes.

Storage is a RIFF/WAVE container with unsigned 8-bit mono samples, one sample a byte, hence lossless. Features come from
the bytes read back: polyphase resampling by 2/5 (windowed-sinc, one phase per output residue), overlapped frames
(Hann), log-mel filterbank energies, and segments of active sound by two-threshold hysteresis on frame energy. The
log-mel frames of a clip are tensors of the fixed shape (32 frames, 16 mels), zero-padded at the end, each with its time
span; a document's clips are stored as one Arrow IPC stream whose log_mel column is Arrow's fixed-shape tensor type
(`tensor_table` writes and reads it), in a binary column that any executor writes and any reader opens.

One Arrow pass a step, no shuffle. Resampling, frames and spectra are computed in blocks of frames straight from the stored
bytes, so beside the media a document takes 68 bytes a frame (160 bytes of text) and its tensors.

Defined cases: null and empty texts store 64 zero bytes; null media have null features; a null doc_id is kept; repeated
rows are each returned, equal texts with equal values; a table without rows gives no rows; only the columns named are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import written

RATE, UP, DOWN = 16_000, 2, 5
FRAME, HOP, MELS, SHAPE = 160, 64, 16, (32, 16)
BLOCK = 1 << 12  # frames at a time
OUT = 1 << 24  # bytes of tensors in a batch


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with 0 to a positive multiple of 64, and their number before."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def write_wave(payload: bytes, rate: int = RATE) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def read_wave(media: bytes) -> tuple[bytes, int]:
    """Samples and rate; walks the chunks, so other writers' files are read as well."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("expected 8-bit mono PCM")
        if name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _phases(taps: int = 12) -> np.ndarray:
    """FIR of the resampler split in phases: row r has the taps for outputs with index = r mod UP."""
    n = np.arange(-taps * UP, taps * UP + 1)
    cut = 1 / max(UP, DOWN)
    h = cut * np.sinc(n * cut) * np.hanning(len(n)) * UP
    rows = []
    for r in range(UP):
        offset = (r * DOWN) % UP  # the output sits this many fine steps after an input sample
        k = np.arange(-taps, taps + 1)
        fine = offset - k * UP
        inside = np.abs(fine) <= taps * UP
        rows.append(np.where(inside, h[np.clip(fine + taps * UP, 0, len(h) - 1)], 0))
    return np.array(rows, np.float32)


_FIR = _phases()
_REACH = _FIR.shape[1] // 2


def _mel_bank(rate: float) -> np.ndarray:
    to_mel, from_mel = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = from_mel(np.linspace(to_mel(40), to_mel(rate / 2), MELS + 2))
    freqs = np.linspace(0, rate / 2, FRAME // 2 + 1)
    up = (freqs[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - freqs[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


_BANK = _mel_bank(RATE * UP / DOWN)
_HANN = np.hanning(FRAME).astype(np.float32)


def resample(samples: np.ndarray, first: int = 0, stop: int | None = None) -> np.ndarray:
    """Unsigned 8-bit samples -> float32 at UP/DOWN of the rate, outputs [first, stop), first a multiple of UP; output j is
    centred on input j*DOWN/UP, and there is silence around the samples."""
    total = -(-len(samples) * UP // DOWN)
    stop = total if stop is None else min(stop, total)
    n = max(0, stop - first)
    out = np.empty(n, np.float32)
    low, high = first * DOWN // UP - _REACH, (stop * DOWN) // UP + _REACH + DOWN + 1
    x = np.zeros(max(0, high - low), np.float32)
    a, b = max(0, low), min(len(samples), high)
    if b > a:
        x[a - low : b - low] = (samples[a:b].astype(np.float32) - 128) / 128
    if n:
        views = np.lib.stride_tricks.sliding_window_view(x, 2 * _REACH + 1)
        for r in range(UP):
            count = len(out[r::UP])
            out[r::UP] = views[r * DOWN // UP :: DOWN][:count] @ _FIR[r]
    return out


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels log energies, frame energies in dB) of overlapped frames of the resampled sound; a short tail is
    zero-padded."""
    length = -(-len(samples) * UP // DOWN)
    n = max(1, -(-max(0, length - FRAME) // HOP) + 1)
    mel, db = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for at in range(0, n, BLOCK):
        count = min(BLOCK, n - at)
        wave = resample(samples, at * HOP, at * HOP + (count - 1) * HOP + FRAME)
        padded = np.zeros((count - 1) * HOP + FRAME, np.float32)
        padded[: len(wave)] = wave
        block = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
        spectrum = np.fft.rfft(block * _HANN, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[at : at + count] = np.log(power @ _BANK + 1e-6)
        db[at : at + count] = 10 * np.log10((block * block).mean(axis=1) + 1e-9)
    return mel, db


def segments(db: np.ndarray, rise: float = 1.5, fall: float = 0.5) -> list[tuple[int, int]]:
    """Frame spans [start, end) of active sound: entered above median + rise dB, left below median + fall dB."""
    middle = float(np.median(db))
    state = np.where(db >= middle + rise, 1, np.where(db < middle + fall, 0, -1))
    decided = np.flatnonzero(state >= 0)
    at = np.searchsorted(decided, np.arange(len(db)), "right") - 1
    on = np.where(at >= 0, state[decided[np.maximum(at, 0)]] if len(decided) else 0, 0).astype(bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(payload: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    mel, db = log_mel(np.frombuffer(payload, np.uint8))
    return mel, db, segments(db)


def frame_ms(frame: int) -> int:
    """Start of a frame in milliseconds."""
    return round(frame * HOP * 1000 * DOWN / (RATE * UP))


_MEDIA = "doc_id long, media binary, n_bytes long"


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media, n_bytes): every whole text as a WAVE file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [payload_of(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([write_wave(p) for p, _ in made], pa.binary()), pa.array([n for _, n in made], pa.int64())], names=["doc_id", "media", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _MEDIA)


def clips(mel: np.ndarray, spans: list[tuple[int, int]]) -> dict[str, np.ndarray]:
    """The clips of SHAPE[0] frames: time span, activity and log_mel (n, *SHAPE)."""
    n = -(-len(mel) // SHAPE[0])
    tensors = np.zeros((n, *SHAPE), np.float32)
    tensors.reshape(-1, MELS)[: len(mel)] = mel
    active = np.zeros(n, bool)
    for a, b in spans:
        active[a // SHAPE[0] : -(-b // SHAPE[0])] = True
    starts = range(0, n * SHAPE[0], SHAPE[0])
    ms = [np.array([frame_ms(min(len(mel), s + d)) for s in starts], np.int64) for d in (0, SHAPE[0])]
    return {"start_ms": ms[0], "end_ms": ms[1], "active": active, "log_mel": tensors}


def tensor_table(found: dict[str, np.ndarray]) -> pa.Table:
    """Clips as an Arrow table with a fixed-shape tensor column."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(found["log_mel"].reshape(-1)), SHAPE[0] * SHAPE[1])
    tensor = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), SHAPE), flat)
    return pa.table([pa.array(found[c]) for c in ("start_ms", "end_ms", "active")] + [tensor], names=["start_ms", "end_ms", "active", "log_mel"])


def write_tensors(found: dict[str, np.ndarray]) -> bytes:
    """Clips as an Arrow IPC stream."""
    table, sink = tensor_table(found), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """The table of a stored stream, log_mel being a fixed-shape tensor column."""
    return pa.ipc.open_stream(stored).read_all()


_TENSORS = "doc_id long, clip int, start_ms long, end_ms long, active boolean, log_mel array<float>"


def audio_tensors(features: DataFrame) -> DataFrame:
    """Rows of (doc_id, tensors) -> one row per clip with its time span, activity and log_mel flattened to SHAPE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, stored in zip(batch.column(0), batch.column(1), strict=True):
                for part in read_tensors(stored.as_py()).to_batches():
                    n = part.num_rows
                    flat = part.column("log_mel").storage.flatten()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * SHAPE[0] * SHAPE[1], SHAPE[0] * SHAPE[1]), pa.int32()), flat)
                    rest = [part.column(c) for c in ("start_ms", "end_ms", "active")]
                    yield pa.record_batch([pa.array([doc.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), *rest, lists], names=["doc_id", "clip", "start_ms", "end_ms", "active", "log_mel"])

    return features.select(F.col("doc_id").cast("long"), "tensors").where("tensors is not null").mapInArrow(run, _TENSORS)


def summary(mel: np.ndarray, db: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """Features as text: frames, active segments and milliseconds, mean energy, mean and deviation of each mel band."""
    active = sum(frame_ms(b) - frame_ms(a) for a, b in spans)
    bands = ",".join(f"{m:.2f}/{s:.2f}" for m, s in zip(mel.mean(axis=0, dtype=np.float64), mel.std(axis=0, dtype=np.float64), strict=True))
    return f"frames={len(mel)};segments={len(spans)};active_ms={active};db={float(db.mean(dtype=np.float64)):.2f};mel={bands}"


def spans_text(spans: list[tuple[int, int]]) -> str:
    """Active segments as start-end in milliseconds, comma-joined."""
    return ",".join(f"{frame_ms(a)}-{frame_ms(b)}" for a, b in spans)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, active_ms string, n_clips int, tensors binary"


def media_features(media: DataFrame) -> DataFrame:
    """Of (doc_id, media, n_bytes): digests of the stored media and of what is read back from them, the features' summary,
    the active segments and the clips' tensors (`read_tensors`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary())
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "active_ms", "n_clips", "tensors"]
        for batch in batches:
            held: list[tuple[int, list]] = []
            weight = 0
            for at in range(batch.num_rows):
                blob = batch.column(1)[at].as_py()
                row: list = [None] * len(kinds)
                if blob is not None:
                    payload, _ = read_wave(blob)
                    mel, db, spans = features(payload)
                    found = clips(mel, spans)
                    row = [len(payload), sha(payload), zlib.crc32(payload[-64:]), len(blob), sha(blob), summary(mel, db, spans), spans_text(spans), len(found["active"]), write_tensors(found)]
                held.append((at, row))
                weight += len(row[-1] or b"")
                if weight >= OUT or at + 1 == batch.num_rows:
                    part = batch.slice(held[0][0], len(held))
                    columns = [pa.array([r[k] for _, r in held], kind) for k, kind in enumerate(kinds)]
                    yield pa.record_batch([part.column(0), part.column(2), *columns], names=["doc_id", "n_bytes", *names])
                    held, weight = [], 0

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").alias("media"), F.col("n_bytes").cast("long").alias("n_bytes")).mapInArrow(run, _FEATURES)


def stored_media(docs: DataFrame) -> DataFrame:
    """`to_media`, written to the shared folder and read back."""
    return written(to_media(docs), "media")
