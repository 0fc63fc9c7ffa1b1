"""Audio features (operator 8): samples in WAV bytes, polyphase resampling, overlapped log-mel filterbanks, and energy
segmentation with hysteresis. Features are kept as fixed-shape Arrow tensors with their time spans.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices

#: Bytes that a payload is a multiple of, and the byte that fills it up.
UNIT, FILL = 576, b"\xff"
#: Rate of the samples as stored, rate of the features, and taps of the low-pass filter on each side of its middle, by phase.
RATE, TARGET, TAPS = 16_000, 8_000, 8
#: Frames: samples, step, points of the transform, mel bands; frames in a tensor.
FRAME, HOP, POINTS, BANDS, TENSOR = 200, 80, 256, 24, 100
#: Segments begin where a frame's level is this much (in natural logarithm) above the quiet tenth, and end where it falls below the second.
ENTER, LEAVE = 0.6, 0.3
#: Samples that are transformed at a time.
CHUNK = 1 << 19


def stored(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of one channel with unsigned 8-bit samples: the payload, byte for byte."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def read_back(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV file of one channel with 8-bit samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit samples")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def phases(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """A windowed-sinc low-pass filter, cut into `up` phases; row p weighs the samples around an output of phase p."""
    widest = max(up, down)
    half = taps * widest
    t = np.arange(-half, half + 1)
    h = np.sinc(t / widest) * np.blackman(2 * half + 3)[1:-1]
    h *= up / h.sum()
    width = 2 * (half // up) + 2
    out = np.zeros((up, width), "float32")
    for p in range(up):
        for k in range(width):  # the sample k - width // 2 + 1 after the one at or before the output
            i = p - (k - width // 2 + 1) * up
            if -half <= i <= half:
                out[p, k] = h[i + half]
    return out


def resampled(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Polyphase resampling: only outputs that are kept are computed, each from its phase of the filter."""
    g = gcd(rate, target)
    up, down = target // g, rate // g
    if up == down or not len(samples):
        return samples.astype("float32")
    bank = phases(up, down)
    width = bank.shape[1]
    n = -(-len(samples) * up // down)
    padded = np.concatenate([np.zeros(width // 2 - 1, "float32"), samples.astype("float32"), np.zeros(width // 2 + 1, "float32")])
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(n, "float32")
    for r in range(min(up, n)):  # outputs r, r + up, ... are of one phase, and `down` samples apart
        at, p = divmod(r * down, up)
        out[r::up] = windows[at::down][: len(out[r::up])] @ bank[p]
    return out


@lru_cache(maxsize=4)
def filterbank(rate: int = TARGET, points: int = POINTS, bands: int = BANDS) -> np.ndarray:
    """Triangles that are even on the mel scale, by frequency and band."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, points // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype("float32")


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Natural logarithm of mel energies by frame and band; the last frames are filled up with silence."""
    frames = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + FRAME, "float32")
    padded[: len(samples)] = samples[: len(padded)]
    windows = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    window, bank = np.hanning(FRAME + 1)[:-1].astype("float32"), filterbank()
    out = np.empty((frames, BANDS), "float32")
    step = max(1, CHUNK // POINTS)
    for at in range(0, frames, step):
        spectrum = np.fft.rfft(windows[at : at + step] * window, POINTS)
        out[at : at + step] = np.log((spectrum.real**2 + spectrum.imag**2).astype("float32") @ bank + 1e-6)
    return out


def segments(level: np.ndarray, enter: float = ENTER, leave: float = LEAVE) -> list[tuple[int, int]]:
    """Runs of frames (first, end) that begin above `enter` and go on until below `leave`, both above the quiet tenth."""
    if not len(level):
        return []
    floor = np.partition(level, len(level) // 10)[len(level) // 10]
    # 1 above the upper, -1 below the lower threshold, 0 between: there the last of the others holds.
    state = np.where(level > floor + enter, 1, np.where(level < floor + leave, -1, 0))
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.where(last >= 0, state[np.maximum(last, 0)], -1) > 0
    turns = np.nonzero(np.diff(np.concatenate([[0], on.astype("int8"), [0]])))[0]
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def tensor_bytes(mel: np.ndarray, found: list[tuple[int, int]]) -> bytes:
    """An Arrow stream: tensors of TENSOR frames by BANDS with start and end in seconds; frames and segments (by frame and in seconds) in the schema's metadata."""
    count = -(-len(mel) // TENSOR)
    full = np.zeros((count, TENSOR, BANDS), "float32")
    full.reshape(-1, BANDS)[: len(mel)] = mel
    starts = np.arange(count) * TENSOR
    ends = np.minimum(starts + TENSOR, len(mel))
    spans = ",".join(f"{a * HOP / TARGET:.3f}-{b * HOP / TARGET:.3f}" for a, b in found)
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(full)
    notes = {"frames": str(len(mel)), "segments": spans, "segment_frames": ",".join(f"{a}-{b}" for a, b in found)}
    schema = pa.schema([("mel", tensors.type), ("start_s", pa.float64()), ("end_s", pa.float64())], notes)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as w:
        w.write_batch(pa.RecordBatch.from_arrays([tensors, pa.array(starts * HOP / TARGET), pa.array(ends * HOP / TARGET)], schema=schema))
    return sink.getvalue().to_pybytes()


def feature_of(blob: bytes) -> str:
    """From stored tensors: frames, segments by frame, and each band's mean level to two places."""
    with pa.ipc.open_stream(blob) as reader:
        batch, notes = reader.read_next_batch(), reader.schema.metadata
    frames = int(notes[b"frames"])
    mel = batch.column(0).to_numpy_ndarray().reshape(-1, BANDS)[:frames]
    levels = " ".join(f"{x + 0.0:.2f}" for x in np.round(mel.mean(0, dtype="float64"), 2))
    return f"{frames};{notes[b'segment_frames'].decode()};{levels}"


def analysed(media: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames and segments of a WAV file; depends on its bytes alone."""
    payload, rate = read_back(media)
    mel = log_mel(resampled((np.frombuffer(payload, "u1").astype("float32") - 128) / 128, rate, TARGET))
    return mel, segments(mel.mean(1))


#: What `audio` can return, and the types.
OUTPUTS = {
    "n_bytes": (T.LongType(), pa.int64()),
    "media": (T.BinaryType(), pa.binary()),
    "tensors": (T.BinaryType(), pa.binary()),
    "feature": (T.StringType(), pa.string()),
    "payload_bytes": (T.LongType(), pa.int64()),
    "payload_sha256": (T.StringType(), pa.string()),
    "tail_crc32": (T.LongType(), pa.int64()),
    "media_bytes": (T.LongType(), pa.int64()),
    "media_sha256": (T.StringType(), pa.string()),
    "tensor_bytes": (T.LongType(), pa.int64()),
    "tensor_sha256": (T.StringType(), pa.string()),
}
#: Those that come from the stored samples alone.
OF_SAMPLES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")


def _digests(wav: bytes) -> dict:
    payload, _ = read_back(wav)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    return dict(zip(OF_SAMPLES, (len(payload), sha(payload), zlib.crc32(payload[-32:]), len(wav), sha(wav))))


def audio(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("n_bytes", "media", "feature", "tensors")) -> DataFrame:
    """key and the named `columns` of OUTPUTS, a row for each row.

    `media` is a WAV file of the text's bytes, `tensors` an Arrow stream of fixed-shape log-mel tensors with time spans that is
    computed from the samples as read back, and `feature` comes from the tensors as read back. The digests are of these.
    A null or empty text is one unit of fill. Repeated rows and equal texts get equal values, an empty table gives an empty
    one, other columns are left out.
    """
    schema = T.StructType([docs.schema[key], *(T.StructField(c, OUTPUTS[c][0]) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]):
        for rows in slices(batches, 32):
            found: dict[str, list] = {c: [] for c in columns}
            for t in rows.column(1):
                raw = (t.as_py() or "").encode()
                wav = stored(raw + FILL * (-len(raw) % UNIT or (0 if raw else UNIT)))
                blob = tensor_bytes(*analysed(wav))
                values = {"n_bytes": len(raw), "media": wav, "tensors": blob, "feature": feature_of(blob), "tensor_bytes": len(blob), "tensor_sha256": hashlib.sha256(blob).hexdigest(), **_digests(wav)}
                for c, out in found.items():
                    out.append(values[c])
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(found[c], OUTPUTS[c][1]) for c in columns)], schema.names)

    return docs.select(key, F.col(text).alias("__text")).mapInArrow(run, schema)


def read_samples(media: DataFrame, keep: list[str], column: str = "media") -> DataFrame:
    """The columns `keep` and digests (OF_SAMPLES) of the samples in the WAV bytes of `column`, a row for each row.

    Null bytes give null digests; bytes that are no WAV file of 8-bit samples raise. Repeated rows stay repeated, an empty table
    gives an empty one, other columns are left out.
    """
    schema = T.StructType([*(media.schema[k] for k in keep), *(T.StructField(c, OUTPUTS[c][0]) for c in OF_SAMPLES)])

    def run(batches: Iterator[pa.RecordBatch]):
        for rows in slices(batches, 32):
            found = [_digests(m.as_py()) if m.is_valid else dict.fromkeys(OF_SAMPLES) for m in rows.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *(pa.array([x[c] for x in found], OUTPUTS[c][1]) for c in OF_SAMPLES)], schema.names)

    return media.select(*keep, F.col(column).alias("__media")).mapInArrow(run, schema)


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as samples and as tensors, both read back, as digests."""
    return audio(documents(spark, sf_dir), columns=("n_bytes", *OF_SAMPLES, "feature", "tensor_bytes", "tensor_sha256"))


QUERIES = {"op8_audio": op8_audio}
