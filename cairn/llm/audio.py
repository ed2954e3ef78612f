"""Media columns: bytes as 8-bit PCM audio, polyphase resampling, overlapped log-mel frames, energy segments.

The payload is stored as a WAV file of unsigned 8-bit samples. Features are computed from the file as read
back: rational resampling by a polyphase FIR, Hann frames with half overlap, a mel filterbank in log energy,
and hysteresis segmentation of the frames' energy. Log-mel frames are stored as fixed-shape Arrow tensors of
`frames` x `mels`, each with its time span and number of valid frames, in an Arrow IPC stream.

Defined results: null text is empty; every payload is padded with zeros to a positive multiple of 64, so the
shortest audio has 64 samples and one frame; equal texts give equal values; repeated rows come back once each;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

PAD = 64
SLICE = 8 << 20


@dataclass(frozen=True)
class AudioSpec:
    rate: int = 16000
    target: int = 8000
    half_taps: int = 8
    window: int = 256
    hop: int = 128
    mels: int = 24
    frames: int = 64
    #: Segments begin over mean + high x deviation of the frames' log energy and end under mean + low x deviation.
    high: float = 0.5
    low: float = -0.25


def pack_wav(payload: bytes, rate: int) -> bytes:
    """RIFF/WAVE, one channel, unsigned 8-bit PCM."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and sample bytes of an 8-bit mono file, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def lowpass(up: int, down: int, half_taps: int) -> np.ndarray:
    """Windowed-sinc FIR at the rate of up x input, gain `up`."""
    wide = max(up, down)
    n = np.arange(-half_taps * wide, half_taps * wide + 1)
    return (np.sinc(n / wide) * np.hanning(n.size + 2)[1:-1] * up / wide).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: np.ndarray) -> np.ndarray:
    """Polyphase resampling by up/down: each residue of the output index uses its own phase of the filter."""
    n_out, centre = -(-x.size * up // down), taps.size // 2
    out = np.zeros(n_out, dtype=np.float32)
    reach = taps.size // up + 2
    padded = np.concatenate([np.zeros(reach, np.float32), x.astype(np.float32, copy=False), np.zeros(reach + down, np.float32)])
    for r in range(min(up, n_out)):
        t = r * down + centre
        own = np.zeros(-(-(n_out - r) // up), dtype=np.float32)
        for i, k in enumerate(range(t % up, taps.size, up)):
            first = t // up - i + reach
            # beyond the padding there are zeros only
            part = padded[max(first, first % down) :: down][: own.size] if first >= 0 else padded[:0]
            own[: part.size] += taps[k] * part
        out[r::up] = own
    return out


def mel_bank(spec: AudioSpec) -> np.ndarray:
    """Triangular filters, bins x mels."""
    top = 2595 * np.log10(1 + spec.target / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, spec.mels + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(spec.window, 1 / spec.target)
    rise = (freq[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


def segments(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Frame spans [begin, end) that begin at energy >= high and last while energy >= low."""
    mark = np.where(energy >= high, 1, np.where(energy < low, 0, -1))
    known = np.where(mark >= 0, np.arange(mark.size), -1)
    last = np.maximum.accumulate(known)
    on = np.concatenate([[0], np.where(last >= 0, mark[np.maximum(last, 0)], 0), [0]])
    step = np.diff(on)
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


class Features:
    """Tables that depend on the specification only, and the features of one file."""

    def __init__(self, spec: AudioSpec):
        self.spec = spec
        g = int(np.gcd(spec.rate, spec.target))
        self.up, self.down = spec.target // g, spec.rate // g
        self.taps, self.bank = lowpass(self.up, self.down, spec.half_taps), mel_bank(spec)
        self.hann = np.hanning(spec.window + 1)[:-1].astype(np.float32)
        self.kind = pa.fixed_shape_tensor(pa.float32(), (spec.frames, spec.mels), dim_names=("frame", "mel"))
        self.schema = pa.schema([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("valid", pa.int32()), ("mel", self.kind)])

    def log_mel(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-mel frames and log energy by frame; the last window is padded with silence."""
        s = self.spec
        x = resample((samples.astype(np.float32) - 128) / 128, self.up, self.down, self.taps)
        n = 1 + max(0, -(-(x.size - s.window) // s.hop))
        x = np.concatenate([x, np.zeros((n - 1) * s.hop + s.window - x.size, np.float32)])
        mel, energy = np.empty((n, s.mels), np.float32), np.empty(n, np.float32)
        views = np.lib.stride_tricks.sliding_window_view(x, s.window)[:: s.hop]
        for at in range(0, n, 4096):
            f = views[at : at + 4096]
            p = np.abs(np.fft.rfft(f * self.hann, axis=1)).astype(np.float32) ** 2
            mel[at : at + 4096] = np.log(np.einsum("fb,bm->fm", p, self.bank, optimize=False) + 1e-6)
            energy[at : at + 4096] = np.log((f * f).mean(1) + 1e-6)
        return mel, energy

    def millis(self, frame: int) -> int:
        return frame * self.spec.hop * 1000 // self.spec.target

    def tensors(self, mel: np.ndarray) -> bytes:
        """Arrow IPC stream of (start_ms, end_ms, valid, mel)."""
        s, n = self.spec, len(mel)
        rows = -(-n // s.frames)
        full = np.zeros((rows * s.frames, s.mels), np.float32)
        full[:n] = mel
        starts = [i * s.frames for i in range(rows)]
        ends = [min(n, x + s.frames) for x in starts]
        storage = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), s.frames * s.mels)
        batch = pa.RecordBatch.from_arrays([pa.array([self.millis(x) for x in starts], pa.int64()), pa.array([self.millis(x) for x in ends], pa.int64()), pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int32()), pa.ExtensionArray.from_storage(self.kind, storage)], schema=self.schema)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as w:
            w.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def of(self, media: bytes) -> tuple[bytes, list[dict[str, int]], str]:
        """Tensors, segments and a short digest of one stored file."""
        s = self.spec
        mel, energy = self.log_mel(np.frombuffer(read_wav(media)[1], np.uint8))
        mean, dev = float(energy.mean(dtype=np.float64)), float(energy.std(dtype=np.float64))
        found = segments(energy, mean + s.high * dev, mean + s.low * dev) if dev > 1e-6 else []
        spans = [{"start_ms": self.millis(a), "end_ms": self.millis(b)} for a, b in found]
        voiced = sum(b - a for a, b in found)
        feature = f"frames={len(mel)};mels={s.mels};segments={len(found)};voiced={voiced};energy={mean:.3f};mel=" + ",".join(f"{v:.2f}" for v in mel.mean(0, dtype=np.float64))
        return self.tensors(mel), spans, feature


def read_tensors(data: bytes) -> pa.Table:
    """The stored log-mel tensors with their spans."""
    return pa.ipc.open_stream(data).read_all()


def audio_columns(docs: DataFrame, doc: str = "doc_id", text: str = "text", spec: AudioSpec = AudioSpec()) -> DataFrame:
    """(doc, n_bytes, media, tensors, segments, feature): one row a row of docs."""
    ids = docs.select(F.col(doc).alias("doc"), F.col(text).cast("binary").alias("text"))
    span = T.ArrayType(T.StructType([T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())]))
    schema = T.StructType([T.StructField("doc", ids.schema["doc"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("tensors", T.BinaryType()), T.StructField("segments", span), T.StructField("feature", T.StringType())])
    arrow_span = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(spec)
        for b in batches:
            begin, size, rows = 0, 0, []
            for i, t in enumerate(b.column(1)):
                raw = t.as_py() or b""
                media = pack_wav(raw + b"\0" * (max(PAD, -(-len(raw) // PAD) * PAD) - len(raw)), spec.rate)
                rows.append((len(raw), media, *make.of(media)))
                size += len(media)
                if size > SLICE or i == b.num_rows - 1:
                    n, m, t_, s, f = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(rows)), pa.array(n, pa.int64()), pa.array(m, pa.binary()), pa.array(t_, pa.binary()), pa.array(s, arrow_span), pa.array(f, pa.string())], ["doc", "n_bytes", "media", "tensors", "segments", "feature"])
                    begin, size, rows = i + 1, 0, []

    return ids.mapInArrow(run, schema)


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio_columns(table(spark, sf_dir, "documents"))
    # the data chunk of the stored file: our writer's header has 44 bytes, and the chunk's length stands before it
    payload = F.substring("media", 45, 2147483647)
    return out.select(
        F.col("doc").alias("doc_id"),
        "n_bytes",
        F.length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring("media", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("feature"),
        F.sha2("tensors", 256).alias("tensors_sha256"),
        F.size("segments").cast("bigint").alias("n_segments"),
    )
