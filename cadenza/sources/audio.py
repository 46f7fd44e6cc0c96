"""WAV and MIDI bytes in and out, and synthetic signals as DataFrames."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import written

AUDIO = r"(?i)\.(wav|mp3|flac|ogg|m4a|aac|aiff?|mp4)$"


def tones(spark: SparkSession, specs: list[tuple[str, float, float, float]], n: int, fs: float) -> DataFrame:
    """samples(track, i, x) of sines (track, frequency, amplitude, phase), computed by Spark from a range."""
    dim = F.broadcast(spark.createDataFrame([(t, float(f), float(a), float(p)) for t, f, a, p in specs], "track string, freq double, amp double, phase double"))
    i = spark.range(n).withColumnRenamed("id", "i")
    x = F.col("amp") * F.sin(2 * math.pi * F.col("freq") * F.col("i") / fs + F.col("phase"))
    return i.crossJoin(dim).select("track", "i", x.alias("x"))


def encode_wav(channels: list[np.ndarray], fs: int, bits: int = 16) -> bytes:
    """RIFF/WAVE PCM of 16 or 24 bits; samples are clipped to -1..1."""
    x = np.clip(np.stack(channels, 1), -1, 1)
    scale = (1 << (bits - 1)) - 1
    v = np.floor(x * scale + 0.5).astype("<i4")
    body = v.astype("<i2").tobytes() if bits == 16 else v.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    block = len(channels) * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, len(channels), fs, fs * block, block, bits) + b"data" + struct.pack("<I", len(body)) + body


def wave_format(part: bytes) -> tuple[int, int, int, int]:
    """Format tag (1 PCM, 3 float), channels, rate and bits of a format chunk. ValueError for what is not read here."""
    if len(part) < 16:
        raise ValueError("cut format chunk")
    tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", part[:16])
    # the extensible format names the real one at the start of its identifier
    real = int.from_bytes(part[24:26], "little") if tag == 0xFFFE and len(part) >= 26 else tag
    if (real, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)} or not channels or not rate:
        raise ValueError(f"format {real} of {bits} bits and {channels} channels")
    return real, channels, rate, bits


def pcm(body: bytes, tag: int, width: int) -> np.ndarray:
    """Samples (-1 to 1) of PCM or float bytes of `width` bytes each."""
    if tag == 3:
        return np.frombuffer(body, f"<f{width}").astype(np.float64)
    if width == 1:
        return (np.frombuffer(body, np.uint8) - 128.0) / 128
    v = np.zeros((len(body) // width, 4), np.uint8)
    v[:, 4 - width :] = np.frombuffer(body, np.uint8).reshape(-1, width)
    return v.reshape(-1).view("<i4") / 2.0**31


def decode_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """(samples x channels, rate) of WAVE bytes: PCM of 8 to 32 bits or floats of 32 or 64. ValueError for all else."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(raw):
        kind, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        part = raw[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            fmt = wave_format(part)
        elif kind == b"data" and fmt:
            tag, channels, rate, bits = fmt
            frame = bits // 8 * channels
            return pcm(part[: len(part) // frame * frame], tag, bits // 8).reshape(-1, channels), rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def read_wav(spark: SparkSession, path: str, cap_bytes: int = 200 << 20, max_seconds: float = 420.0) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected) of the audio files under path: one row per sample (path, i, l, r, fs), mono doubled; rejected (path, error).

    Other extensions, over-long files and whatever can't be decoded are rejected rows, not failures; Spark lists no
    empty files. Files are decoded once, into a table that both frames read.
    """
    files = spark.read.format("binaryFile").load(path)
    small = F.col("path").rlike(AUDIO) & F.col("length").between(1, cap_bytes)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf.path, pdf.content, strict=True):
                try:
                    x, fs = decode_wav(raw)
                    x = x[: int(max_seconds * fs)]
                    yield pd.DataFrame({"path": p, "i": np.arange(len(x)), "l": x[:, 0], "r": x[:, min(1, x.shape[1] - 1)], "fs": fs, "error": None})
                except ValueError as e:
                    yield pd.DataFrame({"path": [p], "i": [None], "l": [None], "r": [None], "fs": [None], "error": [str(e)]})

    decoded = written(files.where(small).select("path", "content").mapInPandas(decode, "path string, i long, l double, r double, fs int, error string"))
    refused = files.where(~small).select("path", F.when(F.col("length").between(1, cap_bytes), "no audio file").otherwise("size").alias("error"))
    return decoded.where("error is null").drop("error"), decoded.where("error is not null").select("path", "error").unionByName(refused)


def write_wav(samples: DataFrame, fs: int, bits: int = 16) -> DataFrame:
    """(track, wav) bytes of samples (track, i, l, r)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("i")
        return pd.DataFrame({"track": [p.track.iloc[0]], "wav": [encode_wav([p.l.to_numpy(), p.r.to_numpy()], fs, bits)]})

    return samples.groupBy("track").applyInPandas(run, f"track {samples.schema['track'].dataType.simpleString()}, wav binary")


def _varint(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(0x80 | n & 0x7F)
    return bytes(reversed(out))


def midi_bytes(notes: list[tuple[int, float, float, int]], bpm: float = 120, ppq: int = 480) -> bytes:
    """Standard MIDI file (format 0) of notes (midi, start, end, velocity); at one tick a note's end comes before a start."""
    tick = lambda t: int(math.floor(t * bpm / 60 * ppq + 0.5))
    events = sorted([(tick(s), 0x90, m, v) for m, s, _, v in notes] + [(tick(e), 0x80, m, 0) for m, _, e, _ in notes])
    body, at = b"\x00\xff\x51\x03" + int(60e6 / bpm).to_bytes(3, "big"), 0
    for t, status, m, v in events:
        body += _varint(t - at) + bytes([status, m, v])
        at = t
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, ppq) + b"MTrk" + struct.pack(">I", len(body)) + body


def write_midi(notes: DataFrame, bpm: float = 120) -> DataFrame:
    """(track, midi) bytes of notes (track, midi, start, end, velocity)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["midi", "start", "end", "velocity"]].itertuples(index=False, name=None))
        return pd.DataFrame({"track": [pdf.track.iloc[0]], "file": [midi_bytes([(int(m), s, e, int(v)) for m, s, e, v in rows], bpm)]})

    return notes.groupBy("track").applyInPandas(run, f"track {notes.schema['track'].dataType.simpleString()}, file binary")
