"""WAVE files as a data source: ranges of samples in, sized and dithered parts out.

Paths and their files are read and written through pyarrow's file systems, so a URI of a shared store works as a shared
folder does; every executor must reach them.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs as store
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.scalar import LCG_FACTOR, LCG_SEED, LCG_STEP
from .audio import pcm, wave_format

SAMPLES = "path string, i long, l double, r double, fs int, error string"
#: Bytes of samples that a task reads, and samples of a batch.
PART_BYTES, BATCH = 16 << 20, 1 << 16
#: Bytes of a WAVE file before its samples.
HEAD = 44
#: Bytes of samples that a file costs beside its own, as it must be opened, and files that the driver moves at once.
OPEN_BYTES, MOVES = 16 << 10, 32


def _at(path: str) -> tuple[store.FileSystem, str]:
    return store.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (store.LocalFileSystem(), path)


@dataclass
class Stretch(InputPartition):
    """`frames` sample frames of a file from frame `first`, which begins at byte `offset`; or why the file is refused."""

    path: str
    offset: int = 0
    first: int = 0
    frames: int = 0
    tag: int = 0
    channels: int = 0
    width: int = 0
    rate: int = 0
    error: str | None = None


@dataclass
class Small(InputPartition):
    """Files that a task reads one after the other, each whole; their heads are read by the task."""

    paths: list[str]


def layout(file: pa.NativeFile, size: int) -> tuple[int, int, int, int, int, int]:
    """Format tag, channels, bytes a sample, rate, first byte and frames of a WAVE file, from its chunk heads alone."""
    file.seek(0)
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt = 12, None
    while at + 8 <= size:
        file.seek(at)
        kind, length = struct.unpack("<4sI", file.read(8))
        if kind == b"fmt ":
            fmt = wave_format(file.read(min(length, 64)))
        elif kind == b"data" and fmt:
            tag, channels, rate, bits = fmt
            return tag, channels, bits // 8, rate, at + 8, min(length, size - at - 8) // (bits // 8 * channels)
        at += 8 + length + length % 2
    raise ValueError("no data chunk")


class WaveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.cap_bytes = int(options.get("capbytes", 200 << 20))
        self.max_seconds = float(options.get("maxseconds", 420.0))

    def partitions(self) -> list[Stretch | Small]:
        """Stretches of all .wav files under the path, at frame borders, part_bytes each at most; only heads are read here,
        and only of files beyond part_bytes or without room for a sample. The others go to tasks many at a time, as many
        as are part_bytes with what opening them costs. A file beyond cap_bytes, or none of a known format, is a refused stretch."""
        system, root = _at(self.path)
        out, small, held = [], [], 0
        for info in sorted(system.get_file_info(store.FileSelector(root, recursive=True)), key=lambda x: x.path):
            if not info.is_file or not info.path.lower().endswith(".wav"):
                continue
            if HEAD < info.size <= min(self.part_bytes, self.cap_bytes):
                if small and held + info.size + OPEN_BYTES > self.part_bytes:
                    out.append(Small(small))
                    small, held = [], 0
                small.append(info.path)
                held += info.size + OPEN_BYTES
            else:
                out += self.stretches(system, info.path, info.size, self.part_bytes)
        if small:
            out.append(Small(small))
        return out or [Stretch("", frames=0)]

    def stretches(self, system: store.FileSystem, path: str, size: int, part_bytes: int) -> list[Stretch]:
        if not 0 < size <= self.cap_bytes:
            return [Stretch(path, error="size")]
        try:
            with system.open_input_file(path) as file:
                tag, channels, width, rate, offset, frames = layout(file, size)
        except (ValueError, struct.error) as e:
            return [Stretch(path, error=str(e))]
        frames = min(frames, int(self.max_seconds * rate))
        each = max(1, part_bytes // (width * channels))
        return [Stretch(path, offset + a * width * channels, a, min(each, frames - a), tag, channels, width, rate) for a in range(0, frames, each)]

    def read(self, part: Stretch | Small) -> Iterator[pa.RecordBatch]:
        names = ["path", "i", "l", "r", "fs", "error"]
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.string()]
        held, n = [], 0
        for columns in self.rows(part):
            held.append([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)])
            n += len(held[-1][0])
            if n >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names=names)
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names=names)

    def rows(self, part: Stretch | Small) -> Iterator[tuple]:
        """Columns of at most BATCH frames of a file at a time."""
        system, _ = _at(self.path)
        if isinstance(part, Small):
            for path in part.paths:
                for own in self.stretches(system, path, system.get_file_info(path).size, self.part_bytes):
                    yield from self.rows(own)
            return
        if part.error is not None:
            yield [part.path], [None], [None], [None], [None], [part.error]
        if not part.frames:
            return
        with system.open_input_file(part.path) as file:
            file.seek(part.offset)
            for a in range(0, part.frames, BATCH):
                n = min(BATCH, part.frames - a)
                x = pcm(file.read(n * part.width * part.channels), part.tag, part.width).reshape(-1, part.channels)
                n = len(x)
                yield [part.path] * n, part.first + a + np.arange(n), x[:, 0], x[:, min(1, part.channels - 1)], np.full(n, part.rate), [None] * n


def noise(first: int, n: int) -> np.ndarray:
    """Triangular noise (-1 to 1) of the n samples from number `first` on, two draws of the congruential generator each. The
    state before the first is found by doubling steps, those behind it as running products, so any stretch stands alone."""
    a, c, state, steps = LCG_FACTOR, LCG_STEP, LCG_SEED, 2 * first
    while steps:
        if steps & 1:
            state = (a * state + c) % (1 << 32)
        a, c, steps = a * a % (1 << 32), (a * c + c) % (1 << 32), steps >> 1
    power = np.cumprod(np.full(2 * n, LCG_FACTOR, np.uint32), dtype=np.uint32)
    base = np.cumsum(np.concatenate([[np.uint32(1)], power[:-1]]), dtype=np.uint32) * np.uint32(LCG_STEP)
    draw = (power * np.uint32(state) + base).astype(np.float64) / 2.0**32
    return draw[0::2] - draw[1::2]


def dithered(x: np.ndarray, first: int) -> bytes:
    """16-bit samples of x (-1 to 1), of which the first is number `first`, with noise of a step."""
    v = np.floor((np.clip(x, -1, 1) + noise(first, len(x)) / 32768) * 32767 + 0.5)
    return np.clip(v, -32768, 32767).astype("<i2").tobytes()


class WaveWriter(DataSourceArrowWriter):
    """One mono file of 16 bits a (track, part): rows (track, part, i, x) come sorted, and whole parts to one task."""

    def __init__(self, options: dict[str, str]):
        self.path, self.rate, self.run = options["path"], int(options.get("rate", "16000")), uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _at(self.path)
        own = f"{root}/_{self.run}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        key, held, first = None, [], 0

        def close() -> None:
            if key is not None:
                body = dithered(np.concatenate(held), first)
                with system.open_output_stream(f"{own}/{key[0]}-{key[1]:05}.wav") as file:
                    file.write(b"RIFF" + struct.pack("<I", HEAD - 8 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, self.rate, 2 * self.rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body)

        for b in batches:
            track, part, i = (b.column(c).to_pylist() for c in ("track", "part", "i"))
            x = b.column("x").to_numpy(zero_copy_only=False)
            cuts = [0, *(k for k in range(1, len(i)) if (track[k], part[k]) != (track[k - 1], part[k - 1])), len(i)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if (track[lo], part[lo]) != key:
                        close()
                        key, held, first = (track[lo], part[lo]), [], i[lo]
                    held.append(x[lo:hi])
        close()
        return Written(own)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """The files of the tasks that count get their names, a task's at a time and many at once; what other attempts have
        left goes."""
        system, root = _at(self.path)
        with ThreadPoolExecutor(MOVES) as pool:
            for m in messages:
                if m is not None:
                    names = [f.base_name for f in system.get_file_info(store.FileSelector(m.folder))]
                    list(pool.map(lambda name, folder=m.folder: system.move(f"{folder}/{name}", f"{root}/{name}"), names))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _at(self.path)
        if system.get_file_info(f"{root}/_{self.run}").type != store.FileType.NotFound:
            system.delete_dir(f"{root}/_{self.run}")


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's files."""

    folder: str


class Wave(DataSource):
    """format("wave"): read .wav files of a folder as samples, or write (track, part, i, x) as parts.

    Reading, options: path, partBytes, capBytes, maxSeconds. Columns: path, i, l, r, fs, error; a file that is refused is a
    row with an error. Writing, options: path, rate; see write_parts.
    """

    @classmethod
    def name(cls) -> str:
        return "wave"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return WaveReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WaveWriter({k.lower(): v for k, v in self.options.items()})


def read_waves(spark: SparkSession, path: str, **options: object) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected) of the .wav files under path, as read_wav gives them, but no task reads more than a stretch."""
    spark.dataSource.register(Wave)
    rows = reduce(lambda r, kv: r.option(kv[0], str(kv[1])), options.items(), spark.read.format("wave").option("path", path)).load()
    return rows.where("error is null and path <> ''").drop("error"), rows.where("error is not null").select("path", "error")


def frames_within(most_bytes: int) -> int:
    """Mono samples of 16 bits that a file of most_bytes holds."""
    return (most_bytes - HEAD) // 2


def write_parts(samples: DataFrame, path: str, rate: int = 16000, most_bytes: int = int(3.5 * (1 << 20))) -> None:
    """Mono samples (track, i from 0, x) as files track-part.wav of at most most_bytes. A part goes to one task, which holds
    no more than it; noise follows from the sample's number, so the parts of a track are one signal. Null samples are silence.
    All files appear when the job has ended well, and none if it fails."""
    if frames_within(most_bytes) < 1:
        raise ValueError(f"{most_bytes} bytes hold no sample")
    samples.sparkSession.dataSource.register(Wave)
    part = F.expr(f"i div {frames_within(most_bytes)}")
    rows = samples.select(F.col("track").cast("string").alias("track"), part.cast("long").alias("part"), "i", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"))
    rows.repartition("track", "part").sortWithinPartitions("track", "part", "i").write.format("wave").option("path", path).option("rate", str(rate)).mode("append").save()

