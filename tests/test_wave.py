"""The WAVE data source against whole-file reading, and parts written and read again."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.scalar import lcg
from cadenza.sources import wave
from cadenza.sources.audio import encode_wav, read_wav


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(5)
    files = {"a.wav": encode_wav([rng.uniform(-1, 1, 1000), rng.uniform(-1, 1, 1000)], 8000), "b/mono.wav": encode_wav([rng.uniform(-1, 1, 77)], 44100, 24), "bad.wav": b"RIFF1234WAVEjunk", "empty.wav": encode_wav([np.zeros(0)], 8000), "big.wav": encode_wav([np.zeros(9000)], 8000), "note.txt": b"no"}
    for name, raw in files.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    return str(tmp_path)


def test_ranges_give_the_rows_of_whole_files(spark, folder):
    samples, rejected = wave.read_waves(spark, folder, partBytes=100, capBytes=10_000, maxSeconds=0.1)
    whole, _ = read_wav(spark, f"{folder}/*.wav", 10_000, 0.1)
    nested, _ = read_wav(spark, f"{folder}/b", 10_000, 0.1)
    name = lambda r: r.path.rsplit("/", 1)[1]
    rows = lambda df: sorted((name(r), r.i, r.l, r.r, r.fs) for r in df.collect())
    assert rows(samples) == rows(whole.unionByName(nested)) and samples.count() == 877
    assert {(name(r), r.error) for r in rejected.collect()} == {("bad.wav", "no data chunk"), ("big.wav", "size")}
    assert samples.rdd.getNumPartitions() == 32 + 3 + 2


def test_a_large_file_is_many_small_stretches(tmp_path):
    """A file of 1 GB (a sparse one) is planned from its head alone."""
    head = bytearray(encode_wav([np.zeros(1), np.zeros(1)], 44100))
    size = 1 << 30
    head[40:44] = (size - 44).to_bytes(4, "little")
    with open(tmp_path / "x.wav", "wb") as file:
        file.write(head)
        file.truncate(size)
    parts = wave.WaveReader({"path": str(tmp_path), "capbytes": str(2 << 30), "maxseconds": "1e9"}).partitions()
    assert len(parts) == 64 and max(p.frames for p in parts) * 4 <= 16 << 20 and sum(p.frames for p in parts) == (size - 44) // 4
    assert all(a.first + a.frames == b.first and a.offset + a.frames * 4 == b.offset for a, b in zip(parts, parts[1:]))
    last = parts[-1]
    assert sum(b.num_rows for b in wave.WaveReader({"path": str(tmp_path)}).read(last)) == last.frames


def test_no_files(spark, tmp_path):
    samples, rejected = wave.read_waves(spark, str(tmp_path))
    assert samples.count() == 0 and rejected.count() == 0


def test_noise_is_the_generators(spark):
    want = [r[0] for r in spark.range(50).select((lcg(2 * F.col("id") + 1) - lcg(2 * F.col("id") + 2)) / F.lit(2.0**32)).collect()]
    assert np.allclose(wave.noise(0, 50), want, atol=0) and np.allclose(wave.noise(37, 13), want[37:], atol=0)


def test_parts_are_small_and_join_to_the_signal(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = {"t": rng.uniform(-1.2, 1.2, 2500), "u": rng.uniform(-1, 1, 30)}
    df = spark.createDataFrame([(t, i, float(v)) for t, xs in x.items() for i, v in enumerate(xs)] + [("n", 0, None)], "track string, i long, x double")
    wave.write_parts(df.repartition(5), str(tmp_path / "out"), most_bytes=1000)
    sizes = {f: os.path.getsize(tmp_path / "out" / f) for f in os.listdir(tmp_path / "out")}
    assert set(sizes) == {"n-00000.wav", "u-00000.wav", *(f"t-{k:05}.wav" for k in range(6))} and max(sizes.values()) <= 1000
    samples, rejected = wave.read_waves(spark, str(tmp_path / "out"))
    assert rejected.count() == 0
    by_file = {}
    for r in samples.orderBy("path", "i").collect():
        by_file.setdefault(r.path.rsplit("/", 1)[1], []).append(r.l)
    joined = np.concatenate([by_file[f"t-{k:05}.wav"] for k in range(6)])
    assert len(joined) == 2500 and np.abs(joined - np.clip(x["t"], -1, 1)).max() <= 2.6 / 32768
    whole = np.frombuffer(wave.dithered(x["t"], 0), "<i2") / 32768
    assert np.array_equal(joined, whole)


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    df = spark.range(1000).select(F.lit("t").alias("track"), F.col("id").alias("i"), F.when(F.col("id") == 900, F.raise_error(F.lit("stop"))).otherwise(0.5).cast("double").alias("x"))
    with pytest.raises(Exception, match="stop"):
        wave.write_parts(df, str(tmp_path / "out"), most_bytes=200)
    left = [f for _, _, fs in os.walk(tmp_path / "out") for f in fs]
    assert left == []
    with pytest.raises(ValueError):
        wave.write_parts(df, str(tmp_path / "out"), most_bytes=44)


def test_small_files_share_a_task(spark, tmp_path):
    """600 files of 50 samples are one stretch of reading, with the rows of each."""
    df = spark.range(30_000).select(F.expr("cast(id div 100 as string)").alias("track"), F.expr("id % 100").alias("i"), F.lit(0.5).alias("x"))
    wave.write_parts(df, str(tmp_path / "out"), most_bytes=144)
    (tmp_path / "out" / "bad.wav").write_bytes(b"RIFF1234WAVEjunk" + bytes(60))
    samples, rejected = wave.read_waves(spark, str(tmp_path / "out"))
    assert samples.rdd.getNumPartitions() == 1 and [r.error for r in rejected.collect()] == ["no data chunk"]
    found = samples.groupBy("path").agg(F.count("*").alias("n"), F.max("i").alias("last")).collect()
    assert len(found) == 600 and {(r.n, r.last) for r in found} == {(50, 49)}
    assert len(wave.WaveReader({"path": str(tmp_path / "out"), "partbytes": str(1 << 20)}).partitions()) == 10
