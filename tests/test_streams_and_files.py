"""Streams against their batch forms; WAV and MIDI round trips; window helpers on odd input."""

import math
import struct
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators.windows import asof, closed_runs, runs, sliding_windows, spaced
from cadenza.functions.scalar import bell, half_up, minute_second, note_name, upper_median
from cadenza.plans import QUERIES
from cadenza.sources.audio import decode_wav, encode_wav, midi_bytes, read_wav, write_midi, write_wav
from cadenza.streaming import live

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_live_notes_commit_all_but_the_open_one(spark):
    got = Counter((r.track, r.midi, round(r.start, 2)) for r in QUERIES["live_notes"](spark, SF).collect())
    all_notes = {}
    for n in QUERIES["segment_notes"](spark, SF).collect():
        all_notes.setdefault(n.track, []).append((n.start, n.midi))
    want = Counter((t, m, s) for t, ns in all_notes.items() for s, m in sorted(ns)[:-1])
    assert want - got == Counter() and all(c == 1 for c in got.values()) and len(got) <= len(want) + len(all_notes)


def test_stream_token_bucket_equals_batch(spark):
    assert rows(QUERIES["stream_token_bucket"](spark, SF)) == rows(QUERIES["token_bucket"](spark, SF))


def test_folded_words(spark, tmp_path):
    data = [("k", 0, False, "he"), ("k", 1, True, "hello"), ("k", 2, False, "wor"), ("k", 3, True, "world"), ("k", 4, False, "an")]
    df = spark.createDataFrame(data, "key string, seq long, final boolean, text string")
    df.write.parquet(f"{tmp_path}/in")
    out = live.finished(live.folded_words(live.stream_of(spark, f"{tmp_path}/in", df.schema, 100)), str(tmp_path))
    assert rows(out)[-1] == ("k", 4, "hello world", "an")


def test_unexpired(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:10"), ("b", "2024-01-01 00:00:20")], "id string, ts string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    out = live.finished(live.unexpired(live.stream_of(spark, f"{tmp_path}/in", df.schema, 100), "30 seconds"), str(tmp_path))
    assert sorted(r.id for r in out.collect()) == ["a", "b"]
    assert live.tail_median(np.array([1.0, 5.0, 3.0, 9.0])) == 5.0 and math.isnan(live.tail_median(np.empty(0)))


def test_wav_round_trip_and_rejects(spark, tmp_path):
    x = 0.5 * np.sin(np.arange(1000) / 9)
    for bits, tol in ((16, 1e-4), (24, 1e-6)):
        raw = encode_wav([x, -x], 8000, bits)
        y, fs = decode_wav(raw)
        assert fs == 8000 and np.abs(y[:, 0] - x).max() < tol and np.abs(y[:, 1] + x).max() < tol
        assert struct.unpack("<I", raw[4:8])[0] == len(raw) - 8
    (tmp_path / "a.wav").write_bytes(encode_wav([x], 8000))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVEjunk")
    (tmp_path / "note.txt").write_text("no")
    (tmp_path / "empty.wav").write_bytes(b"")
    good, bad = read_wav(spark, str(tmp_path), max_seconds=0.1)
    s = good.orderBy("i").collect()
    assert len(s) == 800 and all(r.l == r.r for r in s) and abs(s[5].l - x[5]) < 1e-4
    assert {r.path.rsplit("/", 1)[1]: r.error for r in bad.collect()} == {"bad.wav": "no data chunk", "note.txt": "no audio file"}
    wav = write_wav(spark.createDataFrame([("t", i, float(v), float(v)) for i, v in enumerate(x)], "track string, i long, l double, r double"), 8000).first().wav
    assert np.abs(decode_wav(bytes(wav))[0][:, 0] - x).max() < 1e-4


def test_midi(spark):
    raw = midi_bytes([(60, 0.0, 0.5, 90), (62, 0.5, 1.0, 90)])
    assert raw[:4] == b"MThd" and raw[14:18] == b"MTrk" and struct.unpack(">I", raw[18:22])[0] == len(raw) - 22
    assert raw.index(bytes([0x80, 60])) < raw.index(bytes([0x90, 62])) and raw.endswith(b"\xff\x2f\x00")
    df = spark.createDataFrame([("t", 60, 0.0, 0.5, 90)], "track string, midi int, start double, end double, velocity int")
    assert bytes(write_midi(df).first().file)[:4] == b"MThd"


def test_windows_of_short_and_empty_tracks(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(3)] + [("b", i, 1.0) for i in range(10)], "track string, i long, x double")
    got = {(r.track, r.w): r["mean"] for r in sliding_windows(df, "x", ["track"], "i", 4, 2).collect()}
    assert got[("a", 0)] == 1.0 and {k for k in got if k[0] == "b"} == {("b", w) for w in range(4)}
    assert sliding_windows(df.limit(0), "x", ["track"], "i", 4).count() == 0


def test_runs_and_gaps(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, None, 1, 1, 1, 0, 0, 0, 1])], "track string, i long, x int")
    r = runs(df, F.col("x") == 1, ["track"], "i")
    assert rows(r.select("a", "b")) == [(0, 2), (3, 6), (9, 10)]
    assert rows(closed_runs(r, ["track"], 2, 4).select("a", "b")) == [(0, 6)]


def test_asof_with_nulls_and_ties(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 1, 2), ("z", 5, 3)], "key string, at int, id int")
    right = spark.createDataFrame([("k", 2, "x"), ("k", 5, None), ("k", 7, "w")], "key string, at int, v string")
    assert rows(asof(left, right, ["key"], "at", ["v"]).select("id", "v")) == [(1, None), (2, None), (3, None)]
    assert rows(asof(left, right, ["key"], "at", ["v"], forward=True).select("id", "v")) == [(1, None), (2, "x"), (3, None)]


def test_spaced_and_scalars(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in ((0, 5.0), (2, 9.0), (3, 9.0), (10, 1.0))], "track string, i long, s double")
    assert rows(spaced(df, "s", "i", ["track"], 3).select("i")) == [(10,), (2,)]
    assert rows(spaced(df, "s", "i", ["track"], 3, most=1).select("i")) == [(2,)]
    one = spark.range(1).select(
        half_up(F.lit(-2.5)).alias("a"), upper_median(F.array(*map(F.lit, (4, 1, 3, 2)))).alias("b"), minute_second(F.lit(125.4)).alias("c"), note_name(F.lit(69.0)).alias("d"), bell(F.lit(5.0), 1, 5, 2.0).alias("e")
    ).first()
    assert tuple(one) == (-2, 3, "2:05", "A4", 1.0)


def test_live_notes_of_many_tracks_share_states(spark, tmp_path):
    """40 tracks in 3 buckets over two batches: the notes are those of each track alone, and the files of a portion are many."""
    def points(lo, hi):
        return [(f"t{k}", (20 * n + m) / 100, 220.0 * 2 ** ((k + n % 5) / 12) if m < 12 else 0.0, 0.9, 0.05) for k in range(40) for n in range(lo, hi) for m in range(20)]

    schema = "track string, t double, freq double, clarity double, rms double"
    for part in (points(0, 4), points(4, 9)):
        spark.createDataFrame(part, schema).repartition(4).write.mode("append").parquet(f"{tmp_path}/in")
        out = live.finished(live.live_notes(live.stream_of(spark, f"{tmp_path}/in", schema, 1000), buckets=3), str(tmp_path))
    got = sorted((r.track, round(r.start, 2), r.midi) for r in out.collect())
    assert got == sorted((f"t{k}", round(n / 5, 2), 57 + k + n % 5) for k in range(40) for n in range(8))
