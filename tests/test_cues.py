"""Cues, quantiles, generator, files, waiting for streams and clips against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.scalar import mulberry
from cadenza.operators.quantiles import exact_quantiles
from cadenza.plans import cues, song
from cadenza.settings import Tuning, tuned
from cadenza.sources import files
from cadenza.streaming import live


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    x = [float(v) for v in rng.normal(size=700).round(2)] + [0.25] * 400
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double").repartition(5)
    qs = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]
    got = {g.k: (g.t, g.n) for g in exact_quantiles(df, "x", qs, 8).collect()}
    assert len(got) == len(qs) and all(n == len(x) for _, n in got.values())
    assert [got[k][0] for k in range(1, 7)] == pytest.approx(list(np.quantile(x, qs)))
    assert exact_quantiles(df.where("x is null"), "x", qs).count() == 0


def test_mulberry(spark):
    def plain(seed, n):
        for _ in range(n + 1):
            seed = (seed + 0x6D2B79F5) % 2**32
        t = (seed ^ seed >> 15) * (seed | 1) % 2**32
        t ^= (t + (t ^ t >> 7) * (t | 61)) % 2**32
        return (t ^ t >> 14) / 2**32

    rows = spark.range(50).select("id", *[mulberry(F.col("id"), F.lit(s).cast("long")).alias(f"s{s}") for s in (1, 7, 2**32 - 1)]).collect()
    assert all(g[f"s{s}"] == plain(s, g.id) for g in rows for s in (1, 7, 2**32 - 1))


def test_decimated_keeps_low_tones_and_ends(spark):
    x = np.sin(2 * np.pi * 0.01 * np.arange(301))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "track string, i long, x double")
    got = {g.o: g.y for g in cues.decimated(df, 4).collect()}
    h, padded = np.array(cues.sinc_taps(4)), np.pad(x, 16)
    assert sorted(got) == list(range(75)) and all(got[o] == pytest.approx(float(h @ padded[4 * o : 4 * o + 33])) for o in got)
    assert cues.decimated(df, 1).count() == 301


def test_stationarity_is_the_mean_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    p = rng.random((5, 12))
    rows = [("a", [float(v) for v in r]) for r in p] + [("a", [0.0] * 12), ("b", [1.0] * 12), ("b", [float(v) for v in p[0]]), ("c", [1.0] * 12)]
    got = {g.track: g.stationarity for g in cues.stationarity(spark.createDataFrame(rows, "track string, profile array<double>"), 12).collect()}
    assert got["a"] == pytest.approx(np.mean([np.corrcoef(p[i], p[j])[0, 1] for i in range(5) for j in range(i + 1, 5)]))
    assert got["b"] == pytest.approx(0) and got["c"] == 0


def test_likeness_levels(spark):
    rows = [(0.8, 14000.0, 2.0), (0.0, 19900.0, None), (0.5, 16000.0, 8.0)]
    df = spark.createDataFrame(rows, "s double, b double, k double")
    got = [(g.bandwidth_score, g.smear_score, g.level) for g in df.withColumns(cues.likeness(F.col("s"), F.col("b"), F.col("k"), 20000.0)).collect()]
    assert got == [(0.7, 1.0, "élevé"), (0.0, 0.0, "faible"), (0.45, 0.0, "modéré")]


def test_finalised_level_and_ceiling(spark):
    x = np.sin(np.arange(400) / 3)
    df = spark.createDataFrame([(t, i, float(v), l) for t, l in (("a", -3.0), ("b", -20.0), ("c", None)) for i, v in enumerate(x)], "track string, i long, x double, l double")
    got = cues.finalised(df, F.col("l")).groupBy("track").agg(F.max(F.abs("y")).alias("peak")).collect()
    peak = {g.track: g.peak for g in got}
    assert peak["a"] == pytest.approx(10 ** (-4 / 20), abs=0.02) and peak["b"] <= 10 ** (-1 / 20) + 1e-9 and peak["c"] <= 10 ** (-1 / 20) + 1e-9


def test_files(spark, tmp_path):
    (tmp_path / "in" / "x").mkdir(parents=True)
    for name in ("a.wav", "x/b.wav", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"12345")
    (tmp_path / "songs.csv").write_text('song,language\na,fr\na,es\n"b, b",de\n')
    songs = files.listing(spark, str(tmp_path / "in"))
    got = files.with_language(songs, files.catalog(spark, str(tmp_path / "songs.csv"))).collect()
    assert sorted((g.song, g.length, g.language) for g in got) == [("a", 5, "es"), ("b", 5, "en")]
    made = []
    for _ in range(2):
        t = files.kept(spark, str(tmp_path / "kept"), lambda: made.append(1) or spark.range(4))
    assert t.count() == 4 and len(made) == 1
    one = files.report(spark.range(4).select("id", (F.col("id") * 2.0).alias("v")), str(tmp_path / "report"), ["v"]).collect()
    assert [(g.n, g.v) for g in one] == [(4, 3.0)]


def test_waited_reports_each_batch(spark, tmp_path):
    for k in range(3):
        spark.range(5 + k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.stream_of(spark, str(tmp_path / "in"), spark.range(1).schema)
    seen = []
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    assert live.waited(q, lambda batch, rows: seen.append((batch, rows)), first=0.1)
    assert sum(n for _, n in seen) == 18 and [b for b, _ in seen] == sorted({b for b, _ in seen})
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "t")).start()
    assert not live.waited(q, seconds=0.3)
    q.stop()


def test_tuning(spark):
    assert tuned(spark) == Tuning()
    try:
        spark.conf.set("spark.cadenza.clusters", "5")
        assert tuned(spark) == Tuning(clusters=5)
        spark.conf.set("spark.cadenza.least_bars", "few")
        with pytest.raises(ValueError, match="least_bars"):
            tuned(spark)
    finally:
        spark.conf.unset("spark.cadenza.clusters")
        spark.conf.unset("spark.cadenza.least_bars")


def test_clips(spark):
    unit = lambda k: [1.0 if j == k else 0.1 for j in range(12)]
    chords = [0, 1, 2, 3, 4, 5, 6, 7, 4, 5, 6, 7, 1, 2, 3, 8]
    levels = [-20.0] * 4 + [-6.0] * 8 + [-20.0] * 4
    own = spark.createDataFrame([("a", u, 2.0, levels[u], unit(chords[u])) for u in range(16)], "track string, u long, bar_sec double, level double, chroma array<double>")
    sections = spark.createDataFrame([("a", 4, 12, "chorus")], "track string, start long, end long, kind string")
    got = {g.kind: g for g in song.clips_of(own, sections, song.CLIPS).collect()}
    clip, micro = got["clip"], got["micro"]
    assert (clip.start, clip.bars, clip.loop) == (4, 8, 1.0) and (micro.start, micro.bars, micro.loop) == (4, 4, 1.0)
    assert clip.score == pytest.approx(0.4 + 0.2 + 0.25 + 0.15)
    lengths = spark.createDataFrame([(0.5,), (2.0,), (30.0,)], "s double").select(song.clip_bars(F.col("s"), 11.0, 17.5, 15.0)).collect()
    assert [x[0] for x in lengths] == [30, 8, 1]
