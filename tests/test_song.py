"""Frame features, onsets, tempo and sections of made songs; formats of WAVE files; gated loudness."""

import struct

import numpy as np
import pytest

from cadenza.operators import signal as S
from cadenza.plans import song
from cadenza.sources.audio import decode_wav, encode_wav, read_wav

import made


def test_frame_features_of_a_tone():
    t = np.arange(8192) / 8000
    x = S.frame_features(0.5 * np.sin(2 * np.pi * 440 * t), np.zeros(8192), 8000.0, 1024, 512)
    assert len(x["rms_db"]) == 15 and np.allclose(x["rms_db"], 10 * np.log10(0.125), atol=0.05)
    assert np.allclose(x["centroid"], 440, atol=5) and (x["chroma"].argmax(1) == 9).all() and np.allclose(x["chroma"].sum(1), 1)
    assert (x["flatness"] < 0.01).all() and (x["vocal"] > 0.9).all() and (x["low_db"] < -60).all()
    noise = np.random.default_rng(1).normal(size=8192)
    y = S.frame_features(noise, noise, 8000.0, 1024, 512)
    assert (y["flatness"] > 0.4).all() and (y["vocal"] < 0.2).all()
    assert len(S.frame_features(np.zeros(10), np.zeros(10), 8000.0, 1024, 512)["rms_db"]) == 0


def test_chunks_give_the_frames_of_the_whole(spark):
    whole = {k: v for k, v in ((t, d.sort_values("i")) for t, d in made.song(spark).toPandas().groupby("track"))}
    got = {t: d.sort_values("f") for t, d in song.features(made.song(spark)).toPandas().groupby("track")}
    for track, d in whole.items():
        l, r = d.l.to_numpy(), d.r.to_numpy()
        want = S.frame_features((l + r) / 2, (l - r) / 2, song.FS, 1024, 512)
        assert got[track].f.tolist() == list(range(len(want["rms_db"])))
        assert np.allclose(got[track].rms_db, want["rms_db"]) and np.allclose(got[track].centroid, want["centroid"])


def test_tempo_within_two_percent(spark):
    got = {r.track: r for r in song.tempo_of(song.onsets(made.song(spark)), 128 / song.FS).collect()}
    for track, bpm in made.TEMPOS:
        assert abs(got[track].bpm / bpm - 1) < 0.02 and got[track].confidence > 0.3 and got[track].clarity > 0.2, got[track]
    short = spark.createDataFrame([("x", k, 1.0) for k in range(20)], "track string, f long, env double")
    assert [tuple(r) for r in song.tempo_of(short, 0.016).collect()] == [("x", 120.0, 0.0, 0.0)]


def wav(tag, bits, body, channels=1, fmt_size=16):
    fmt = struct.pack("<HHIIHH", tag, channels, 8000, 8000 * channels * bits // 8, channels * bits // 8, bits)[:fmt_size]
    return b"RIFF" + struct.pack("<I", 20 + len(fmt) + len(body)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body


def test_wave_formats():
    x = np.array([0.25, -0.5])
    assert decode_wav(wav(3, 32, x.astype("<f4").tobytes()))[0][:, 0].tolist() == [0.25, -0.5]
    assert decode_wav(wav(3, 64, x.astype("<f8").tobytes()))[0][:, 0].tolist() == [0.25, -0.5]
    assert decode_wav(wav(1, 8, bytes([128, 192, 0])))[0][:, 0].tolist() == [0.0, 0.5, -1.0]
    for bad in (wav(3, 16, b"1234"), wav(6, 8, b"1234"), wav(1, 16, b"1234", fmt_size=10), wav(1, 16, b"12", channels=0), b"RIFF", b"RIFF1234WAVEfmt "):
        with pytest.raises(ValueError):
            decode_wav(bad)


def test_broken_files_are_rejected_rows(spark, tmp_path):
    files = {"good.wav": encode_wav([np.array([0.5, -0.5])], 8000), "cut.wav": wav(1, 16, b"", fmt_size=6), "odd.wav": wav(2, 4, b"12345678"), "float.wav": wav(3, 32, np.array([0.25], "<f4").tobytes())}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    samples, rejected = read_wav(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.i, round(r.l, 3)) for r in samples.collect()} == {("good.wav", 0, 0.5), ("good.wav", 1, -0.5), ("float.wav", 0, 0.25)}
    assert {r.path.rsplit("/", 1)[1] for r in rejected.collect()} == {"cut.wav", "odd.wav"}
