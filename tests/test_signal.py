"""Signal operators against analytic signals, and their laws."""

import math

import numpy as np
import pytest

from cadenza.operators import signal as S
from cadenza.plans import QUERIES
from cadenza.plans.signals import centre_of, notes_of

from made import MELODY, pitch_points


def sine(freq, amp=1.0, n=8000, fs=8000.0, phase=0.0):
    return amp * np.sin(2 * np.pi * freq * np.arange(n) / fs + phase)


def lufs(channels, fs):
    power = 0.0
    for x in channels:
        for b, a in S.k_weighting(fs):
            x = S.iir(x, b, a)
        power += float(np.mean(x[int(fs / 2) :] ** 2))
    return -0.691 + 10 * math.log10(power)


@pytest.mark.parametrize("fs", [44100, 48000])
@pytest.mark.parametrize("db", [-23.0, -33.0])
def test_standard_loudness_of_a_stereo_tone(fs, db):
    x = sine(1000, 10 ** (db / 20), 2 * fs, fs)
    assert abs(lufs([x, x], fs) - db) < 0.05


def test_true_peak_between_samples():
    x = sine(2000, 0.5, 4000, 8000.0, math.pi / 4)
    assert 20 * math.log10(np.abs(x).max()) < -8.9
    assert -6.6 < 20 * math.log10(S.true_peak(x)) < -5.6


@pytest.mark.parametrize("freq", [110, 220, 440, 880])
def test_pitch_within_ten_cents(freq):
    f, clarity = S.yin(sine(freq, 0.5, 2000, 22050.0), 22050.0)
    assert abs(1200 * math.log2(f / freq)) < 10 and clarity > 0.8


def test_pitch_of_silence_and_noise_gate():
    assert S.yin(np.zeros(2000), 22050.0) == (0.0, 0.0) and S.yin(np.ones(20), 22050.0) == (0.0, 0.0)


def test_limiter_and_compressor():
    x = sine(50, 2.0, 4000)
    g = S.limiter(x, 0.9, 32, 0.01)
    assert np.abs(x * g).max() <= 0.9 + 1e-9 and (g <= 1).all() and (g > 0).all()
    c = S.compressor(x, -20.0, 4.0, 64, 0.5, 0.1)
    assert (c <= 1).all() and c[-1] < c[0]
    assert (S.limiter(np.zeros(100), 0.9, 8, 0.1) == 1).all()


def test_spectrum_and_autocorrelation():
    p = S.power_spectrum(sine(1000, 1.0, 512))
    assert abs(int(p.argmax()) * 8000 / 512 - 1000) < 16
    ac = S.autocorrelation(sine(400, 1.0, 2000), 40)
    assert int(ac[5:30].argmax()) + 5 == 20


def test_notes_of_melody(spark):
    got = [r.midi for r in sorted(notes_of(pitch_points(spark)).collect(), key=lambda r: r.start)]
    assert got == MELODY


def test_query_laws(spark):
    sf = "/root/testdata/sf0.001"
    pitch = QUERIES["pitch_yin"](spark, sf).collect()
    assert sum(abs(r.found / r.freq - 1) < 0.01 for r in pitch) >= 0.97 * len(pitch) and len(pitch) > 900
    assert max(abs(r.y) for r in QUERIES["limiter"](spark, sf).collect()) <= 60.0001


def test_centre_of_three_tones(spark):
    """Tone a on both sides, b on the left, c on the right: what is shared is a."""
    t = np.arange(4096) / 8000
    a, b, c = (amp * np.sin(2 * np.pi * f * t + p) for f, amp, p in ((440, 0.5, 0.0), (1000, 0.25, 0.3), (220, 0.8, 1.0)))
    stereo = spark.createDataFrame([("m", k, float(x), float(y)) for k, (x, y) in enumerate(zip(a + b, a + c, strict=True))], "track string, i long, l double, r double")
    got = [r.center for r in centre_of(stereo).orderBy("i").collect()]
    assert np.corrcoef(got, a)[0, 1] > 0.85
