"""Beats over chunks against the plain recurrence over whole tracks."""

import math

import numpy as np
import pytest

from cadenza.operators.beats import beats, beats_of, strengths


def plain_strength(x, period):
    sigma = max(1.0, period / 32)
    half = math.ceil(3 * sigma)
    rms = math.sqrt(float(np.mean(x * x))) or 1.0
    return np.array([sum(x[i + k] * math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1) if 0 <= i + k < len(x)) / rms for i in range(len(x))])


def plain_beats(local, period, tightness=100.0):
    near, far = math.floor(period / 2 + 0.5), math.floor(2 * period + 0.5)
    score, back = [], []
    for t, x in enumerate(local):
        best = max(((score[t - g] - tightness * math.log(g / period) ** 2, -g) for g in range(near, far + 1) if t - g >= 0), default=None)
        score.append(x + (best[0] if best else 0.0))
        back.append(t + best[1] if best else -1)
    tail = range(max(0, len(local) - math.ceil(period)), len(local))
    t, out = max(tail, key=lambda i: (score[i], -i)), []
    while t >= 0:
        out.append(t)
        t = back[t]
    out.reverse()
    least = 0.25 * sorted(local[b] for b in out)[len(out) // 2]
    while len(out) > 1 and local[out[0]] < least:
        out.pop(0)
    while len(out) > 1 and local[out[-1]] < least:
        out.pop()
    return out


@pytest.mark.parametrize(("period", "size", "width"), [(4.0, 1024, 64), (4.0, 16, 3), (7.3, 31, 2), (20.0, 90, 4)])
def test_beats_equal_the_recurrence(spark, period, size, width):
    rng = np.random.default_rng(4)
    tracks = {"noise": rng.uniform(0, 1, 700), "short": rng.uniform(0, 1, 5), "one": np.array([1.0]), "fade": np.concatenate([np.full(60, 0.001), rng.uniform(0, 1, 300), np.full(77, 0.001)])}
    clicks = np.full(500, 0.01)
    clicks[3 :: int(round(period))] = 1.0
    tracks["clicks"] = clicks
    df = spark.createDataFrame([(t, i, float(v)) for t, x in tracks.items() for i, v in enumerate(x)], "track string, i long, x double").repartition(3)
    local = strengths(df, period)
    got = {}
    for r in local.collect():
        got.setdefault(r.track, {})[r.i] = r.x
    assert all(np.allclose([got[t][i] for i in range(len(x))], plain_strength(x, period)) for t, x in tracks.items())
    found = {t: [] for t in tracks}
    for r in beats_of(local, period, size=size, width=width).orderBy("i").collect():
        found[r.track].append(r.i)
    assert found == {t: plain_beats(plain_strength(x, period), period) for t, x in tracks.items()}


def test_no_frames(spark):
    assert beats_of(spark.createDataFrame([], "track string, i long, x double"), 4.0).count() == 0


def test_onsets_are_read_once(spark):
    """Neither the strengths, nor those of the beats, are worked out again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for p in batches:
            seen.add(len(p))
            yield p

    x = np.random.default_rng(2).uniform(0, 1, 300)
    df = spark.createDataFrame([(t, i, float(v)) for t in range(4) for i, v in enumerate(x[: 300 - 40 * t])], "track long, i long, x double")
    found = beats_of(strengths(df.mapInPandas(counted, df.schema), 4.0), 4.0, size=32, width=3)
    want = {(t, b) for t in range(4) for b in plain_beats(plain_strength(x[: 300 - 40 * t], 4.0), 4.0)}
    assert {(r.track, r.i) for r in found.collect()} == want and seen.value == df.count()
    assert {(r.track, r.i) for r in beats(df, 4.0, size=32, width=3).collect()} == want


def test_unknown_onsets_add_nothing(spark):
    df = spark.createDataFrame([(1, i, None if i == 5 else 1.0 + i % 3) for i in range(12)], "track long, i long, x double")
    x = np.array([0.0 if i == 5 else 1.0 + i % 3 for i in range(12)])
    got = [r.x for r in strengths(df, 4.0).orderBy("i").collect()]
    assert np.allclose(got, plain_strength(x, 4.0) * np.sqrt(11 / 12))
