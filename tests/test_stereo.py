"""Stereo report and high-band rises over chunks of frames against whole arrays."""

import numpy as np
import pandas as pd
import pytest

from cadenza.operators import signal as S
from cadenza.operators import stereo as T


def table(spark, left, right, track=1):
    return spark.createDataFrame(pd.DataFrame({"track": track, "i": range(len(left)), "l": np.asarray(left, float), "r": np.asarray(right, float)}))


@pytest.mark.parametrize("n", [16, 17, 16 + 8 * 64, 16 + 8 * 64 - 1, 1999])
def test_mean_spectra_of_any_length(spark, n):
    """16 samples a frame and a hop of 8: a chunk ends after 512 samples, and its last frame reaches beyond."""
    rng = np.random.default_rng(n)
    left, right = rng.normal(0, 1, (2, n))
    got = T.mean_spectra(table(spark, left, right), 16, 8).orderBy("bin").toPandas()
    np.testing.assert_allclose(got.mid, S.spectra((left + right) / 2, 16, 8).mean(0), atol=1e-12)
    np.testing.assert_allclose(got.side, S.spectra((left - right) / 2, 16, 8).mean(0), atol=1e-12)


def test_report_of_plain_cases(spark):
    t = np.arange(3000) / 8000
    low, high = np.sin(2 * np.pi * 60 * t), np.sin(2 * np.pi * 1000 * t)
    cases = {1: (high, high), 2: (high, -high), 3: (2 * high, 0 * high), 4: (low + high, low - high), 5: (high[:5], high[:5])}
    df = None
    for k, (left, right) in cases.items():
        df = table(spark, left, right, k) if df is None else df.unionByName(table(spark, left, right, k))
    got = {g.track: g for g in T.stereo_report(df, 8000.0, 256, 128).collect()}
    assert got[1].correlation == pytest.approx(1) and got[1].width == pytest.approx(0) and got[1].mono_loss_db == pytest.approx(0, abs=1e-9) and got[1].balance_db == pytest.approx(0)
    assert got[2].correlation == pytest.approx(-1) and got[2].width == pytest.approx(1) and got[2].mono_loss_db <= -100
    assert got[3].correlation == 1 and got[3].mono_loss_db == pytest.approx(-10 * np.log10(2), abs=1e-6) and got[3].balance_db > 100
    assert abs(got[4].correlation) < 0.1 and got[4].low_correlation > 0.95 and got[4].widths[2] > 0.95 and got[4].widths[0] < 0.05
    assert got[5].width == 0 and got[5].widths == [0.0] * 5


def test_rises_over_chunks(spark):
    """2,300 samples: the middle 2,000 give 248 frames of 16, in four chunks; a burst rises once."""
    rng = np.random.default_rng(4)
    x = 0.01 * rng.normal(0, 1, 2300)
    x[1500:] *= 100
    df = table(spark, x, x).selectExpr("track", "i", "l AS x")
    got = T.high_band_rises(df, 20000.0, 16, 8, above=5000.0, seconds=0.1).orderBy("f").toPandas()
    v = np.log1p(1e5 * S.spectra(x[150:2150], 16, 8)[: (2000 - 16) // 8, 4:].sum(1))
    np.testing.assert_allclose(got.rise, np.maximum(0, np.diff(v, prepend=v[0])), atol=1e-9)
    assert abs(int(got.rise.idxmax()) - 1350 // 8) <= 2


def test_short_and_empty(spark):
    assert T.high_band_rises(table(spark, [0.1] * 5, [0.1] * 5).selectExpr("track", "i", "l AS x"), 8000.0).count() == 0
    assert T.mean_spectra(table(spark, [0.1] * 5, [0.1] * 5), 16, 8).count() == 0


def test_report_of_long_and_short_tracks_at_once(spark):
    """A track of three chunks, one of less and one without a frame, in no groups of their own, against whole arrays."""
    rng = np.random.default_rng(9)
    x = {t: rng.normal(0, 1, (2, n)) for t, n in {1: 20000, 2: 700, 3: 40}.items()}
    df = table(spark, *x[1], 1).unionByName(table(spark, *x[2], 2)).unionByName(table(spark, *x[3], 3))
    report = T.stereo_report(df, 44100.0, 256, 128)
    spectra, rises = T.mean_spectra(df, 256, 128), T.high_band_rises(df.selectExpr("track", "i", "l AS x"), 44100.0, 64, 32)
    assert not any("FlatMapGroupsIn" in d._jdf.queryExecution().executedPlan().toString() for d in (report, spectra, rises))
    got = {g.track: g for g in report.collect()}
    b, a = T.low_pass(120.0, 0.707, 44100.0)
    for t, (left, right) in x.items():
        low_left, low_right = S.iir(left, b, a), S.iir(right, b, a)
        assert got[t].correlation == pytest.approx(left @ right / np.sqrt((left @ left) * (right @ right)), abs=1e-9)
        assert got[t].low_correlation == pytest.approx(low_left @ low_right / np.sqrt((low_left @ low_left) * (low_right @ low_right)), abs=1e-9)
        mid, side = (S.spectra(v / 2, 256, 128)[:, 1:117].sum() for v in (left + right, left - right))
        assert got[t].width == pytest.approx(side / (mid + side) if len(left) >= 256 else 0.0, abs=1e-9)
