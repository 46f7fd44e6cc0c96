"""Compressor and limiter over chunks against the plain recurrences."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.operators import dynamics as D
from cadenza.operators import signal as S
from cadenza.sources.dimensions import device_stages


def plain_states(x, attack, release):
    g, out = 0.0, []
    for v in x:
        g = v + (g - v) * (attack if v > g else release)
        out.append(g)
    return out


@pytest.mark.parametrize("attack,release", [(0.3, 0.5), (0.5, 0.3), (0.0, 0.0)])
def test_smoothed_over_chunks(spark, attack, release):
    x = np.random.default_rng(1).uniform(0, 20, 700)
    df = spark.createDataFrame(pd.DataFrame({"track": 1, "b": range(700), "x": x, "attack": attack, "release": release}))
    got = D.smoothed(df, ["track"], max(attack, release), size=64).orderBy("b").toPandas()
    assert list(got.b) == list(range(700))
    np.testing.assert_allclose(got.x, plain_states(x, attack, release), atol=1e-9)


def test_glued_against_plain(spark):
    """A loud passage in a quiet track; the other track is silent and stays as it is."""
    rng = np.random.default_rng(2)
    n, block, rate = 1050, 10, 1000.0
    left = rng.uniform(-1, 1, n) * np.where((np.arange(n) > 300) & (np.arange(n) < 600), 1.0, 0.05)
    right = 0.5 * left
    both = pd.concat([pd.DataFrame({"track": 1, "i": range(n), "l": left, "r": right}), pd.DataFrame({"track": 2, "i": range(25), "l": 0.0, "r": 0.0})])
    got = D.glued(spark.createDataFrame(both), rate, 0.5, 3.0, 0.02, 0.05, block).orderBy("track", "i").toPandas()
    power = np.pad((left**2 + right**2) / 2, (0, -n % block)).reshape(-1, block).mean(1)
    level = 10 * np.log10(power + 1e-12)
    over = level - np.quantile(level[level > -60], 0.5)
    x = [v * 2 / 3 if v > 3 else 2 / 3 * (v + 3) ** 2 / 12 if v > -3 else 0.0 for v in over]
    g = 10 ** (-np.array(plain_states(x, math.exp(-1 / 2), math.exp(-1 / 5))) / 20)
    then = np.append(g[1:], g[-1])
    want = left * np.array([g[i // block] + (then[i // block] - g[i // block]) * (i % block) / block for i in range(n)])
    np.testing.assert_allclose(got[got.track == 1].l, want, atol=1e-9)
    assert got[got.track == 1].r.abs().max() < 0.5 and (got[got.track == 2].l == 0).all() and len(got) == n + 25


def test_limited_over_chunks_is_the_limiter(spark):
    x = np.random.default_rng(3).normal(0, 1, 500)
    df = spark.createDataFrame(pd.DataFrame({"track": 1, "i": range(500), "l": x, "r": 0.3 * x}))
    got = D.limited(df, 0.7, 5, 0.1, size=32).orderBy("i").toPandas()
    np.testing.assert_allclose(got.l, x * S.limiter(x, 0.7, 5, 0.1), atol=1e-9)
    np.testing.assert_allclose(got.r, 0.3 * got.l, atol=1e-9)
    assert got.l.abs().max() <= 0.7 + 1e-9
    with pytest.raises(ValueError):
        D.limited(df, 0.7, 0, 0.1)


def test_delivery_gain(spark):
    df = spark.createDataFrame([(-20.0,), (-3.0,), (None,), (float("-inf"),), (float("nan"),)], "lufs double")
    got = [v.g for v in df.select(D.delivery_gain(F.col("lufs")).alias("g")).collect()]
    np.testing.assert_allclose(got, [1.0, 10 ** (-4 / 20), 1.0, 1.0, 1.0])


def test_devices_have_their_stages(spark):
    d = {v.device: v for v in device_stages(spark).collect()}
    assert len(d) == 9 and d["studio"].compressor is None and d["car"].noise.kind == "road" and d["club"].reverb.wet == 0.16 and d["phone"].mono


def test_smoothed_steps_many_chunks_at_once(spark):
    """No group of its own for each chunk of each track."""
    df = spark.range(4000).selectExpr("id div 10 AS track", "id % 10 AS b", "cast(id % 7 AS double) AS x", "0.5D AS attack", "0.25D AS release")
    out = D.smoothed(df, ["track"], 0.5)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 4000
    state = 0.0
    for r in out.where("track = 399").orderBy("b").collect():
        x = float((3990 + r.b) % 7)
        state = x + (state - x) * (0.5 if x > state else 0.25)
        assert abs(r.x - state) < 1e-12


def test_limited_has_no_group_for_each_chunk(spark):
    """Tracks that end at, before and behind a chunk's border, all in one pass over batches."""
    df = spark.createDataFrame([(f"t{n}", i, math.sin(i * n) * 2, 0.1) for n in (1, 31, 32, 33, 64) for i in range(n)], "track string, i long, l double, r double")
    whole, cut = (D.limited(df, 0.7, 5, 0.1, size=s) for s in (4096, 32))
    assert "FlatMapGroupsInPandas" not in cut._jdf.queryExecution().executedPlan().toString()
    assert np.allclose(*[np.array(x.orderBy("track", "i").select("l", "r").collect()) for x in (whole, cut)], atol=1e-12) and cut.count() == 161
