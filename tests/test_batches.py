"""Work that is done for many tracks, blocks or points at once gives the same as one by one."""

import numpy as np

from cadenza.operators import signal as S
from cadenza.operators.scan import Release, states_before
from cadenza.plans.signals import spectra_of


def test_blocks_are_no_groups_of_their_own(spark):
    x = np.sin(np.arange(200) / 3)
    signal = spark.createDataFrame([(7, i, float(v)) for i, v in enumerate(x)], "track long, i long, x double")
    df = spectra_of(signal)
    got = {(r.block, r.bin): r.power for r in df.collect()}
    assert "FlatMapGroupsIn" not in df._jdf.queryExecution().executedPlan().toString()
    want = {(b, k): v for b in range(3) for k, v in enumerate(S.power_spectrum(x[64 * b : 64 * b + 64]))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_steady_notes_take_one_median_each(monkeypatch):
    calls, median = [], np.median
    monkeypatch.setattr(np, "median", lambda x: calls.append(1) or median(x))
    t = np.arange(400) / 100
    freq = np.where(np.arange(400) % 40 < 30, 440.0, 0.0)
    found = S.notes(t, freq, np.ones(400), np.full(400, 0.1))
    assert len(found) == 10 == len(calls) and found[0][:2] == (69, 0)


def test_jumps_inside_a_stretch_part_notes():
    t = np.arange(60) / 100
    freq = np.repeat([440.0, 494.0, 440.0], 20)
    assert [n[0] for n in S.notes(t, freq, np.ones(60), np.full(60, 0.1))] == [69, 71, 69]


def test_states_of_many_short_tracks_take_no_group_each(spark):
    maps = spark.createDataFrame([(t, k, [0.9 - t / 100, 0.5, 0.4]) for t in range(20) for k in range(1 + t % 3)], "track long, chunk long, m array<double>")
    for width in (2, 1024):
        df = states_before(maps, Release(0.5), width)
        got = {(r.track, r.chunk): r.state[0] for r in df.collect()}
        assert "FlatMapGroupsIn" not in df._jdf.queryExecution().executedPlan().toString()
        for t in range(20):
            state = 1.0
            for k in range(1 + t % 3):
                assert abs(got.pop((t, k)) - state) < 1e-12
                state = min(0.9 - t / 100, 0.5 * state + 0.4)
        assert not got
