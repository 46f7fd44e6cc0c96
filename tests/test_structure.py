"""Sections of planted songs, the guard passes on cases by hand and on random tracks, clusters of planted groups."""

import numpy as np
import pytest

from cadenza.functions.scalar import mulberry
from cadenza.operators import sections as P
from cadenza.operators import signal as S
from cadenza.plans import structure as T
from cadenza.settings import Tuning
from pyspark.sql import functions as F

BAR, SEC = 4, 0.5
FORM = [("intro", 4), ("verse", 8), ("chorus", 8), ("verse", 8), ("chorus", 8), ("verse", 8), ("chorus", 8), ("outro", 4)]


def planted(seed=1):
    """Units of a song: verses with the same chords and level but another melody each time, choruses that come back alike."""
    rng = np.random.default_rng(seed)
    chords = {"intro": (9, 5), "verse": (9, 5, 0, 7), "chorus": (5, 7, 0, 9), "outro": (9, 5)}
    bands = {k: rng.normal(size=24) for k in ("intro", "verse", "chorus")} | {}
    bands["outro"] = bands["intro"]
    refrain = rng.integers(0, 12, 32)
    rows, truth = [], []
    for kind, bars in FORM:
        melody = refrain if kind == "chorus" else rng.integers(0, 12, 32)
        truth.append((kind, len(rows), len(rows) + bars * BAR))
        for k in range(bars * BAR):
            chroma = np.full(12, 0.05)
            chroma[chords[kind][k // BAR % len(chords[kind])]] += 0.6
            lead = kind in ("verse", "chorus")
            if lead:
                chroma[melody[k % 32]] += 0.8
            timbre = bands[kind] + (0.8 * np.sin(np.arange(24) * (1 + melody[k % 32])) if lead else 0) + rng.normal(scale=0.05, size=24)
            level = {"intro": -24.0, "verse": -12.0, "chorus": -11.0, "outro": -26.0}[kind] + rng.normal(scale=0.3)
            rows.append(("s", len(rows), float(level), 0.5 if lead else 0.1, timbre.tolist(), (chroma + rng.normal(scale=0.01, size=12)).clip(0).tolist(), len(rows) % BAR == 0))
    return rows, truth


@pytest.fixture(scope="module")
def found(spark):
    rows, truth = planted()
    units = spark.createDataFrame(rows, "track string, u long, level double, vocal double, timbre array<double>, chroma array<double>, bar boolean")
    own = T.curves(units, BAR, SEC, Tuning())
    sections, hooks = (f(own, BAR, SEC, Tuning()) for f in (T.sections_of, T.hooks_of))
    return own, sections, hooks, truth


def overlap(rows, truth, kind):
    mine, want = ([(r.start, r.end) for r in rows if r.kind == kind], [(a, b) for k, a, b in truth if k == kind])
    both = sum(max(0, min(b, y) - max(a, x)) for a, b in mine for x, y in want)
    return both / max(1, sum(b - a for a, b in mine)), both / sum(b - a for a, b in want)


def test_sections_of_a_planted_song(found):
    own, sections, hooks, truth = found
    rows = sections.orderBy("run").collect()
    precision, recall = overlap(rows, truth, "chorus")
    assert precision > 0.75 and recall > 0.75 and overlap(rows, truth, "verse")[1] > 0.6, rows
    assert rows[0].kind == "intro" and rows[-1].kind == "outro"
    assert [r.start for r in rows[1:]] == [r.end for r in rows[:-1]] and rows[0].start == 0 and rows[-1].end == len(planted()[0])
    (hook,) = hooks.collect()
    assert any(k == "chorus" and a - BAR <= hook.start < b for k, a, b in truth) and len(hook.places) == 3 and hook.confidence > 0.5


def test_landmarks_and_clips(found):
    own, sections, hooks, truth = found
    (row,) = T.landmarks(own, sections, hooks, SEC).collect()
    first = next(a for k, a, _ in truth if k == "chorus")
    assert abs(row.intro - 8) <= 2 and first * SEC <= row.first_hook < (first + 8 * BAR) * SEC and abs(row.full_energy - 8) <= 3 and row.drops and abs(row.drops[0] - 8) <= 3 and 0 < row.lift < 2
    by_bar = sections.withColumns({c: F.ceil(F.col(c) / BAR) for c in ("start", "end")})
    clips = {c.kind: c for c in T.clips_of(T.bars_of(own, hooks, BAR, SEC), by_bar, T.CLIPS).collect()}
    assert clips["clip"].bars == 8 and any(k == "chorus" and a - BAR <= clips["clip"].start * BAR < b for k, a, b in truth) and clips["clip"].loop > 0.5


def test_absorbed():
    assert P.absorbed([(0, 2, 1), (2, 10, 2), (10, 11, 3), (11, 30, 2)], 4) == [(0, 30, 2)]
    assert P.absorbed([(0, 8, 1), (8, 10, 2), (10, 18, 3)], 4) == [(0, 10, 1), (10, 18, 3)]
    assert P.absorbed([(0, 1, 1)], 4) == [(0, 1, 1)]


def test_threshold_and_runs():
    x = np.concatenate([np.full(30, 0.1), np.full(30, 0.9)])
    assert P.threshold(x) == 0.1 and P.threshold(np.zeros(5)) == 0.0
    assert P.runs_of(np.array([2, 2, 0, 1, 1])) == [(0, 2, 2), (2, 3, 0), (3, 5, 1)]
    assert np.allclose(P.smoothed(np.arange(5.0), 3), [0.5, 1, 2, 3, 3.5])


@pytest.mark.parametrize("seed", range(40))
def test_laws_on_random_tracks(seed):
    """Whatever the curves: sections cover the track in order, neighbours differ, no piece but a chorus is under two bars
    unless it is the only one, and segments keep their least length."""
    rng = np.random.default_rng(seed)
    n, bar = int(rng.integers(1, 200)), int(rng.choice([2, 4]))
    walk = lambda: np.clip(np.cumsum(rng.normal(scale=0.2, size=n)) % 1, 0, 1)
    label = np.repeat(rng.integers(0, 4, n), rng.integers(1, 20))[:n]
    t = P.Curves(walk(), walk(), walk(), -20 * walk(), label, np.arange(n) % bar == 0, rng.normal(size=(n, 24)), bar, 0.5, Tuning())
    out = P.sections(t)
    assert out[0][0] == 0 and out[-1][1] == n and all(a[1] == b[0] and a[3] != b[3] for a, b in zip(out, out[1:]))
    segments = P.absorbed(P.runs_of(label), 4 * bar)
    assert len(segments) == 1 or all(b - a >= 4 * bar for a, b, _ in segments)
    assert all(x[2] != y[2] for x, y in zip(segments, segments[1:]))
    if n >= 8:
        pieces = P.pieces_of(t, P.edged(t, P.repeats(t, segments)), segments)
        assert len(pieces) == 1 or all(chorus or b - a >= 2 * bar for a, b, chorus in pieces)
    chroma = rng.normal(size=(n, 12))
    h = P.hook_of(t, chroma / np.linalg.norm(chroma, axis=1, keepdims=True))
    assert 0 <= h.start < max(1, n) and len(h.hookness) == n and 0 <= h.confidence <= 1 and 0 <= h.repetition <= 1


def test_stretches_along_the_diagonal():
    s = np.random.default_rng(2).normal(size=(9, 9))
    d = P.along(s, 4)
    assert d.shape == (6, 6) and all(np.isclose(d[i, j], np.mean([s[i + k, j + k] for k in range(4)])) for i in range(6) for j in range(6))


def test_segments_find_planted_groups():
    rng = np.random.default_rng(1)
    parts = [rng.normal(c, 0.3, (24, 12)) for c in (0, 3, 6)]
    x = np.concatenate([parts[k] + rng.normal(scale=0.02, size=(24, 12)) for k in (0, 1, 2, 0, 1)])
    label = S.segments(x, x, 4)
    parts = label.reshape(5, 24)
    assert all(np.bincount(p).max() >= 22 for p in parts)
    major = [int(np.bincount(p).argmax()) for p in parts]
    assert major[0] == major[3] and major[1] == major[4] and len(set(major)) == 3


def test_seeded_numbers_are_the_columns(spark):
    draw = S.random_numbers(7)
    want = [next(draw) for _ in range(20)]
    assert [r[0] for r in spark.range(20).select(mulberry(F.col("id"), F.lit(7).cast("long"))).collect()] == want
    assert sorted(np.bincount(S.kmeans(np.array([[0.0], [0.1], [5.0], [5.1], [9.0]]), 3))) == [1, 2, 2]
