"""Sections of a song: guard passes over the runs of one track's units, from curves that Spark has made for every unit.

A track has some hundreds of units and some tens of runs. Each pass takes a list of runs and gives another; a unit is a
stretch of time, `bar` marks the units at which a bar begins, and `per_bar` units make a bar.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ..settings import Tuning

Run = tuple[int, int, int]


@dataclass(frozen=True)
class Curves:
    """What is known of each unit of a track: energy, voice and repetition (0 to 1), level in dB, cluster, bar, and timbre."""

    energy: np.ndarray
    vocal: np.ndarray
    lyric: np.ndarray
    level: np.ndarray
    cluster: np.ndarray
    bar: np.ndarray
    timbre: np.ndarray
    per_bar: int
    unit_sec: float
    tuning: Tuning

    def __len__(self) -> int:
        return len(self.energy)


def mean(x: np.ndarray, a: int, b: int) -> float:
    """Mean of x[a:b] inside the track; 0 where nothing is left."""
    part = x[max(0, a) : max(0, b)]
    return float(part.mean()) if len(part) else 0.0


def runs_of(values: np.ndarray) -> list[Run]:
    """Runs (start, stop, value) of equal values."""
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return [(a, b, int(values[a])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def joined(runs: list[Run]) -> list[Run]:
    """Touching runs of one value as one."""
    out: list[Run] = []
    for a, b, c in runs:
        if out and out[-1][2] == c and out[-1][1] == a:
            out[-1] = (out[-1][0], b, c)
        else:
            out.append((a, b, c))
    return out


def absorbed(runs: list[Run], least: int) -> list[Run]:
    """The shortest run under `least` units (the first of such) goes to the longer neighbour, the one before in a tie or
    where both have one value, until no run is so short or one is left."""
    while len(runs) > 1:
        size, k = min((b - a, k) for k, (a, b, _) in enumerate(runs))
        if size >= least:
            break
        sides = [j for j in (k - 1, k + 1) if 0 <= j < len(runs)]
        into = sides[0] if len(sides) == 2 and runs[sides[0]][2] == runs[sides[1]][2] else max(sides, key=lambda j: (runs[j][1] - runs[j][0], -j))
        lo, hi = min(k, into), max(k, into)
        runs = joined([*runs[:lo], (runs[lo][0], runs[hi][1], runs[into][2]), *runs[hi + 1 :]])
    return runs


def refined(runs: list[Run], t: Curves) -> list[Run]:
    """Each border at the bar, some bars around it, where timbre and energy change most between the bars before and after."""
    reach, width = t.tuning.refine_bars * t.per_bar, t.per_bar

    def change(c: int) -> float:
        a, b = max(0, c - width), min(len(t), c + width)
        if a == c or b == c:
            return 0.0
        apart = t.timbre[a:c].mean(0) - t.timbre[c:b].mean(0)
        return float(apart @ apart) + 4 * (mean(t.energy, a, c) - mean(t.energy, c, b)) ** 2

    borders = [0]
    for a, b, _ in runs[1:]:
        bars = [c for c in range(max(borders[-1] + 1, a - reach), min(b - 1, a + reach) + 1) if t.bar[c]]
        borders.append(max(bars, key=lambda c: (change(c), -c)) if bars else a)
    return [(a, b, r[2]) for a, b, r in zip(borders, [*borders[1:], len(t)], runs, strict=True)]


def smoothed(x: np.ndarray, width: int) -> np.ndarray:
    """Centred means of an odd number of values, of fewer at the ends."""
    half, total = width // 2, np.concatenate([[0.0], np.cumsum(x)])
    i = np.arange(len(x))
    a, b = np.maximum(0, i - half), np.minimum(len(x), i + half + 1)
    return (total[b] - total[a]) / (b - a)


def threshold(x: np.ndarray) -> float:
    """Of 59 quantiles the one that parts the values with the largest variance between both sides; the first in a tie."""
    line = np.sort(x)
    best, found = -1.0, float(line[len(line) // 2])
    for q in range(1, 60):
        at = line[int(q / 60 * (len(line) - 1))]
        low = x <= at
        if low.all() or not low.any():
            continue
        share = low.mean()
        apart = share * (1 - share) * (x[low].mean() - x[~low].mean()) ** 2
        if apart > best:
            best, found = apart, float(at)
    return found


def repeats(t: Curves, segments: list[Run]) -> list[list[int]]:
    """Stretches [start, stop) that come back: where the smoothed repetition passes its threshold, gaps under two bars
    closed and stretches under four left out. Without a clear contrast, the cluster that repeats most and is loudest."""
    bar = t.per_bar
    curve = smoothed(t.lyric, max(1, math.floor(t.tuning.chorus_sec / t.unit_sec + 0.5)) | 1)
    on = curve > threshold(curve)
    inside = mean(curve[on], 0, len(t)) - mean(curve[~on], 0, len(t)) if on.any() else -1.0
    out: list[list[int]] = []
    for a, b, v in runs_of(on.astype(int)) if inside >= t.tuning.least_contrast else []:
        if v and out and a - out[-1][1] < 2 * bar:
            out[-1][1] = b
        elif v:
            out.append([a, b])
    out = [r for r in out if r[1] - r[0] >= 4 * bar]
    if out:
        return out

    def worth(c: int) -> float:
        own = [r for r in segments if r[2] == c]
        each = lambda x: sum(mean(x, a, b) for a, b, _ in own) / len(own)
        return each(t.lyric) + 0.5 * each(t.energy) + (0.3 if len(own) >= 2 else 0.0)

    best = max(dict.fromkeys(c for _, _, c in segments), key=lambda c: round(worth(c), 9))
    return [[a, b] for a, b, c in segments if c == best]


def edged(t: Curves, stretches: list[list[int]]) -> list[list[int]]:
    """Both ends at the bar, two bars around, where the repetition steps up or down most."""
    bar, n = t.per_bar, len(t)

    def edge(i: int, lo: int, hi: int, up: int) -> int:
        if not 0 < i < n:
            return i
        step = lambda c: mean(t.lyric, c, c + 2 * bar) - mean(t.lyric, c - 2 * bar, c)
        bars = [c for c in range(max(lo + 1, i - 2 * bar), min(hi - 1, i + 2 * bar, n - 1) + 1) if t.bar[c]]
        return max(bars, key=lambda c: (round(up * step(c), 9), -c)) if bars else i

    out = []
    for a, b in stretches:
        a = edge(a, 0, b, 1)
        out.append([a, edge(b, a, n + 1, -1)])
    return out


def loud_enough(t: Curves, stretches: list[list[int]], segments: list[Run]) -> list[list[int]]:
    """Without the parts, cut at segment borders, that are much quieter than the loudest: a verse sung twice alike, or an
    intro and its echo, repeat too but are no chorus. If less than four bars would be left everywhere, all stay."""
    bar, parts = t.per_bar, []
    for a, b in stretches:
        cuts = [a, *(s for s, _, _ in segments if a < s < b), b]
        parts += [(x, y, mean(t.energy, x, y)) for x, y in zip(cuts, cuts[1:], strict=False)]
    if not parts:
        return stretches
    top = max(e for x, y, e in ([p for p in parts if p[1] - p[0] >= 4 * bar] or parts))
    kept: list[list[int]] = []
    for x, y, e in parts:
        if e >= top - t.tuning.chorus_energy_gap or y - x < 2 * bar:
            if kept and kept[-1][1] == x:
                kept[-1][1] = y
            else:
                kept.append([x, y])
    return [r for r in kept if r[1] - r[0] >= 4 * bar] or stretches


def without_intro(t: Curves, stretches: list[list[int]], segments: list[Run]) -> list[list[int]]:
    """A first stretch at the very start, quieter than the others, is an intro that uses later music: it goes, or, if it is
    long, begins at the next segment."""
    if len(stretches) < 2 or stretches[0][0] != 0:
        return stretches
    (a, b), others = stretches[0], np.concatenate([t.energy[x:y] for x, y in stretches[1:]])
    if mean(t.energy, a, b) >= mean(others, 0, len(others)) - t.tuning.intro_energy_gap:
        return stretches
    if (b - a) * t.unit_sec <= t.tuning.intro_max_sec:
        return stretches[1:]
    cut = next((s for s, _, _ in segments if a + 2 * t.per_bar < s < b and (s - a) * t.unit_sec <= t.tuning.intro_max_sec), a)
    return [[cut, b], *stretches[1:]]


def pieces_of(t: Curves, choruses: list[list[int]], segments: list[Run]) -> list[list]:
    """[start, stop, chorus]: the choruses, and the segments between them; pieces under two bars go to a neighbour, one that
    is no chorus if there is such, the one before if both are; choruses that touch are one."""
    cuts = sorted({0, len(t), *(x for r in choruses for x in r), *(s for s, _, _ in segments if not any(a < s < b for a, b in choruses))})
    parts = [[x, y, any(a <= x and y <= b for a, b in choruses)] for x, y in zip(cuts, cuts[1:], strict=False)]
    while len(parts) > 1:
        k = next((k for k, (a, b, chorus) in enumerate(parts) if not chorus and b - a < 2 * t.per_bar), None)
        if k is None:
            break
        sides = [j for j in (k - 1, k + 1) if 0 <= j < len(parts)]
        into = next((j for j in sides if not parts[j][2]), sides[0])
        parts[into] = [min(parts[into][0], parts[k][0]), max(parts[into][1], parts[k][1]), parts[into][2]]
        del parts[k]
    out: list[list] = []
    for a, b, chorus in parts:
        if out and chorus and out[-1][2]:
            out[-1][1] = b
        else:
            out.append([a, b, chorus])
    return out


def named(t: Curves, pieces: list[list], segments: list[Run]) -> list[tuple[int, int, int, str]]:
    """(start, stop, cluster, kind) of each piece, from its length, energy, voice and neighbours."""
    bar_sec = t.unit_sec * t.per_bar

    def cluster(a: int, b: int) -> int:
        values, first, n = np.unique(t.cluster[a:b], return_index=True, return_counts=True)
        return int(values[min(range(len(values)), key=lambda k: (-n[k], first[k]))])

    group = [cluster(a, b) for a, b, _ in pieces]
    energy, vocal = ([mean(x, a, b) for a, b, _ in pieces] for x in (t.energy, t.vocal))
    chorus = [c for *_, c in pieces]
    first = chorus.index(True) if True in chorus else -1
    middle, last = float(np.percentile(energy, 50)), len(pieces) - 1
    own = [g for g, c in zip(group, chorus, strict=True) if not c]

    def kind(k: int) -> str:
        sec = (pieces[k][1] - pieces[k][0]) * t.unit_sec
        low = energy[k] < middle - 0.1
        if chorus[k]:
            return "chorus"
        if k == 0 and first > 0 and (sec <= 12 or (sec <= 40 and (low or vocal[k] < 0.3))):
            return "intro"
        if k == last and last >= 2 and (sec <= 16 or low):
            return "outro"
        if k < last and chorus[k + 1] and 3.5 <= sec / bar_sec <= 10.5 and k >= 2 and not chorus[k - 1] and group[k - 1] != group[k]:
            return "prechorus"
        if energy[k] < middle - 0.3 and vocal[k] < 0.4:
            return "break"
        if 0 <= first < k < last and own.count(group[k]) == 1 and group[k] not in group[:first]:
            return "bridge"
        return "verse"

    kinds = [kind(k) for k in range(len(pieces))]
    out: list[tuple[int, int, int, str]] = []
    for k, (a, b, _) in enumerate(pieces):
        # a short quiet lead-in that is glued to a chorus is its pre-chorus
        bar, cut = t.per_bar, None
        if chorus[k] and k and kinds[k - 1] != "prechorus":
            inner = [s for s, _, _ in segments if a < s < b]
            cut = next((s for s in inner if 4 * bar <= s - a <= 10 * bar and b - s >= 4 * bar and mean(t.energy, a, s) < mean(t.energy, s, b) - t.tuning.pre_energy_gap), None)
        out += [(a, b, group[k], kinds[k])] if cut is None else [(a, cut, cluster(a, cut), "prechorus"), (cut, b, cluster(cut, b), "chorus")]
    return out


def sections(t: Curves) -> list[tuple[int, int, str, str, float, float, float]]:
    """(start, stop, letter, kind, energy, vocal, level) of a track's sections: letters by material in order of appearance;
    neighbours of one kind are one section."""
    n = len(t)
    power = lambda a, b: 10 * math.log10(float(np.mean(10 ** (t.level[a:b] / 10))) + 1e-12)
    if n < 8:
        return [(0, n, "A", "chorus", mean(t.energy, 0, n), mean(t.vocal, 0, n), mean(t.level, 0, n))]
    segments = refined(absorbed(runs_of(t.cluster), t.per_bar * t.tuning.least_bars), t)
    choruses = loud_enough(t, edged(t, repeats(t, segments)), segments)
    found = named(t, pieces_of(t, without_intro(t, choruses, segments), segments), segments)
    letters: dict[str, str] = {}
    out: list[tuple[int, int, str, str, float, float, float]] = []
    for a, b, group, kind in found:
        letter = letters.setdefault(kind if kind in ("chorus", "prechorus") else str(group), chr(65 + min(25, len(letters))))
        if out and out[-1][3] == kind:
            a, letter = out[-1][0], out[-1][2]
            out.pop()
        out.append((a, b, letter, kind, mean(t.energy, a, b), mean(t.vocal, a, b), power(a, b)))
    return out


@dataclass(frozen=True)
class Hook:
    """The most hook-like stretch of a track: units start to stop, how sure that is, where else it stands, the share of
    units whose stretch comes back, and the hookness of every unit."""

    start: int
    stop: int
    confidence: float
    places: list[int]
    repetition: float
    hookness: np.ndarray


def alike(chroma: np.ndarray, timbre: np.ndarray, weight: float) -> np.ndarray:
    """Similarity (0 to 1) of all pairs of a track's units: chroma counts `weight`, timbre the rest."""
    return weight * (chroma @ chroma.T + 1) / 2 + (1 - weight) * (timbre @ timbre.T + 1) / 2


def along(similar: np.ndarray, length: int) -> np.ndarray:
    """Mean similarity of the stretches of `length` units from i and from j on, for all i and j."""
    n = len(similar)
    total = np.zeros((n + 1, n + 1))
    for i in range(n):
        total[i + 1, 1:] = total[i, :-1] + similar[i]
    m = max(0, n - length + 1)
    return (total[length : length + m, length : length + m] - total[:m, :m]) / length


def _spread(d: np.ndarray, length: int, percent: float) -> float | None:
    """A percentile of every second stretch against every second one behind it."""
    m = len(d)
    values = np.concatenate([d[i, i + length :: 2] for i in range(0, m, 2)] or [np.empty(0)])
    return float(np.percentile(values, percent)) if len(values) else None


def hook_of(t: Curves, chroma: np.ndarray) -> Hook:
    """Stretches of four bars (a quarter of a short track) are compared by harmony: a stretch repeats where it stands out
    along its row. Repeats, repetition curve, energy and voice are weighed; stretches that begin with a bar come first. Other
    places of the hook must be alike in timbre too, nearly as much as the best of them, and a stretch apart."""
    n, tune = len(t), t.tuning
    length = max(4, min(4 * t.per_bar, n // 4))
    d = along(alike(chroma, t.timbre, 0.75), length)
    m = len(d)
    if not m:
        return Hook(0, n, 0.0, [], 0.0, np.zeros(n))
    found = _spread(d, length, 88)
    theta = max(0.62, 0.8 if found is None else found)
    before, after = (np.pad(d, ((0, 0), side))[:, cut] for side, cut in (((1, 0), slice(0, m)), ((0, 1), slice(1, m + 1))))
    apart = np.abs(np.arange(m)[:, None] - np.arange(m)) >= length
    match = apart & (d > theta) & (d >= before) & (d >= after)
    count = match.sum(1)
    strength = np.where(match, d, 0).sum(1) / np.maximum(count, 1)
    repeat = np.minimum(1, count / 3) * np.clip((strength - theta) / (1 - theta + 1e-12) * 0.5 + 0.5, 0, 1)
    behind = lambda x: np.array([mean(x, i, i + length) for i in range(m)])
    score = tune.hook_repeats * repeat + tune.hook_lyric * behind(t.lyric) + tune.hook_energy * behind(t.energy) + tune.hook_vocal * behind(t.vocal)
    placed = np.round(score * np.where(t.bar[:m], 1.0, 0.92), 9)
    at = int(placed.argmax())
    near = along(alike(chroma, t.timbre, 0.55), length)
    found = _spread(near, length, 85)
    others = np.flatnonzero(match[at] & (near[at] > max(0.6, 0.8 if found is None else found)))
    close = [int(j) for j in others if near[at, j] >= near[at, others].max() - 0.05 and d[at, j] >= d[at, others].max() - 0.05]
    places: list[int] = []
    for j in sorted([at, *close]):
        if not places or j - places[-1] >= length:
            places.append(j)
    sure = min(1.0, max(0.0, float(placed[at]) * (1.1 if len(places) >= 2 else 0.6)))
    return Hook(at, min(n, at + length), sure, places, float((count > 0).mean()), np.concatenate([score, np.full(n - m, 0.5 * score[-1])]))
