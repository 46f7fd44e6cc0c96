"""Signal operators whose recurrences or transforms need a whole track: numpy inside applyInPandas, one group per track.

Spark groups and shuffles the samples; each function here is a small helper over one track's arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.scalar import MULBERRY_MASKS, MULBERRY_STEP


def per_track(df: DataFrame, keys: list[str], order: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over each track's rows in order; its frame gets the keys in front."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf.sort_values(order))
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{fields}, {schema}")


def iir(x: np.ndarray, b: tuple[float, float, float], a: tuple[float, float]) -> np.ndarray:
    """Biquad in transposed direct form II; each output needs the one before."""
    z1 = z2 = 0.0
    out = np.empty(len(x))
    for i, v in enumerate(x):
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a[0] * y + z2, b[2] * v - a[1] * y
        out[i] = y
    return out


def k_weighting(fs: float) -> list[tuple[tuple[float, float, float], tuple[float, float]]]:
    """The two stages of BS.1770 weighting at any rate, from the analogue prototypes of the standard."""
    out = []
    for f0, q, gain in ((1681.974450955533, 0.7071752369554196, 3.999843853973347), (38.13547087602444, 0.5003270373238773, None)):
        k = math.tan(math.pi * f0 / fs)
        a0 = 1 + k / q + k * k
        a = (2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)
        if gain is None:
            out.append(((1.0, -2.0, 1.0), a))
        else:
            vh = 10 ** (gain / 20)
            vb = vh**0.4996667741545416
            out.append((((vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0), a))
    return out


def power_spectrum(x: np.ndarray) -> np.ndarray:
    """Power of the Hann-windowed signal's non-negative frequencies, normalised by the window's energy; of each row, if x has rows."""
    n = x.shape[-1]
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    return np.abs(np.fft.rfft(x * w)) ** 2 / (np.sum(w * w) * n)


def spectra(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Power spectra (frames x bins) of all whole Hann-windowed frames of x."""
    if len(x) < size:
        return np.zeros((0, size // 2 + 1))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    return np.abs(np.fft.rfft(frames * w, axis=1)) ** 2 / (np.sum(w * w) * size)


def log_bands(size: int, fs: float, lo: float, hi: float, n: int) -> np.ndarray:
    """The log-spaced band of each bin from lo to hi, -1 outside and for bin 0."""
    edges = lo * (hi / lo) ** (np.arange(n + 1) / n)
    band = np.searchsorted(edges, np.arange(size // 2 + 1) * fs / size, side="right") - 1
    band[(band >= n) | (np.arange(len(band)) == 0)] = -1
    return band


def _summed(p: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the columns of p by group (those of -1 left out): frames x n."""
    return p[:, group >= 0] @ np.eye(n)[group[group >= 0]]


def frame_features(mid: np.ndarray, side: np.ndarray, fs: float, size: int, hop: int) -> dict[str, np.ndarray]:
    """Series of features per frame: level, low level, centroid, flatness, voice, 24 timbre bands in dB, 12 pitch classes."""
    eps = 1e-12
    pm, ps = spectra(mid, size, hop), spectra(side, size, hop)
    f = np.arange(pm.shape[1]) * fs / size
    inside = lambda lo, hi: (np.arange(len(f)) >= max(1, round(lo * size / fs))) & (np.arange(len(f)) <= min(len(f) - 1, round(hi * size / fs)))
    flat = lambda p: np.exp(np.log(p + eps).mean(1)) / np.maximum(p.mean(1), eps)
    total = pm[:, 1:].sum(1)
    note = 69 + 12 * np.log2(np.maximum(f, 1e-9) / 440)
    near = np.floor(note + 0.5)
    pitch = np.where((f >= 80) & (f <= 5000), near % 12, -1).astype(int)
    chroma = _summed(np.sqrt(pm) * np.maximum(0, 1 - 2 * np.abs(note - near)), pitch, 12)
    voice = inside(300, 3400)
    v_mid, v_side = pm[:, voice].sum(1), ps[:, voice].sum(1)
    frames = np.lib.stride_tricks.sliding_window_view(mid, size)[::hop] if len(mid) >= size else np.zeros((0, size))
    return {
        "rms_db": 10 * np.log10((frames**2).mean(1) + eps),
        "low_db": 10 * np.log10(pm[:, inside(20, 120)].sum(1) + eps),
        "centroid": (pm[:, 1:] @ f[1:]) / np.maximum(total, eps),
        "flatness": flat(pm[:, inside(100, 8000)]),
        "vocal": v_mid / np.maximum(total, eps) * v_mid / np.maximum(v_mid + v_side, eps) * (1 - np.minimum(1, 2 * flat(pm[:, voice]))),
        "timbre": 10 * np.log10(_summed(pm + ps, log_bands(size, fs, 30, min(16000, fs / 2 - 1), 24), 24) + eps),
        "chroma": chroma / np.maximum(chroma.sum(1, keepdims=True), eps),
    }


def autocorrelation(x: np.ndarray, most: int) -> np.ndarray:
    """Unbiased autocorrelation for lags 0 to most, by FFT."""
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x - x.mean(), size)
    return np.fft.irfft(f * np.conj(f), size)[: most + 1] / (n - np.arange(most + 1))


def sinc_phases(over: int = 4, taps: int = 16) -> np.ndarray:
    """Weights (taps x over - 1) of the samples around a place, from taps / 2 - 1 before it on, for the points behind it."""
    u = np.arange(-taps // 2 + 1, taps // 2 + 1)[:, None] - np.arange(1, over) / over
    h = np.sinc(u) * (0.5 + 0.5 * np.cos(np.pi * u / (taps / 2)))
    return h / h.sum(0)


def between_samples(x: np.ndarray, at: np.ndarray, over: int = 4, taps: int = 16) -> float:
    """Largest level of the `over` - 1 points behind each place in `at`, by windowed-sinc interpolation; x reaches `taps` samples
    beyond all places."""
    t = np.arange(-taps // 2 + 1, taps // 2 + 1)
    return float(np.abs(x[at[:, None] + t] @ sinc_phases(over, taps)).max()) if len(at) else 0.0


def true_peak(x: np.ndarray, over: int = 4, taps: int = 16) -> float:
    """Largest level at and between samples, looked for around the loudest ones."""
    if not len(x):
        return 0.0
    top = float(np.abs(x).max())
    return max(top, between_samples(np.pad(x, taps), np.flatnonzero(np.abs(x) >= 0.5 * top) + taps, over, taps))


def yin(x: np.ndarray, fs: float, lo: float = 70.0, hi: float = 1100.0, threshold: float = 0.12) -> tuple[float, float]:
    """Pitch and clarity of one frame: cumulative-mean-normalised difference, first dip below the threshold."""
    most = int(fs / lo)
    w = len(x) - most
    if w < 32 or math.sqrt(float(np.mean(x * x))) < 0.004:
        return 0.0, 0.0
    lags = np.lib.stride_tricks.sliding_window_view(x, w)[: most + 1]
    d = np.sum((lags - x[:w]) ** 2, axis=1)
    c = np.ones(most + 1)
    c[1:] = d[1:] * np.arange(1, most + 1) / np.maximum(np.cumsum(d[1:]), 1e-12)
    first = max(2, int(fs / hi))
    below = np.flatnonzero(c[first:most] < threshold)
    t = first + int(below[0]) if len(below) else first + int(np.argmin(c[first:most]))
    while t + 1 < most and c[t + 1] < c[t]:
        t += 1
    if c[t] > 0.35:
        return 0.0, 0.0
    bend = c[t - 1] - 2 * c[t] + c[t + 1]
    shift = 0.5 * (c[t - 1] - c[t + 1]) / bend if bend else 0.0
    return fs / (t + shift), float(1 - c[t])


def limiter(x: np.ndarray, ceiling: float, look: int, release: float) -> np.ndarray:
    """Gain that keeps |x * gain| under the ceiling: needed gain, forward minimum, box mean, slow release."""
    need = np.minimum(1.0, ceiling / np.maximum(np.abs(x), 1e-12))
    ahead = np.lib.stride_tricks.sliding_window_view(np.pad(need, (0, look - 1), constant_values=1.0), look).min(1)
    box = np.lib.stride_tricks.sliding_window_view(np.pad(ahead, (look - 1, 0), mode="edge"), look).mean(1)
    gain, g = np.empty(len(x)), 1.0
    for i, b in enumerate(box):
        g = b if b < g else g + (b - g) * release
        gain[i] = min(g, need[i])
    return gain


def compressor(x: np.ndarray, threshold_db: float, ratio: float, block: int, attack: float, release: float) -> np.ndarray:
    """Gain in dB per block from its level above the threshold, smoothed with attack and release, interpolated to samples."""
    n = -(-len(x) // block)
    padded = np.pad(x, (0, n * block - len(x)))
    level = 10 * np.log10(np.maximum((padded.reshape(n, block) ** 2).mean(1), 1e-12))
    want = -np.maximum(0, level - threshold_db) * (1 - 1 / ratio)
    out, g = np.empty(n), 0.0
    for i, v in enumerate(want):
        g += (v - g) * (attack if v < g else release)
        out[i] = g
    return 10 ** (np.interp(np.arange(len(x)), (np.arange(n) + 0.5) * block, out) / 20)


def center(left: np.ndarray, right: np.ndarray, size: int = 256) -> np.ndarray:
    """What both channels share: per bin similarity of panning weighs the mid signal, overlap-added."""
    hop, w = size // 2, np.hanning(size + 1)[:size]
    out = np.zeros(len(left) + size)
    for s in range(0, max(1, len(left) - size + 1), hop):
        a, b = (np.fft.rfft(w * np.pad(c[s : s + size], (0, max(0, size - len(c[s : s + size]))))) for c in (left, right))
        same = 2 * np.abs(a * np.conj(b)) / (np.abs(a) ** 2 + np.abs(b) ** 2 + 1e-12)
        out[s : s + size] += np.fft.irfft(same * (a + b) / 2)
    return out[: len(left)]


def notes(t: np.ndarray, freq: np.ndarray, clarity: np.ndarray, rms: np.ndarray, least: float = 0.09, gap: float = 0.05) -> list[tuple[int, int, float, float, int]]:
    """Notes (midi, cents, start, end, velocity) of a pitch contour: a gap, or a jump from the median of the last six, ends one."""
    return list(zip(*(c.tolist() for c in notes_by_track(np.zeros(len(t), int), t, freq, clarity, rms, least, gap)[1:]), strict=True))


def notes_by_track(track: np.ndarray, t: np.ndarray, freq: np.ndarray, clarity: np.ndarray, rms: np.ndarray, least: float = 0.09, gap: float = 0.05) -> tuple[np.ndarray, ...]:
    """The notes of many contours at once, as columns with the number of their track in front; points come by track and time."""
    sounding = np.flatnonzero((freq > 0) & (clarity >= 0.6))
    if not len(sounding):
        return tuple(np.zeros(0, kind) for kind in (int, int, int, float, float, int))
    own, at, pitch = track[sounding], t[sounding], 69 + 12 * np.log2(freq[sounding] / 440)
    first = np.concatenate([[0], np.flatnonzero((np.diff(at) > gap) | (np.diff(own) != 0)) + 1])
    steady = np.maximum.reduceat(pitch, first) - np.minimum.reduceat(pitch, first) <= 0.7  # none is a jump from a median of others
    cuts = []
    for lo, hi in zip(first[~steady], np.append(first[1:], len(at))[~steady], strict=True):
        for k in range(lo + 1, hi):
            if abs(pitch[k] - np.median(pitch[max(lo, k - 6) : k])) > 0.7:
                cuts.append(k)
                lo = k
    first = np.sort(np.concatenate([first, np.array(cuts, int)]))
    n = np.diff(np.append(first, len(at)))
    whole = at[first + n - 1] - at[first] >= least
    loud = np.maximum.reduceat(rms[sounding], first)[whole]
    first, n = first[whole], n[whole]
    p = np.array([np.median(pitch[a : a + m]) for a, m in zip(first, n, strict=True)], float)
    note = np.floor(p + 0.5)
    return own[first], note.astype(int), np.floor(100 * (p - note) + 0.5).astype(int), at[first], at[first + n - 1], np.clip(np.floor(40 + 600 * loud + 0.5), 20, 127).astype(int)


def _middle(x: np.ndarray) -> float:
    """The upper median, 0 of nothing."""
    return float(np.sort(x)[len(x) // 2]) if len(x) else 0.0


def running_median(x: np.ndarray, size: int) -> np.ndarray:
    """Centred upper medians of `size` values, of fewer at the ends."""
    half = size // 2
    return np.array([_middle(x[max(0, i - half) : i + half + 1]) for i in range(len(x))])


def embedding(repeats: np.ndarray, path: np.ndarray, vectors: int = 10, steps: int = 4, smoothing: int = 9) -> np.ndarray:
    """First eigenvectors (units x vectors, smoothed) of the normalised Laplacian of a track's graph, whose nodes are bounded.

    Edges join units that are mutual neighbours by `repeats` (each with those around it), kept where whole stretches
    repeat (median along the diagonals), and successive units by how alike they are in `path`; a common weight balances both.
    """
    n = len(repeats)
    around = repeats[np.clip(np.arange(n)[:, None] - steps // 2 + np.arange(steps), 0, n - 1)].reshape(n, -1)
    d = np.stack([np.sqrt(((around - row) ** 2).sum(1)) for row in around])
    far = np.abs(np.arange(n)[:, None] - np.arange(n)) >= 3
    k = max(1, min(n - 7, 2 * math.ceil(math.sqrt(max(0, n - 5)))))
    order = np.argsort(np.where(far, d, np.inf), axis=1, kind="stable")[:, :k]
    near = np.zeros((n, n), bool)
    near[np.arange(n)[:, None], order] = True
    near &= far
    last = [d[i, order[i][far[i, order[i]]][-1]] if near[i].any() else 1.0 for i in range(n)]
    link = np.where(near & near.T, np.exp(-d / (_middle(np.array(last)) or 1.0)), 0.0)
    kept = np.zeros((n, n))
    for lag in range(1, n):
        i = np.arange(n - lag)
        kept[i, i + lag] = kept[i + lag, i] = running_median(link[i, i + lag], 7)
    step = ((path[1:] - path[:-1]) ** 2).sum(1)
    step = np.exp(-step / (_middle(step) or 1.0))
    by_step = np.concatenate([step, [0.0]]) + np.concatenate([[0.0], step])
    both = by_step + kept.sum(1)
    share = float(by_step @ both / (both @ both)) if both.any() else 0.5
    a = share * kept
    i = np.arange(n - 1)
    a[i, i + 1] += (1 - share) * step
    a[i + 1, i] += (1 - share) * step
    degree = a.sum(1)
    scale = np.where(degree > 0, 1 / np.sqrt(np.where(degree > 0, degree, 1)), 0)
    _, v = np.linalg.eigh(np.eye(n) - a * scale[:, None] * scale)
    return np.stack([running_median(v[:, c], smoothing | 1) for c in range(min(vectors, n))], 1)


def clustered(vectors: np.ndarray, k: int) -> np.ndarray:
    """k-means labels of the rows of the first k eigenvectors, scaled to length one."""
    x = vectors[:, :k]
    size = np.sqrt((x**2).sum(1, keepdims=True))
    return kmeans(x / np.where(size > 0, size, 1), k)


def segments(repeats: np.ndarray, path: np.ndarray, bar: int, most: int = 6, most_short: float = 0.08, embedding_bars: float = 2.0, smoothing_bars: float = 2.25) -> np.ndarray:
    """Labels of a track's units: as many clusters, three to `most`, as leave at most most_short of the units in runs under
    two bars."""
    n = len(repeats)
    v = embedding(repeats, path, 10, max(2, math.floor(embedding_bars * bar + 0.5)), max(3, math.floor(smoothing_bars * bar + 0.5)))

    def short(label: np.ndarray) -> float:
        cuts = np.concatenate([[0], np.flatnonzero(label[1:] != label[:-1]) + 1, [n]])
        size = np.diff(cuts)
        return float(size[size < 2 * bar].sum()) / n

    for k in range(min(most, n - 1), 3, -1):
        label = clustered(v, k)
        if short(label) <= most_short:
            return label
    return clustered(v, min(3, n - 1))


def random_numbers(seed: int) -> Iterator[float]:
    """Numbers in [0, 1) of the 32-bit additive generator that functions.scalar.mulberry has in closed form."""
    low = (1 << 32) - 1
    while True:
        seed = (seed + MULBERRY_STEP) & low
        t = (seed ^ seed >> 15) * (seed | MULBERRY_MASKS[0]) & low
        t ^= (t + ((t ^ t >> 7) * (t | MULBERRY_MASKS[1]) & low)) & low
        yield (t ^ t >> 14) / 2.0**32


def kmeans(x: np.ndarray, k: int, seed: int = 7, restarts: int = 8, rounds: int = 60) -> np.ndarray:
    """Labels of the best of several k-means++ runs from one seeded generator; a centre without rows moves to a drawn row."""
    draw = random_numbers(seed)
    some = lambda: x[int(next(draw) * len(x))]
    to = lambda c: ((x[:, None] - c[None]) ** 2).sum(-1)
    best, cost = np.zeros(len(x), int), np.inf
    for _ in range(restarts):
        c = some()[None]
        while len(c) < k:
            near = to(c).min(1)
            at = np.searchsorted(np.cumsum(near), next(draw) * near.sum())
            c = np.vstack([c, x[min(int(at), len(x) - 1)]])
        label = np.full(len(x), -1)
        for _ in range(rounds):
            d = to(c)
            now = d.argmin(1)
            total, moved = float(d.min(1).sum()), bool((now != label).any())
            label = now
            c = np.stack([x[label == j].mean(0) if (label == j).any() else some() for j in range(k)])
            if not moved:
                break
        if total < cost - 1e-12:
            best, cost = label, total
    return best
