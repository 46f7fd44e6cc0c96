"""Reports of stereo signals (track, i from 0, l, r): likeness of the channels, width by band, rises of the high band.

Frames are dealt to tasks by chunks of frames, many of which are worked on at once, whatever the track's length; what meets
by track is one row a chunk or a frame.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import power_db
from ..sources.tables import written
from . import signal as S
from .scan import Cascade, Channels, Section, laid, stepped, strips, with_states

EPS = 1e-12
#: Bands of the width, in Hz.
WIDTHS = ((20, 120), (120, 500), (500, 2000), (2000, 8000), (8000, 20000))
#: Frames of a chunk.
FRAMES = 64


def low_pass(freq: float, q: float, fs: float) -> Section:
    """A second-order low-pass from the common cookbook formulas."""
    w = 2 * math.pi * freq / fs
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    a0 = 1 + alpha
    return ((1 - c) / 2 / a0, (1 - c) / a0, (1 - c) / 2 / a0), (-2 * c / a0, (1 - alpha) / a0)


def framed(signal: DataFrame, columns: list[str], size: int, hop: int, frames: int = FRAMES) -> DataFrame:
    """Strips of the samples that `frames` frames begin with, and of those which the last of them reach beyond."""
    return strips(signal, columns, frames * hop, after=max(0, size - hop))


def strip_spectra(rows: list[np.ndarray], size: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of the whole frames that begin in the chunks of strips, chunk by chunk, and how many each has."""
    views = [np.lib.stride_tricks.sliding_window_view(x, size)[::hop] if len(x) >= size else np.zeros((0, size)) for x in rows]
    return S.power_spectrum(np.concatenate(views)), np.array([len(v) for v in views])


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the first counts[0] rows of values, of the counts[1] behind them, and so on."""
    out, some = np.zeros((len(counts), values.shape[1])), counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def some_rows(samples: int) -> int:
    """How many strips of so many samples are worked on at once."""
    return max(1, (1 << 21) // samples)


def mean_spectra(stereo: DataFrame, size: int, hop: int) -> DataFrame:
    """(track, bin, mid, side): mean power of each bin over all whole frames of half the sum and half the difference."""
    frames = max(FRAMES, math.ceil(size / hop))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        (mid, n), (side, _) = (strip_spectra([(a + sign * b) / 2 for a, b in zip(p.l, p.r, strict=True)], size, hop) for sign in (1, -1))
        return pd.DataFrame({"track": p.track, "n": n, "mid": list(row_sums(mid, n)), "side": list(row_sums(side, n))})

    track = f"track {stereo.schema['track'].dataType.simpleString()}"
    sums = framed(stereo, ["l", "r"], size, hop, frames).mapInPandas(stepped(run, some_rows(frames * size)), f"{track}, n long, mid array<double>, side array<double>")
    bins = sums.select("track", "n", F.posexplode(F.arrays_zip("mid", "side")).alias("bin", "v"))
    total = bins.groupBy("track", "bin").agg(F.sum("n").alias("n"), F.sum("v.mid").alias("mid"), F.sum("v.side").alias("side"))
    return total.where("n > 0").select("track", "bin", (F.col("mid") / F.col("n")).alias("mid"), (F.col("side") / F.col("n")).alias("side"))


def alike(ll: Column, rr: Column, lr: Column) -> Column:
    """Uncentred correlation of two channels; 1 where one of them is silent."""
    return F.when((ll < EPS) | (rr < EPS), 1.0).otherwise(lr / F.sqrt(ll * rr))


def stereo_report(stereo: DataFrame, fs: float, size: int = 4096, hop: int = 2048) -> DataFrame:
    """One row a track: correlation, low_correlation (below 120 Hz), width, widths (by WIDTHS), balance_db (left over right),
    mono_loss_db (at most 0). A track without a whole frame has widths of 0."""
    step = fs / size
    spans = [(max(1, math.floor(lo / step)), min(size // 2 + 1, math.ceil(hi / step))) for lo, hi in ((20, 20000), *WIDTHS)]
    inside = np.array([[float(lo <= k < hi) for lo, hi in spans] for k in range(size // 2 + 1)])
    frames = max(4, math.ceil(size / hop), 8192 // hop)
    span, rows = frames * hop, some_rows(frames * size)
    own, low = written(framed(stereo, ["l", "r"], size, hop, frames)), Channels(Cascade([low_pass(120.0, 0.707, fs)]), 2)
    track = f"track {own.schema['track'].dataType.simpleString()}"

    def ends(p: pd.DataFrame) -> pd.DataFrame:
        (left, n), (right, _) = (laid(p[c], p.lead, span) for c in "lr")
        return pd.DataFrame({"track": p.track, "chunk": p.chunk, "m": list(low.maps([left, right], n, p.chunk.to_numpy()))})

    def sums(p: pd.DataFrame) -> pd.DataFrame:
        (left, n), (right, _) = (laid(p[c], p.lead, span) for c in "lr")
        on = np.arange(left.shape[1]) < n[:, None]
        low_left, low_right = (np.where(on, y, 0.0) for y in low.run([left, right], n, np.stack(p.state.to_numpy())))
        (mid, count), (side, _) = (strip_spectra([(a + sign * b) / 2 for a, b in zip(p.l, p.r, strict=True)], size, hop) for sign in (1, -1))
        left, right = (np.where(np.isnan(v), 0.0, v) for v in (left, right))  # sums leave out what is not known
        pairs = {"ll": (left, left), "rr": (right, right), "lr": (left, right), "low_ll": (low_left, low_left), "low_rr": (low_right, low_right), "low_lr": (low_left, low_right)}
        products = {k: np.einsum("ij,ij->i", a, b) for k, (a, b) in pairs.items()}
        return pd.DataFrame({"track": p.track, **products, "n": count, "mid": list(row_sums(mid @ inside, count)), "side": list(row_sums(side @ inside, count))})

    fields = f"{track}, ll double, rr double, lr double, low_ll double, low_rr double, low_lr double, n long, mid array<double>, side array<double>"
    maps = lambda chunks: chunks.mapInPandas(stepped(ends, rows), f"{track}, chunk long, m array<double>")
    parts = with_states(own, F.size("l") < span, maps, low).mapInPandas(stepped(sums, rows), fields)
    products = [F.sum(k).alias(k) for k in ("ll", "rr", "lr", "low_ll", "low_rr", "low_lr")]
    mean = lambda name, k: F.sum(F.get(name, F.lit(k))) / F.sum("n")
    share = lambda k: F.when(mean("mid", k) + mean("side", k) > EPS, mean("side", k) / (mean("mid", k) + mean("side", k))).otherwise(0.0)
    sums_of = parts.groupBy("track").agg(*products, F.when(F.sum("n") > 0, F.array(*map(share, range(len(spans))))).alias("w"))

    c = F.col
    energy = c("ll") + c("rr")
    loss = F.when(energy > EPS, F.least(F.lit(0.0), power_db((energy + 2 * c("lr")) / 2 / energy))).otherwise(0.0)
    w = F.coalesce("w", F.array_repeat(F.lit(0.0), len(spans)))
    return sums_of.select(
        "track", alike(c("ll"), c("rr"), c("lr")).alias("correlation"), alike(c("low_ll"), c("low_rr"), c("low_lr")).alias("low_correlation"),
        F.get(w, F.lit(0)).alias("width"), F.slice(w, 2, len(WIDTHS)).alias("widths"), power_db(c("ll") / F.greatest(c("rr"), F.lit(EPS))).alias("balance_db"), loss.alias("mono_loss_db"),
    )


def high_band_rises(mono: DataFrame, fs: float, size: int = 1024, hop: int = 512, above: float = 5000.0, seconds: float = 60.0) -> DataFrame:
    """(track, f, rise) of mono (track, i, x): how much the log energy above `above` Hz rises from frame to frame, in the
    middle `seconds` of each track; the first frame has 0. Of n samples there, (n - size) div hop frames are taken."""
    n = mono.groupBy("track").agg((F.max("i") + 1).alias("n"))
    span = F.least("n", F.lit(math.floor(seconds * fs + 0.5)))
    middle = n.select("track", span.alias("span"), F.floor((F.col("n") - span) / 2).alias("start"))
    cut = mono.join(middle, "track").where("i >= start AND i < start + span").select("track", (F.col("i") - F.col("start")).alias("i"), "x")
    frames = max(FRAMES, math.ceil(size / hop))
    first = math.floor(above / (fs / size))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        power, n = strip_spectra(list(p.x), size, hop)
        return pd.DataFrame({"track": p.track, "chunk": p.chunk, "v": np.split(np.log1p(1e5 * power[:, first:].sum(1)), np.cumsum(n)[:-1])})

    track = f"track {mono.schema['track'].dataType.simpleString()}"
    each = framed(cut, ["x"], size, hop, frames).mapInPandas(stepped(run, some_rows(frames * size)), f"{track}, chunk long, v array<double>")
    placed = each.select("track", "chunk", F.posexplode("v").alias("p", "v")).select("track", (F.col("chunk") * frames + F.col("p")).alias("f"), "v")
    levels = placed.join(middle, "track").where(F.col("f") < F.expr(f"(span - {size}) div {hop}"))
    before = F.lag("v").over(Window.partitionBy("track").orderBy("f"))
    return levels.select("track", "f", F.greatest(F.lit(0.0), F.coalesce(F.col("v") - before, F.lit(0.0))).alias("rise"))
