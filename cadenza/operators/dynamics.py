"""Compressors and limiters over stereo signals (track, i from 0, l, r). A task has a chunk of a track and what its edges need."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import loudness
from ..sources.tables import written
from .levels import block_energies, gated
from .scan import Release, _rows, scanned, stepped
from .windows import sliding_windows

#: Share of a state before a chunk's warm-up that may be left when the chunk begins.
LEFT = 1e-13


def block_levels(stereo: DataFrame, block: int) -> DataFrame:
    """(track, b, level): dB of the mean square of both channels, the last block filled up with silence."""
    power = F.sum((F.col("l") * F.col("l") + F.col("r") * F.col("r")) / 2) / block
    return stereo.groupBy("track", F.expr(f"i div {block}").alias("b")).agg((10 * F.log10(power + 1e-12)).alias("level"))


def soft_knee(over: Column, ratio: Column | float, knee: Column | float) -> Column:
    """dB to take off a level that lies `over` dB above the threshold: none below the knee, a parabola inside it."""
    share, half = 1 - 1 / F.lit(ratio), F.lit(knee) / 2
    return F.when(over > half, over * share).when(over > -half, share * F.pow(over + half, F.lit(2)) / (4 * half)).otherwise(0.0)


def kept_share(seconds: Column | float, rate: float) -> Column:
    """What is left of a difference after one of `rate` steps a second, with a time constant of `seconds`."""
    return F.exp(-1 / (F.lit(seconds) * rate))


def smoothed(targets: DataFrame, keys: list[str], slowest: float, size: int = 1024) -> DataFrame:
    """(keys, b, x) of targets (keys, b from 0, x, attack, release): from 0 on, the state goes towards each target, keeping
    the share `attack` of the difference while it rises and `release` while it falls.

    Steps with two shares have no short common form, but each shrinks a difference of states to `slowest` or less (the
    largest share in the table). So a chunk warms up over as many steps before it as leave LEFT of any difference; its
    states are those of the whole recurrence up to that part. A task steps through many chunks at once.
    """
    halo = 1 if slowest <= 0 else math.ceil(math.log(LEFT) / math.log(slowest))
    size = max(size, halo)
    chunk = F.expr(f"b div {size}")
    both = F.array_compact(F.array(chunk, F.when(F.col("b") % size >= size - halo, chunk + 1)))

    parts = ("b", "x", "attack", "release")
    gathered = targets.withColumn("chunk", F.explode(both)).groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("s"))
    rows = gathered.select(*keys, "chunk", *(F.col(f"s.{c}").alias(f"_{c}") for c in parts))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        (x, n), (a, _), (r, _) = (_rows(p[c]) for c in ("_x", "_attack", "_release"))
        state, out = np.zeros(len(x)), np.empty_like(x)
        for t in range(x.shape[1]):
            v = x[:, t]
            state = v + (state - v) * np.where(v > state, a[:, t], r[:, t])
            out[:, t] = state
        warm = [int((b // size < chunk).sum()) for b, chunk in zip(p._b, p.chunk, strict=True)]
        own = {"b": [b[w:] for b, w in zip(p._b, warm, strict=True)], "x": [row[w:k] for row, w, k in zip(out, warm, n, strict=True)]}
        return pd.DataFrame({**{k: p[k] for k in keys}, **own})

    fields = ", ".join(f"{k} {targets.schema[k].dataType.simpleString()}" for k in keys)
    done = rows.mapInPandas(stepped(run), f"{fields}, b array<long>, x array<double>")
    return done.select(*keys, F.explode(F.arrays_zip("b", "x")).alias("v")).select(*keys, "v.b", "v.x")


def reduced(stereo: DataFrame, reduction: DataFrame, block: int) -> DataFrame:
    """The signal less the dB of (track, b, x); inside a block the factor goes in a line to the next block's."""
    own = reduction.select("track", "b", F.pow(F.lit(10.0), -F.col("x") / 20).alias("g"))
    gains = own.join(own.select("track", (F.col("b") - 1).alias("b"), F.col("g").alias("then")), ["track", "b"], "left")
    placed = stereo.withColumn("b", F.expr(f"i div {block}")).join(gains, ["track", "b"], "left")
    factor = F.coalesce(F.col("g") + (F.coalesce("then", "g") - F.col("g")) * (F.col("i") % block) / block, F.lit(1.0))
    return placed.select("track", "i", (F.col("l") * factor).alias("l"), (F.col("r") * factor).alias("r"))


def glued(stereo: DataFrame, rate: float, above: float, ratio: float, attack: float, release: float, block: int, knee: float = 6.0) -> DataFrame:
    """The signal through a compressor whose threshold is the quantile `above` of the track's own block levels over -60 dB.

    rate: samples a second; attack and release in seconds. A track without such a block comes back as it is.
    """
    levels = written(block_levels(stereo, block))
    threshold = levels.where("level > -60").groupBy("track").agg(F.percentile("level", F.lit(above)).alias("threshold"))
    steps = rate / block
    target = levels.join(threshold, "track").select("track", "b", soft_knee(F.col("level") - F.col("threshold"), ratio, knee).alias("x"), kept_share(attack, steps).alias("attack"), kept_share(release, steps).alias("release"))
    reduction = written(smoothed(target, ["track"], math.exp(-1 / (max(attack, release) * steps))))
    return reduced(stereo, reduction, block)


def limited(stereo: DataFrame, ceiling: float, look: int, rise: float, size: int = 4096) -> DataFrame:
    """The signal held under `ceiling` by one gain for both channels: the least that the next `look` samples need, its mean
    over the last `look`, and back to 1 by the share `rise` of what is missing."""
    if not 0 < look <= size:
        raise ValueError("look must be between 1 and size")
    need = F.least(F.lit(1.0), ceiling / F.greatest(F.abs("l"), F.abs("r"), F.lit(1e-12)))
    needs = written(stereo.select("track", "i", "l", "r", need.alias("need")))
    chunk, at, over = F.expr(f"i div {size}"), F.col("i") % size, look - 1
    near = F.array_compact(F.array(chunk, F.when((at < over) & (chunk > 0), chunk - 1), F.when(at >= size - over, chunk + 1)))

    track = f"track {needs.schema['track'].dataType.simpleString()}"

    def means(i: np.ndarray, need: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        if i[-1] < first:  # a track that ends at the border before this chunk
            return i[:0], need[:0]
        x = np.ones(int(i[-1]) - first + 1 + 2 * over)
        x[i - first + over] = need
        ahead = np.lib.stride_tricks.sliding_window_view(x, look).min(1)
        if first == 0:
            ahead[:over] = ahead[over]
        mean = np.lib.stride_tricks.sliding_window_view(ahead, look).mean(1)
        own = i[i // size == first // size]
        return own, mean[own - first]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        done = [means(i, need, int(chunk) * size) for i, need, chunk in zip(p.i, p.need, p.chunk, strict=True)]
        return pd.DataFrame({"track": p.track, "i": [i for i, _ in done], "x": [x for _, x in done]})

    spread = needs.select("track", "i", "need", F.explode(near).alias("chunk"))
    rows = spread.groupBy("track", "chunk").agg(F.array_sort(F.collect_list(F.struct("i", "need"))).alias("s")).select("track", "chunk", F.col("s.i").alias("i"), F.col("s.need").alias("need"))
    mean = rows.mapInPandas(stepped(run), f"{track}, i array<long>, x array<double>").select("track", F.explode(F.arrays_zip("i", "x")).alias("v")).select("track", "v.i", "v.x")
    gain = F.least("y", "need")
    out = needs.join(scanned(mean, Release(rise)), ["track", "i"])
    return out.select("track", "i", (F.col("l") * gain).alias("l"), (F.col("r") * gain).alias("r"))


def integrated_level(stereo: DataFrame, rate: float, block: int) -> DataFrame:
    """(track, lufs): gated loudness of the weighted channels in windows of four blocks. A silent track has no row."""
    energy = written(block_energies(stereo, rate, block))
    windows = sliding_windows(energy, "energy", ["track"], "b", 4).withColumn("l", loudness(F.col("mean")))
    return gated(windows, -70.0, 10.0).groupBy("track").agg(loudness(F.avg("mean")).alias("lufs"))


def delivery_gain(lufs: Column) -> Column:
    """The factor that brings a level to min(-7, level). Without a finite level nothing is changed."""
    known = lufs.isNotNull() & ~F.isnan(lufs) & (F.abs(lufs) < math.inf)
    return F.when(known, F.pow(F.lit(10.0), (F.least(lufs, F.lit(-7.0)) - lufs) / 20)).otherwise(1.0)


def finalised(stereo: DataFrame, levels: DataFrame, ceiling_db: float = -1.0, look: int = 5, rise: float = 0.1) -> DataFrame:
    """The signal at the delivered level of its track (track, lufs), then limited; nothing else changes it."""
    gain = delivery_gain(F.col("lufs"))
    scaled = stereo.join(levels, "track", "left").select("track", "i", (F.col("l") * gain).alias("l"), (F.col("r") * gain).alias("r"))
    return limited(scaled, 10 ** (ceiling_db / 20), look, rise)
