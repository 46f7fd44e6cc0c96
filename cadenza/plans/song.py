"""Features of signals frame by frame, and what follows from them: onsets and tempo; clips of bars and sections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, upper_median
from ..operators import signal as S
from ..operators.windows import moving_average, top
from ..sources.tables import waves, written
from .timeline import r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FS = 8000.0

def chunked(samples: DataFrame, size: int, hop: int, frames: int = 64) -> DataFrame:
    """Samples with the chunk of `frames` frames they lie in; those that two chunks need come twice."""
    span, over = frames * hop, size - hop
    c = F.floor(F.col("i") / span)
    both = F.when((F.col("i") % span < over) & (c > 0), F.array(c, c - 1)).otherwise(F.array(c))
    return samples.withColumn("chunk", F.explode(both))


FEATURES = "f long, rms_db double, low_db double, centroid double, flatness double, vocal double, timbre array<double>, chroma array<double>"


def features(samples: DataFrame, fs: float = FS, size: int = 1024, hop: int = 512, frames: int = 64) -> DataFrame:
    """Frame features of every track of (track, i, l, r): a group is a chunk of frames with the samples they need, whatever the track's length."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        left, right = p.l.to_numpy(), p.r.to_numpy()
        x = S.frame_features(0.5 * (left + right), 0.5 * (left - right), fs, size, hop)
        n = min(frames, len(x["rms_db"]))
        out = {k: list(v[:n]) for k, v in x.items()}
        return pd.DataFrame({"f": p.chunk.iloc[0] * frames + np.arange(n), **out})

    own = chunked(samples, size, hop, frames)
    return S.per_track(own, ["track", "chunk"], "i", run, FEATURES).drop("chunk")


@query()
def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = lambda c: F.transform(c, lambda x: r(x, 4))
    return features(waves(spark, sf_dir), size=64, hop=32).select("track", "f", *(r(F.col(c)).alias(c) for c in ("rms_db", "low_db", "centroid", "flatness", "vocal")), rounded("timbre").alias("timbre"), rounded("chroma").alias("chroma"))


def onsets(samples: DataFrame, fs: float = FS, size: int = 256, hop: int = 128, bands: int = 40, frames: int = 256, lowest: float = 30.0) -> DataFrame:
    """(track, f, env) of (track, i, l, r): rises of log band powers between frames, less the local mean of 0.4 s, rectified, scaled to 1."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        band = S.log_bands(size, fs, lowest, min(11000, fs / 2 - 1), bands)
        v = S._summed(S.spectra(0.5 * (p.l + p.r).to_numpy(), size, hop)[:frames], band, bands)
        return pd.DataFrame({"f": p.chunk.iloc[0] * frames + np.arange(len(v)), "v": list(np.log1p(1e4 * v))})

    own = S.per_track(chunked(samples, size, hop, frames), ["track", "chunk"], "i", run, "f long, v array<double>")
    line = Window.partitionBy("track").orderBy("f")
    rise = F.zip_with("v", F.lag("v").over(line), lambda a, b: F.greatest(F.lit(0.0), a - b))
    flux = own.withColumn("flux", F.coalesce(F.aggregate(rise, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))
    local = F.greatest(F.lit(0.0), F.col("flux") - moving_average(F.col("flux"), ["track"], ["f"], round(0.4 * fs / hop)))
    env = flux.withColumn("env", local)
    return env.select("track", "f", (F.col("env") / F.greatest(F.max("env").over(Window.partitionBy("track")), F.lit(1e-12))).alias("env"))


def short_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of the line item signals, by frames of 16 samples that are 0.1 s apart."""
    return onsets(waves(spark, sf_dir), 80.0, 16, 8, 8, lowest=5.0)


@query()
def onset_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_onsets(spark, sf_dir).select("track", "f", r(F.col("env"), 5).alias("env"))


def tempo_of(envelope: DataFrame, hop_sec: float, least: float = 55.0, most: float = 215.0) -> DataFrame:
    """bpm, confidence and clarity of each track's onset envelope (track, f, env).

    The autocorrelation at a lag and at its two-, three- and fourfold is summed under a log-normal prior around 120; the
    best lag is moved to the top of the parabola through it and its neighbours. The confidence is how far it stands above
    the upper median of all lags, the clarity its autocorrelation over that of lag 0. A track too short for two beats of
    the slowest tempo has 120 with no confidence.
    """
    low, high = max(1, math.floor(60 / most / hop_sec)), math.ceil(60 / least / hop_sec)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = p.env.to_numpy()
        if len(x) < 2 * high + 2:
            return pd.DataFrame({"lag": [0], "ac": [0.0]})
        v = S.autocorrelation(x, min(4 * high + 2, len(x) - 1))
        return pd.DataFrame({"lag": np.arange(len(v)), "ac": v})

    ac = S.per_track(envelope, ["track"], "f", run, "lag long, ac double")
    # The weights of the comb and the prior's centre and width
    comb = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in ((1, 1.0), (2, 0.5), (3, 0.33), (4, 0.25))]))
    teeth = ac.withColumn("c", comb).where(F.col("lag") % F.col("c.k") == 0).select("track", (F.col("lag") / F.col("c.k")).cast("long").alias("lag"), (F.col("ac") * F.col("c.w")).alias("v"), F.when(F.col("c.k") == 1, F.col("ac")).alias("own"))
    bpm = 60 / (F.col("lag") * hop_sec)
    scored = teeth.where(F.col("lag").between(low, high)).groupBy("track", "lag").agg((F.sum("v") * F.first(F.exp(-0.5 * F.pow(F.log2(bpm / 120) / 0.9, F.lit(2))))).alias("s"), F.max("own").alias("own"))
    line, whole = Window.partitionBy("track").orderBy("lag"), Window.partitionBy("track")
    scored = scored.withColumns({"a": F.lag("s").over(line), "c": F.lead("s").over(line), "all": F.collect_list("s").over(whole)})
    best = top(scored, ["track"], [F.desc("s"), F.asc("lag")])
    bend = F.col("a") - 2 * F.col("s") + F.col("c")
    shift = F.when(bend < 0, clamp(0.5 * (F.col("a") - F.col("c")) / bend, -0.5, 0.5)).otherwise(0.0)
    zero = ac.where("lag = 0").select("track", F.col("ac").alias("r0"))
    found = zero.join(best, "track", "left")
    return found.select(
        "track", F.coalesce(60 / ((F.col("lag") + F.coalesce(shift, F.lit(0.0))) * hop_sec), F.lit(120.0)).alias("bpm"),
        F.coalesce(F.when(F.col("s") > 0, clamp((F.col("s") - upper_median(F.col("all"))) / F.col("s"))), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.when(F.col("r0") > 0, clamp(F.col("own") / F.col("r0"))), F.lit(0.0)).alias("clarity"),
    )


@query()
def song_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo_of(short_onsets(spark, sf_dir), 0.1).select("track", r(F.col("bpm"), 3).alias("bpm"), r(F.col("confidence")).alias("confidence"), r(F.col("clarity")).alias("clarity"))


def _unit(x: Column) -> Column:
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: v / F.greatest(size, F.lit(1e-12)))


# Bars a clip may have; weights of hook, early hook, loop and energy; the two kinds' shortest, longest and wanted seconds.
CLIP_BARS, CLIP_WEIGHTS = (16, 12, 8, 6, 4, 3, 2, 1), (0.4, 0.2, 0.25, 0.15)
CLIPS = [("clip", 11.0, 17.5, 15.0), ("micro", 5.0, 9.5, 7.0)]


def clip_bars(bar_sec: Column, shortest: float, longest: float, wanted: float) -> Column:
    """How many bars a clip has: the allowed count nearest to the wanted length, fours before twos before others (earlier
    ones in a tie); if none fits, as many as come nearest."""
    off = lambda b: F.struct((F.abs(b * bar_sec - wanted) + (0.0 if b % 4 == 0 else 1.0 if b % 2 == 0 else 2.5)).alias("off"), F.lit(-b).alias("b"))
    fits = [F.when((b * bar_sec >= shortest) & (b * bar_sec <= longest), off(b)) for b in CLIP_BARS]
    return F.coalesce(-F.array_min(F.array_compact(F.array(*fits))).b, F.greatest(F.lit(1), F.floor(wanted / bar_sec + 0.5)).cast("int"))


def clips_of(own: DataFrame, sections: DataFrame, kinds: list[tuple[str, float, float, float]]) -> DataFrame:
    """(track, kind, start, bars, loop, score): the best clip of each kind, from bars (track, u, bar_sec, level, chroma).

    A clip loops if the bar behind it is like its first, its last like the one before it, or its second half like its
    first: three joins of bars a fixed distance apart, so no pairs of all bars. Hookness is a share of the energy (levels
    scaled to 0 to 1) and of standing in a chorus, unless the bars have a column hook; a chorus beginning within 3 s of the start counts on top.
    """
    whole, line = Window.partitionBy("track"), Window.partitionBy("track").orderBy("u")
    low, high = F.min("level").over(whole), F.max("level").over(whole)
    e = own.withColumns({"c": _unit(F.col("chroma")), "energy": F.when(high > low, (F.col("level") - low) / (high - low)).otherwise(0.0), "n": F.max("u").over(whole) + 1})
    chorus = sections.where("kind = 'chorus'").select("track", F.col("start").alias("first"), F.explode(F.sequence("start", F.col("end") - 1)).alias("u"))
    e = e.join(chorus, ["track", "u"], "left")
    e = e if "hook" in own.columns else e.withColumn("hook", 0.7 * F.col("first").isNotNull().cast("double") + 0.3 * F.col("energy"))
    early = F.min(F.when(F.col("first") == F.col("u"), F.col("u"))).over(line.rowsBetween(0, Window.unboundedFollowing))
    e = e.withColumns({"early": F.coalesce(((early - F.col("u")) * F.col("bar_sec") <= 3).cast("double"), F.lit(0.0)), "hooks": F.sum("hook").over(line), "energies": F.sum("energy").over(line)})
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), clip_bars(F.col("bar_sec"), *limits).alias("bars")) for k, *limits in kinds]))
    e = e.withColumn("k", kind).select("*", "k.kind", F.least(F.col("k.bars"), F.col("n")).alias("bars")).drop("k")
    other = lambda shift, names: e.select("track", "kind", (F.col("u") - shift).alias("u"), *[F.col(c).alias(f"{c}_{n}") for c, n in names])
    cos = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    half = F.greatest(F.lit(1), F.floor(F.col("bars") / 2))
    keys = ["track", "kind", "u"]
    e = e.join(other(half, [("c", "half")]), keys, "left").withColumn("inner", cos("c", "c_half"))
    e = e.withColumn("inners", F.sum(F.coalesce("inner", F.lit(0.0))).over(Window.partitionBy("track", "kind").orderBy("u")))
    by_kind = Window.partitionBy("track", "kind").orderBy("u")
    # written, as each join below would make it anew
    e = written(e.withColumn("before", F.lag("c").over(by_kind)))
    last = e.select("track", "kind", (F.col("u") - F.col("bars") + 1).alias("u"), F.col("c").alias("c_last"), F.col("hooks").alias("h1"), F.col("energies").alias("e1"))
    inner = e.select("track", "kind", (F.col("u") - half + 1).alias("u"), F.col("inners").alias("i1"))
    after = e.select("track", "kind", (F.col("u") - F.col("bars")).alias("u"), F.col("c").alias("c_after"))
    at = e.join(last, keys).join(inner, keys).join(after, keys, "left")
    seam = F.greatest(cos("c", F.coalesce("c_after", "c_last")), F.coalesce(cos("before", "c_last"), F.lit(0.0)), (F.col("i1") - F.col("inners") + F.coalesce("inner", F.lit(0.0))) / half)
    loop = clamp((seam - 0.5) / 0.5)
    mean = lambda upto, running, own: (F.col(upto) - F.col(running) + F.col(own)) / F.col("bars")
    w = CLIP_WEIGHTS
    score = w[0] * mean("h1", "hooks", "hook") + w[1] * F.col("early") + w[2] * F.col("loop") + w[3] * mean("e1", "energies", "energy")
    scored = at.withColumn("loop", loop).withColumn("score", F.round(score, 6))
    best = top(scored, ["track", "kind"], [F.desc("score"), F.asc("u")])
    return best.select("track", "kind", F.col("u").alias("start"), F.col("bars").cast("int").alias("bars"), r(F.col("loop")).alias("loop"), r(F.col("score")).alias("score"))
