"""Structure of songs from the units of their tracks: repetition curve, clusters, sections, hook, landmarks and clips."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, dot
from ..operators import sections as P
from ..operators import signal as S
from ..operators.similarity import doubles
from ..operators.windows import frame, local_peaks, spaced
from ..settings import Tuning, tuned
from ..sources.tables import table, written
from .song import CLIPS, clips_of
from .timeline import r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Units of a track of the embeddings, units a bar, and seconds a unit.
UNITS, PER_BAR, UNIT_SEC = 100, 2, 1.0
#: Lags of a track that a task compares.
LAGS = 64


def song_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units_of(table(spark, sf_dir, "embeddings"))


def units_of(e: DataFrame) -> DataFrame:
    """Vectors as units of songs of 100: (track, u, level, vocal, timbre, chroma, bar); bands from the first 24 components,
    pitch classes from the next 12, voice from the next one."""
    v, u = doubles(F.col("embedding")), F.pmod("vec_id", F.lit(UNITS))
    t, c = F.slice(v, 1, 24), F.transform(F.slice(v, 25, 12), lambda x: F.abs(x))
    level = 10 * F.log10(dot(t, t) / 24 + 1e-12)
    return e.select(F.floor(F.col("vec_id") / UNITS).alias("track"), u.alias("u"), level.alias("level"), F.abs(F.get(v, F.lit(36))).alias("vocal"), t.alias("timbre"), c.alias("chroma"), (u % PER_BAR == 0).alias("bar"))


SONG_UNITS = f"""su AS (SELECT vec_id // {UNITS} AS track, vec_id % {UNITS} AS u, list_transform(embedding[1:24], lambda x: CAST(x AS DOUBLE)) AS t, list_transform(embedding[25:36], lambda x: abs(CAST(x AS DOUBLE))) AS c FROM embeddings)"""


def _length(v: Column) -> Column:
    """The length of a vector, 1 for one of zeros."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, size).otherwise(1.0)


def normalised(units: DataFrame) -> DataFrame:
    """units with `z` (timbre by band, over the track's deviation), `tb` (z of length one) and `ch` (chroma of sum one, less
    the track's mean, of length one). A track's means and deviations are aggregates, so its units are spread over tasks."""
    total = F.aggregate("chroma", F.lit(0.0), lambda s, x: s + x)
    own = units.withColumn("c1", F.transform("chroma", lambda x: x / F.when(total != 0, total).otherwise(1.0)))
    each = lambda f, c, n: F.array(*[f(F.get(c, F.lit(k))) for k in range(n)])
    stats = own.groupBy("track").agg(each(F.avg, "c1", 12).alias("mean_c"), each(F.avg, "timbre", 24).alias("mean_t"), each(F.stddev_pop, "timbre", 24).alias("dev_t"))
    own = own.join(stats, "track")
    shift = F.zip_with("c1", "mean_c", lambda x, m: x - m)
    z = F.zip_with(F.zip_with("timbre", "mean_t", lambda x, m: x - m), "dev_t", lambda x, d: x / (d + 1e-3))
    own = own.withColumns({"z": z, "shift": shift})
    scaled = lambda c: F.transform(c, lambda x: x / _length(F.col(c)))
    return own.withColumns({"tb": scaled("z"), "ch": scaled("shift")}).drop("c1", "mean_c", "mean_t", "dev_t", "shift")


def repetition(units: DataFrame, unit_sec: float, lag_sec: float = 6.0, window_sec: float = 4.0) -> DataFrame:
    """(track, u, score): how nearly the seconds around each unit come back anywhere in the track, lag_sec away or more.

    A unit is its bands, their change from the unit before, and its chroma, of length one together. For every lag the
    products of units so far apart are averaged over window_sec by running sums; a unit keeps the best mean of all lags, on
    both sides. -1 where the track is shorter than the least lag. units: (track, u from 0 without gaps, z, chroma).

    Lags are dealt to tasks in stretches of LAGS: no task forms more than LAGS sums over a track, and no pairs are formed
    but by multiplying two shifted arrays. A song has some thousand units at most.
    """
    mean = F.aggregate("chroma", F.lit(0.0), lambda s, x: s + x) / 12
    own = units.withColumn("c0", F.transform("chroma", lambda x: x - mean))
    before = F.coalesce(F.lag("z").over(Window.partitionBy("track").orderBy("u")), F.col("z"))
    own = own.withColumns({"dz": F.zip_with("z", before, lambda a, b: a - b), "cw": F.transform("c0", lambda x: x / _length(F.col("c0")) * F.sqrt(F.size("z") / 12))})
    own = own.withColumn("f", F.concat("z", "dz", "cw")).withColumn("f", F.transform("f", lambda x: x / _length(F.col("f"))))
    least, width = max(1, int(lag_sec / unit_sec + 0.5)), max(3, int(window_sec / unit_sec + 0.5))
    half = width // 2
    own = own.select("track", "u", "f", F.max("u").over(Window.partitionBy("track")).alias("last"))
    dealt = own.select("track", "u", "f", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.lit(0).cast("long"), F.col("last") - least) / LAGS))).alias("stretch"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x, first = np.stack(p.f.to_numpy()), least + int(p.stretch.iloc[0]) * LAGS
        n = len(x)
        best = np.full(n, -1.0)
        for lag in range(first, min(n, first + LAGS)):
            total = np.concatenate([[0.0], np.cumsum((x[: n - lag] * x[lag:]).sum(1))])
            i = np.arange(n - lag)
            lo, hi = np.maximum(0, i - half), np.minimum(n - lag, i + half + 1)
            near = (total[hi] - total[lo]) / (hi - lo)
            best[: n - lag] = np.maximum(best[: n - lag], near)
            best[lag:] = np.maximum(best[lag:], near)
        return pd.DataFrame({"u": p.u.to_numpy(), "best": best})

    return S.per_track(dealt, ["track", "stretch"], "u", run, "u long, best double").groupBy("track", "u").agg(F.max("best").alias("score"))


@query(f"""WITH {SONG_UNITS}, b AS (SELECT track, u, unnest(range(0, 24)) AS k, unnest(t) AS v FROM su), z AS (SELECT track, u, k, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-3) AS z FROM b WINDOW w AS (PARTITION BY track, k)),
f AS (SELECT track, u, k, z AS v FROM z UNION ALL SELECT track, u, k + 24, coalesce(z - lag(z) OVER (PARTITION BY track, k ORDER BY u), 0) FROM z
 UNION ALL SELECT track, u, k + 48, v / CASE WHEN l > 0 THEN l ELSE 1 END * sqrt(2) FROM (SELECT track, u, k, v - m AS v, sqrt(sum(pow(v - m, 2)) OVER (PARTITION BY track, u)) AS l FROM (SELECT track, u, k, v, avg(v) OVER (PARTITION BY track, u) AS m FROM (SELECT track, u, unnest(range(0, 12)) AS k, unnest(c) AS v FROM su)))),
n AS (SELECT track, u, k, v / sqrt(sum(v * v) OVER (PARTITION BY track, u)) AS v FROM f), a AS (SELECT track, u, list(v ORDER BY k) AS v FROM n GROUP BY 1, 2),
p AS (SELECT x.track, x.u AS i, y.u - x.u AS lag, list_inner_product(x.v, y.v) AS d FROM a x JOIN a y ON x.track = y.track AND y.u - x.u >= 6),
m AS (SELECT track, i, lag, avg(d) OVER (PARTITION BY track, lag ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM p),
e AS (SELECT track, i AS u, m FROM m UNION ALL SELECT track, i + lag, m FROM m) SELECT track, u, round(coalesce(max(m), -1), 6) + 0.0 AS score FROM su LEFT JOIN e USING (track, u) GROUP BY 1, 2""")
def repetition_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(normalised(song_units(spark, sf_dir)), UNIT_SEC).select("track", "u", r(F.col("score"), 6).alias("score"))


def clusters(units: DataFrame, per_bar: int, tuning: Tuning) -> DataFrame:
    """(track, u, cluster) of normalised units: spectral clusters of the graph of a track's units, pooled to most_nodes."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        ch, tb, bands = (np.stack(p[c].to_numpy()) for c in ("ch", "tb", "timbre"))
        n = len(ch)
        pool = -(-n // tuning.most_nodes)
        at = np.arange(n) // pool
        if at[-1] < 7:
            return pd.DataFrame({"u": p.u.to_numpy(), "cluster": np.zeros(n, int)})
        pooled = lambda x: np.stack([x[at == g].sum(0) for g in range(at[-1] + 1)])
        path = pooled(bands) / np.bincount(at)[:, None]
        k = np.arange(1, 13)[:, None]
        path = path @ np.cos(np.pi * k * (np.arange(bands.shape[1]) + 0.5) / bands.shape[1]).T / bands.shape[1]
        label = S.segments(pooled(np.concatenate([ch, tuning.timbre_weight * tb], 1)), path, max(1, int(per_bar / pool + 0.5)), tuning.clusters, tuning.most_short, tuning.embedding_bars, tuning.smoothing_bars)
        return pd.DataFrame({"u": p.u.to_numpy(), "cluster": label[at]})

    return S.per_track(units.select("track", "u", "ch", "tb", "timbre"), ["track"], "u", run, "u long, cluster long")


@query()
def laplacian_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(normalised(song_units(spark, sf_dir)), PER_BAR, tuned(spark))


def relative(df: DataFrame, column: str, lo: float = 0.1, hi: float = 0.95) -> DataFrame:
    """df with the column scaled to 0..1 between two percentiles of its track."""
    ends = df.groupBy("track").agg(F.percentile(column, F.array(F.lit(lo), F.lit(hi))).alias("ends"))
    a, b = F.get("ends", F.lit(0)), F.get("ends", F.lit(1))
    return df.join(ends, "track").withColumn(column, clamp((F.col(column) - a) / (b - a + 1e-12))).drop("ends")


def curves(units: DataFrame, per_bar: int, unit_sec: float, tuning: Tuning) -> DataFrame:
    """Normalised units with everything that sections go by: energy, voice and repetition (0 to 1) and clusters."""
    own = written(normalised(units))
    own = own.join(repetition(own, unit_sec), ["track", "u"]).join(clusters(own, per_bar, tuning), ["track", "u"]).withColumn("energy", F.col("level"))
    own = relative(relative(relative(own, "energy"), "vocal"), "score", 0.05)
    return written(own.select("track", "u", "level", "energy", "vocal", F.col("score").alias("lyric"), "cluster", "bar", "tb", "ch", "chroma"))


def _of(p: pd.DataFrame, per_bar: int, unit_sec: float, tuning: Tuning) -> P.Curves:
    column = lambda c: p[c].to_numpy()
    return P.Curves(column("energy"), column("vocal"), column("lyric"), column("level"), column("cluster"), column("bar"), np.stack(column("tb")), per_bar, unit_sec, tuning)


def sections_of(own: DataFrame, per_bar: int, unit_sec: float, tuning: Tuning) -> DataFrame:
    """(track, run, start, end, label, kind, energy, vocal, loud) of the curves of tracks; start and end count units."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        found = P.sections(_of(p, per_bar, unit_sec, tuning))
        out = pd.DataFrame(found, columns=["start", "end", "label", "kind", "energy", "vocal", "loud"])
        out.insert(0, "run", np.arange(1, len(out) + 1))
        return out

    return S.per_track(own, ["track"], "u", run, "run int, start long, end long, label string, kind string, energy double, vocal double, loud double")


def hooks_of(own: DataFrame, per_bar: int, unit_sec: float, tuning: Tuning) -> DataFrame:
    """(track, start, end, confidence, places, repetition, hookness) of the curves of tracks; places and hookness are arrays."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        h = P.hook_of(_of(p, per_bar, unit_sec, tuning), np.stack(p.ch.to_numpy()))
        return pd.DataFrame({"start": [h.start], "end": [h.stop], "confidence": [h.confidence], "places": [h.places], "repetition": [h.repetition], "hookness": [h.hookness]})

    return S.per_track(own, ["track"], "u", run, "start long, end long, confidence double, places array<long>, repetition double, hookness array<double>")


def landmarks(own: DataFrame, sections: DataFrame, hooks: DataFrame, unit_sec: float) -> DataFrame:
    """One row a track: intro length, first hook, first full energy, first voice (seconds), drops, lift of the chorus over the
    verses (dB) and share of units that come back."""
    per = Window.partitionBy("track").orderBy("u")
    units = lambda sec: int(sec / unit_sec + 0.5)
    half, gap, reach = units(0.5), units(0.5), max(2, units(2.5))
    smooth = own.withColumn("s", F.avg("level").over(per.rowsBetween(-half, max(0, half - 1))))
    full = smooth.groupBy("track").agg(F.percentile("s", F.lit(0.8)).alias("loud"))
    smooth = smooth.join(full, "track")
    first = smooth.groupBy("track").agg((F.min(F.when(F.col("s") >= F.col("loud") - 3, F.col("u"))) * unit_sec).alias("full_energy"))
    voice = own.groupBy("track").agg(F.percentile("vocal", F.array(F.lit(0.1), F.lit(0.9))).alias("v"))
    low, high = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    voiced = own.join(voice, "track").withColumn("on", (F.col("vocal") >= low + 0.5 * (high - low)).cast("double"))
    voiced = voiced.withColumns({"held": F.avg("on").over(per.rowsBetween(0, 3)), "more": F.count("on").over(per.rowsBetween(0, 3))})
    begun = voiced.where((F.col("on") == 1) & (F.col("more") == 4) & (F.col("held") >= 0.7) & (high - low > 0.04)).groupBy("track").agg((F.min("u") * unit_sec).alias("first_vocal"))
    around = lambda lo, hi: F.when(F.count("s").over(frame(["track"], ["u"], lo, hi)) == hi - lo + 1, F.avg("s").over(frame(["track"], ["u"], lo, hi)))
    jump = smooth.withColumn("jump", F.when(F.lead("s", 1).over(per) > F.col("loud") - 6, around(1, reach) - around(-gap - reach, -gap - 1)))
    peaks = local_peaks(jump.withColumn("jump", F.coalesce("jump", F.lit(0.0))), "jump", ["track"], ["u"], F.lit(6.0))
    drops = spaced(peaks, "jump", "u", ["track"], 8.0 / unit_sec).groupBy("track").agg(F.array_sort(F.collect_list(F.col("u") * unit_sec)).alias("drops"))
    kinds = sections.groupBy("track").agg(
        F.max(F.when((F.col("run") == 1) & (F.col("kind") == "intro"), F.col("end") * unit_sec)).alias("intro"), F.min(F.when(F.col("kind") == "chorus", F.col("start"))).alias("chorus"),
        (F.avg(F.when(F.col("kind") == "chorus", F.col("loud"))) - F.avg(F.when(F.col("kind") == "verse", F.col("loud")))).alias("lift"),
    )
    out = hooks.join(kinds, "track").join(first, "track", "left").join(begun, "track", "left").join(drops, "track", "left")
    hook = F.when(F.size("places") >= 2, F.get("places", F.lit(0))).otherwise(F.least("start", F.coalesce("chorus", "start")))
    return out.select(
        "track", F.coalesce("intro", F.lit(0.0)).alias("intro"), (hook * unit_sec).alias("first_hook"), "full_energy", "first_vocal",
        F.coalesce("drops", F.expr("cast(array() as array<double>)")).alias("drops"), "lift", "repetition", "confidence",
    )


def bars_of(own: DataFrame, hooks: DataFrame, per_bar: int, unit_sec: float) -> DataFrame:
    """(track, u, bar_sec, level, chroma, hook) of each bar: means over its units, hook from the hookness of the track."""
    h = hooks.select("track", F.posexplode("hookness").alias("u", "h"))
    bar = F.floor(F.col("u") / per_bar)
    chroma = F.array(*[F.avg(F.get("chroma", F.lit(k))) for k in range(12)])
    return own.join(h, ["track", "u"]).groupBy("track", bar.alias("u")).agg(F.lit(per_bar * unit_sec).alias("bar_sec"), F.avg("level").alias("level"), chroma.alias("chroma"), F.avg("h").alias("hook"))


def _song(make: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_units(make, song_units(spark, sf_dir))


def of_units(make: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], units: DataFrame) -> DataFrame:
    """make() of the curves, sections and hooks of songs of units, with the session's tuning."""
    tune = tuned(units.sparkSession)
    own = curves(units, PER_BAR, UNIT_SEC, tune)
    return make(own, written(sections_of(own, PER_BAR, UNIT_SEC, tune)), written(hooks_of(own, PER_BAR, UNIT_SEC, tune)))


@query()
def song_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _song(section_rows, spark, sf_dir)


def section_rows(own: DataFrame, sections: DataFrame, hooks: DataFrame) -> DataFrame:
    """The sections of each song, and whether the hook begins in it."""
    s = sections.join(hooks.select("track", F.col("start").alias("h")), "track")
    return s.select("track", "run", "start", "end", "label", "kind", *(r(F.col(c)).alias(c) for c in ("energy", "vocal", "loud")), ((F.col("h") >= F.col("start")) & (F.col("h") < F.col("end"))).alias("hook"))


@query()
def song_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _song(lambda own, s, h: landmarks(own, s, h, UNIT_SEC).withColumns({c: r(F.col(c)) for c in ("lift", "repetition", "confidence")}), spark, sf_dir)


@query()
def song_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _song(clip_rows, spark, sf_dir)


def clip_rows(own: DataFrame, sections: DataFrame, hooks: DataFrame) -> DataFrame:
    by_bar = sections.withColumns({c: F.ceil(F.col(c) / PER_BAR) for c in ("start", "end")}).where("end > start")
    return clips_of(written(bars_of(own, hooks, PER_BAR, UNIT_SEC)), by_bar, CLIPS)
