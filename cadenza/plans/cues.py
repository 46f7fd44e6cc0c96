"""Cues of generated audio, decimation, levels for delivery, generators, catalogs and reports."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, logistic, mulberry
from ..operators.dynamics import delivery_gain, limited
from ..sources import files
from ..sources.tables import LINES, SAMPLES, lyric_lines, passing, samples, table
from .relational import UNITS, units
from .scoring import ORACLES as SCORING, auto_eq, match_eq
from .timeline import r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sinc_taps(factor: int) -> list[float]:
    """A low-pass of 8 * factor + 1 taps below the new rate's half: a windowed sinc whose taps sum to 1."""
    k = np.arange(8 * factor + 1)
    h = np.sinc((k - 4 * factor) / factor) * (0.54 - 0.46 * np.cos(2 * np.pi * k / (8 * factor)))
    return [float(v) for v in h / h.sum()]


def decimated(signal: DataFrame, factor: int) -> DataFrame:
    """(track, o, y): every factor-th sample of (track, i, x) behind the low-pass, len // factor of them. Each sample is
    sent to the few outputs in whose reach it lies and summed there, so a long track is spread over tasks."""
    if factor <= 1:
        return signal.select("track", F.col("i").alias("o"), F.col("x").alias("y"))
    reach = 4 * factor
    n = signal.groupBy("track").agg(F.floor(F.count(F.lit(1)) / factor).alias("n"))
    taps = F.array(*map(F.lit, sinc_taps(factor)))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - reach) / factor))
    sent = signal.withColumn("o", F.explode(F.sequence(first, F.floor((F.col("i") + reach) / factor))))
    part = F.col("x") * F.get(taps, (F.col("i") - F.col("o") * factor + reach).cast("int"))
    return sent.groupBy("track", "o").agg(F.sum(part).alias("y")).join(n, "track").where(F.col("o") < F.col("n")).select("track", "o", "y")


@query(f"""WITH {SAMPLES}, k AS (SELECT unnest(range(0, 25)) AS k), h0 AS (SELECT k, CASE WHEN k = 12 THEN 1 ELSE sin(pi() * (k - 12) / 3.0) / (pi() * (k - 12) / 3.0) END * (0.54 - 0.46 * cos(2 * pi() * k / 24.0)) AS h FROM k),
h AS (SELECT k, h / sum(h) OVER () AS h FROM h0), n AS (SELECT track, count(*) // 3 AS n FROM samples GROUP BY 1)
SELECT s.track, (s.i - k + 12) // 3 AS o, round(sum(x * h), 6) + 0.0 AS y FROM samples s, h, n WHERE n.track = s.track AND (s.i - k + 12) % 3 = 0 AND s.i - k + 12 >= 0 AND (s.i - k + 12) // 3 < n GROUP BY 1, 2""")
def decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimated(samples(spark, sf_dir).select("track", "i", "x"), 3).select("track", "o", r(F.col("y"), 6).alias("y"))


@query("""WITH a AS (SELECT event_id, (user_id % 4294967296 + (event_id + 1) * 1831565813) % 4294967296 AS a FROM events),
b AS (SELECT event_id, CAST((CAST(xor(a, a >> 15) AS HUGEINT) * (a | 1)) % 4294967296 AS BIGINT) AS t FROM a), c AS (SELECT event_id, xor(t, (t + CAST((CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) % 4294967296 AS BIGINT)) % 4294967296) AS t FROM b)
SELECT event_id, xor(t, t >> 14) / 4294967296.0 AS u FROM c""")
def seeded_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number in [0, 1) for each event: the event's number in its user's own reproducible sequence."""
    return table(spark, sf_dir, "events").select("event_id", mulberry(F.col("event_id").cast("long"), F.pmod(F.col("user_id").cast("long"), F.lit(1 << 32))).alias("u"))


# Ranges of the three cues, steps of the bandwidth cue in Hz, weights and levels.
STATIONARY, SMEAR = (0.25, 0.45), (8.0, 6.0)
BANDWIDTHS = [(15000.0, 0.7), (16800.0, 0.45), (18500.0, 0.15)]
CUE_BIAS, CUE_WEIGHTS = -2.2, (3.2, 1.1, 0.9)
LEVELS = [(0.66, "élevé"), (0.4, "modéré")]
LEAST_PROFILE = 0.05


def stationarity(profiles: DataFrame, bins: int) -> DataFrame:
    """(track, stationarity): the mean correlation of all pairs of a track's profiles (track, profile).

    Correlations of unit vectors sum to (|sum of all|^2 - m) / 2, so no pairs are formed. Profiles with a mean of
    LEAST_PROFILE or less are left out; with fewer than two left it is 0. A flat profile correlates with none.
    """
    mean = F.aggregate("profile", F.lit(0.0), lambda s, v: s + v) / bins
    kept = profiles.withColumn("m", mean).where(F.col("m") > LEAST_PROFILE).withColumn("d", F.transform("profile", lambda v: v - F.col("m")))
    size = F.sqrt(F.aggregate("d", F.lit(0.0), lambda s, v: s + v * v))
    unit = kept.withColumn("size", size).select("track", (F.col("size") > 0).cast("int").alias("own"), F.transform("d", lambda v: F.when(F.col("size") > 0, v / F.col("size")).otherwise(0.0)).alias("d"))
    sums = unit.groupBy("track").agg(F.count(F.lit(1)).alias("m"), F.sum("own").alias("own"), F.array(*[F.sum(F.get("d", F.lit(k))) for k in range(bins)]).alias("t"))
    square = F.aggregate("t", F.lit(0.0), lambda s, v: s + v * v)
    pairs = F.when(F.col("m") >= 2, (square - F.col("own")) / (F.col("m") * (F.col("m") - 1))).otherwise(0.0)
    return sums.select("track", pairs.alias("stationarity"))


def likeness(stationary: Column, bandwidth: Column, kurtosis: Column, nyquist: float) -> dict[str, Column]:
    """Scores of the cues, the probability and its level. A null kurtosis leaves its cue out; content that reaches the
    Nyquist frequency says nothing about a codec."""
    steps = F.when((bandwidth <= 0) | (bandwidth >= 0.93 * nyquist), 0.0)
    for top, score in BANDWIDTHS:
        steps = steps.when(bandwidth < top, score)
    s, b = clamp((stationary - STATIONARY[0]) / STATIONARY[1]), steps.otherwise(0.0)
    k = F.coalesce(clamp((SMEAR[0] - kurtosis) / SMEAR[1]), F.lit(0.0))
    p = logistic(CUE_BIAS + CUE_WEIGHTS[0] * s + CUE_WEIGHTS[1] * b + CUE_WEIGHTS[2] * k)
    level = F.when(p > LEVELS[0][0], LEVELS[0][1]).when(p > LEVELS[1][0], LEVELS[1][1]).otherwise("faible")
    return {"peaks_score": s, "bandwidth_score": b, "smear_score": k, "probability": p, "level": level}


@query(f"""WITH {UNITS}, e AS (SELECT track, u, unnest(t) AS v, unnest(range(0, 24)) AS q FROM units), p AS (SELECT track, u // 5 AS c, q, 60 * avg(v) AS db FROM e GROUP BY 1, 2, 3),
res AS (SELECT track, c, q, greatest(0, db - avg(db) OVER (PARTITION BY track, c ORDER BY q ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) AS v FROM p),
kept AS (SELECT * FROM res QUALIFY avg(v) OVER (PARTITION BY track, c) > 0.05),
pr AS (SELECT a.track, a.c AS ac, b.c AS bc, corr(a.v, b.v) AS r FROM kept a JOIN kept b ON a.track = b.track AND a.q = b.q AND a.c < b.c GROUP BY 1, 2, 3), st AS (SELECT track, avg(r) AS s FROM pr GROUP BY 1),
pw AS (SELECT track, q, avg(v * v) AS w FROM e GROUP BY 1, 2), top AS (SELECT track, max(w) AS w FROM pw GROUP BY 1), bw AS (SELECT track, (max(q) + 1) / 24.0 * 20000 AS hz FROM pw JOIN top USING (track) WHERE pw.w >= top.w / 4 GROUP BY 1),
up AS (SELECT track, u, q, greatest(0, v - lag(v) OVER (PARTITION BY track, q ORDER BY u)) AS up FROM e), fl AS (SELECT track, u, sum(up) AS x FROM up WHERE u > 0 GROUP BY 1, 2),
ku AS (SELECT track, CASE WHEN count(*) > 20 THEN kurtosis_pop(x) + 3 END AS k FROM fl GROUP BY 1),
f AS (SELECT track, coalesce(s, 0) AS s, hz, k FROM bw LEFT JOIN st USING (track) LEFT JOIN ku USING (track)),
g AS (SELECT *, least(1, greatest(0, (s - 0.25) / 0.45)) AS sc, CASE WHEN hz <= 0 OR hz >= 0.93 * 20000 THEN 0 WHEN hz < 15000 THEN 0.7 WHEN hz < 16800 THEN 0.45 WHEN hz < 18500 THEN 0.15 ELSE 0 END AS bc, coalesce(least(1, greatest(0, (8 - k) / 6)), 0) AS kc FROM f),
h AS (SELECT *, 1 / (1 + exp(2.2 - 3.2 * sc - 1.1 * bc - 0.9 * kc)) AS p FROM g)
SELECT track, round(s, 5) + 0.0 AS stationarity, round(hz, 3) AS bandwidth, round(k, 4) AS kurtosis, round(sc, 4) + 0.0 AS peaks_score, CAST(bc AS DOUBLE) AS bandwidth_score, round(kc, 4) + 0.0 AS smear_score, round(p, 5) AS probability,
 CASE WHEN p > 0.66 THEN 'élevé' WHEN p > 0.4 THEN 'modéré' ELSE 'faible' END AS level FROM h""")
def ai_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed peaks from chunk to chunk, bandwidth and blurred onsets of each track of units, and what they say together."""
    own = units(spark, sf_dir).select("track", "u", "t")
    mean = F.array(*[F.avg(F.get("t", F.lit(k))) * 60 for k in range(24)])
    near = lambda v, q: F.slice("db", F.greatest(q - 3, F.lit(1)), F.least(q + 5, F.lit(24)) - F.greatest(q - 3, F.lit(1)) + 1)
    base = lambda v, q: F.aggregate(near(v, q), F.lit(0.0), lambda s, x: s + x) / F.size(near(v, q))
    chunks = own.groupBy("track", F.floor(F.col("u") / 5).alias("c")).agg(mean.alias("db"))
    profiles = chunks.select("track", F.transform("db", lambda v, q: F.greatest(F.lit(0.0), v - base(v, q))).alias("profile"))
    power = own.groupBy("track").agg(F.array(*[F.avg(F.get("t", F.lit(k)) * F.get("t", F.lit(k))) for k in range(24)]).alias("w"))
    loud = F.aggregate(F.sequence(F.lit(0), F.lit(23)), F.lit(-1), lambda a, q: F.when(F.get("w", q) >= F.array_max("w") / 4, q).otherwise(a))
    band = power.select("track", ((loud + 1) / 24.0 * 20000).alias("bandwidth"))
    rise = F.aggregate(F.zip_with("t", F.lag("t").over(Window.partitionBy("track").orderBy("u")), lambda a, b: F.greatest(F.lit(0.0), a - b)), F.lit(0.0), lambda s, v: s + v)
    flux = own.select("track", "u", rise.alias("x")).where("u > 0").groupBy("track").agg(F.when(F.count(F.lit(1)) > 20, F.kurtosis("x") + 3).alias("kurtosis"))
    f = band.join(stationarity(profiles, 24), "track", "left").join(flux, "track", "left").fillna(0.0, ["stationarity"])
    found = f.withColumns(likeness(F.col("stationarity"), F.col("bandwidth"), F.col("kurtosis"), 20000.0))
    places = {"stationarity": 5, "bandwidth": 3, "kurtosis": 4, "peaks_score": 4, "bandwidth_score": 4, "smear_score": 4, "probability": 5}
    return found.select("track", *[r(F.col(c), n).alias(c) for c, n in places.items()], "level")


@query(f"""WITH {SAMPLES}, f AS (SELECT track, i // 40 AS f, count(*) AS n, sqrt(avg(pow(x / 1000, 2))) AS rms FROM samples GROUP BY 1, 2)
SELECT track, f, n, round(rms, 6) AS rms, CASE WHEN n >= 32 AND rms >= 0.004 THEN round(20 * log10(rms), 4) END AS db FROM f""")
def energy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of each frame of 40 samples; null (unvoiced) for one of fewer than 32 samples or an rms below 0.004."""
    x = F.col("x") / 1000
    f = samples(spark, sf_dir).groupBy("track", F.floor(F.col("i") / 40).alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(x * x)).alias("rms"))
    return f.select("track", "f", "n", r(F.col("rms"), 6).alias("rms"), F.when((F.col("n") >= 32) & (F.col("rms") >= 0.004), r(20 * F.log10("rms"))).alias("db"))


def finalised(signal: DataFrame, lufs: Column, ceiling_db: float = -1.0, look: int = 5, release: float = 0.1) -> DataFrame:
    """(track, i, y): the signal at its target of min(-7, lufs), unchanged without a level, then limited; nothing else changes it."""
    x = F.col("x") * delivery_gain(lufs)
    return limited(signal.select("track", "i", x.alias("l"), x.alias("r")), 10 ** (ceiling_db / 20), look, release).select("track", "i", F.col("l").alias("y"))


@query(f"""WITH RECURSIVE {SAMPLES}, lv AS (SELECT track, -0.691 + 10 * log10(avg(pow(x / 100, 2))) AS l FROM samples GROUP BY 1), sc AS (SELECT track, i, x / 100 * pow(10, (least(l, -7) - l) / 20) AS x FROM samples JOIN lv USING (track)),
nd AS (SELECT track, i, x, least(1.0, pow(10, -0.05) / greatest(abs(x), 1e-12)) AS need FROM sc), ah AS (SELECT *, min(need) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ahead FROM nd),
bx AS (SELECT *, (sum(ahead) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + greatest(0, 4 - i) * first_value(ahead) OVER (PARTITION BY track ORDER BY i)) / 5 AS box FROM ah),
g(track, i, g) AS (SELECT track, i, CASE WHEN box < 1 THEN box ELSE 1 + (box - 1) * 0.1 END FROM bx WHERE i = 0 UNION ALL SELECT b.track, b.i, CASE WHEN b.box < g.g THEN b.box ELSE g.g + (b.box - g.g) * 0.1 END FROM g JOIN bx b ON b.track = g.track AND b.i = g.i + 1)
SELECT track, i, round(x * least(g, need), 5) + 0.0 AS y FROM g JOIN bx USING (track, i)""")
def delivered_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's signal at its own loudness (ungated here), at most -7, below a ceiling of -1 dB."""
    s = samples(spark, sf_dir).select("track", "i", (F.col("x") / 100).alias("x"))
    own = s.groupBy("track").agg((-0.691 + 10 * F.log10(F.avg(F.col("x") * F.col("x")))).alias("lufs"))
    return finalised(s.join(own, "track"), F.col("lufs")).select("track", "i", r(F.col("y"), 5).alias("y"))


@query(f"SELECT 'corrective' AS kind, * FROM ({SCORING['auto_eq']}) UNION ALL SELECT 'match' AS kind, * FROM ({SCORING['match_eq']})")
def eq_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters of both EQ lists of each spectrum, one list behind the other."""
    return auto_eq(spark, sf_dir).withColumn("kind", F.lit("corrective")).unionByName(match_eq(spark, sf_dir).withColumn("kind", F.lit("match")))


@query(f"WITH {LINES} SELECT doc_id, text, string_agg(pos, ',' ORDER BY pos) AS places, count(*) AS n FROM lines GROUP BY 1, 2")
def line_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each distinct line of a document stands, in order."""
    return lyric_lines(spark, sf_dir).groupBy("doc_id", "text").agg(F.array_join(F.array_sort(F.collect_list("pos")), ",").alias("places"), F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN coalesce(lang, 'en') ELSE 'en' END AS language FROM documents WHERE doc_id IS NOT NULL""")
def song_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of two thirds of the songs, written as CSV, read back and joined to all; English where it has none."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    path = f"{passing(spark, 'catalog')}/csv"
    d.where("doc_id % 3 <> 0 and lang is not null").select(F.col("doc_id").cast("string").alias("song"), F.col("lang").alias("language")).write.option("header", True).csv(path)
    songs = d.select("doc_id", F.col("doc_id").cast("string").alias("song"))
    return files.with_language(songs, files.catalog(spark, path)).select("doc_id", "language")


@query(f"""WITH {SAMPLES}, t AS (SELECT track, count(*) AS k, round(avg(x), 4) AS mean, round(max(x), 4) AS peak FROM samples GROUP BY 1) SELECT count(*) AS n, round(avg(mean), 4) AS mean, round(avg(peak), 4) AS peak FROM t""")
def track_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of all tracks: their lines and a summary in CSV files; the summary as read back."""
    path = passing(spark, "report")
    rows = files.kept(spark, f"{path}/features", lambda: samples(spark, sf_dir).groupBy("track").agg(F.count(F.lit(1)).alias("k"), r(F.avg("x")).alias("mean"), r(F.max("x")).alias("peak")))
    return files.report(rows, path, ["mean", "peak"]).select("n", r(F.col("mean")).alias("mean"), r(F.col("peak")).alias("peak"))


@query(f"WITH {SAMPLES} SELECT track, i - 8 AS i, round(x * least(1, greatest(0, least((i - 8) / 4.0, (39 - i) / 4.0))), 6) + 0.0 AS y FROM samples WHERE i >= 8 AND i < 40")
def event_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples 8 to 39 of every track with linear fades of four samples at both ends."""
    fade = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least((F.col("i") - 8) / 4.0, (39 - F.col("i")) / 4.0)))
    return samples(spark, sf_dir).where("i >= 8 and i < 40").select("track", (F.col("i") - 8).alias("i"), r(F.col("x") * fade, 6).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity / 50 + l_discount * 10) / 2, 6) AS mid, round((l_quantity / 50 - l_discount * 10) / 2, 6) + 0.0 AS side FROM lineitem")
def line_mid_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity and discount of every order line as two channels: their mid and side."""
    left, right = F.col("l_quantity").cast("double") / 50, F.col("l_discount").cast("double") * 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r((left + right) / 2, 6).alias("mid"), r((left - right) / 2, 6).alias("side"))
