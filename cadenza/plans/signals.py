"""Spectra, pitch, beats and dynamics of signals: the event, line item and embedding tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import amplitude_db, half_up, loudness, midi, power_db
from ..operators import signal as S
from ..operators.beats import beats
from ..operators.dynamics import limited
from ..operators.levels import gated, report
from ..operators.scan import Cascade, chunks_of, scanned, stepped
from ..operators.windows import frame, top
from ..sources.tables import SAMPLES, WAVES, contour, samples, table, waves
from .song import FS, chunked
from .timeline import r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {WAVES} SELECT track, count(*) AS n, round(avg(l), 6) + 0.0 AS mean, round(stddev_samp(l), 6) AS std, round(20 * log10(greatest(max(abs(l)), 1e-12)), 4) + 0.0 AS peak_db, round(10 * log10(greatest(avg(l * l), 1e-12)), 4) + 0.0 AS rms_db FROM waves GROUP BY 1")
def synthetic_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, sample deviation, peak and level of each track."""
    x = F.col("l")
    return waves(spark, sf_dir).groupBy("track").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(x), 6).alias("mean"), r(F.stddev_samp(x), 6).alias("std"), r(amplitude_db(F.max(F.abs(x)))).alias("peak_db"), r(power_db(F.avg(x * x))).alias("rms_db")
    )


SPECTRA = f"""{WAVES}, hann AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 64) AS w FROM (SELECT unnest(range(0, 64)) AS i)), whole AS (SELECT track, i // 64 AS block FROM waves GROUP BY 1, 2 HAVING count(*) = 64),
d AS (SELECT track, v.i // 64 AS block, k, sum(l * w * cos(2 * pi() * k * (v.i % 64) / 64)) AS re, sum(l * w * sin(2 * pi() * k * (v.i % 64) / 64)) AS im FROM waves v JOIN hann h ON h.i = v.i % 64, (SELECT unnest(range(0, 33)) AS k) GROUP BY 1, 2, 3),
p AS (SELECT track, block, k AS bin, (re * re + im * im) / (SELECT sum(w * w) * 64 FROM hann) AS power FROM d JOIN whole USING (track, block))"""


def spectra_of(signal: DataFrame, size: int = 64) -> DataFrame:
    """(track, block, bin, power) of each whole block of `size` samples of a signal (track, i, x). A task has many blocks at once."""
    own = chunks_of(signal, size).where(F.size("row") == size)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        power = S.power_spectrum(np.stack(p.row.to_numpy()).astype(float))
        return pd.DataFrame({"track": p.track, "block": p.chunk, "power": list(power)})

    track = f"track {signal.schema['track'].dataType.simpleString()}"
    return own.mapInPandas(stepped(run), f"{track}, block long, power array<double>").select("track", "block", F.posexplode("power").alias("bin", "power")).withColumn("bin", F.col("bin").cast("long"))


@query(f"WITH {SPECTRA} SELECT track, block, bin, round(power, 9) + 0.0 AS power FROM p")
def fft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra_of(waves(spark, sf_dir).select("track", "i", F.col("l").alias("x"))).select("track", "block", "bin", r(F.col("power"), 9).alias("power"))


AUTOCORR = f"""WITH {SAMPLES}, m AS (SELECT track, avg(x) AS m, count(*) AS n FROM samples GROUP BY 1), c AS (SELECT s.track, i, x - m AS x, n FROM samples s JOIN m USING (track))
SELECT a.track, b.i - a.i AS lag, round(sum(a.x * b.x) / (any_value(a.n) - (b.i - a.i)), 4) + 0.0 AS ac FROM c a JOIN c b ON a.track = b.track AND b.i >= a.i AND b.i - a.i <= 10 GROUP BY 1, 2"""


@query(AUTOCORR)
def autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        v = S.autocorrelation(p.x.to_numpy(), min(10, len(p) - 1))
        return pd.DataFrame({"lag": np.arange(len(v)), "ac": v})

    return S.per_track(samples(spark, sf_dir).select("track", "i", "x"), ["track"], "i", run, "lag long, ac double").select("track", "lag", r(F.col("ac")).alias("ac"))


@query(f"""WITH RECURSIVE {SAMPLES}, y(track, i, x1, x2, y, y1) AS (SELECT track, i, x, CAST(0 AS DOUBLE), 0.2 * x, CAST(0 AS DOUBLE) FROM samples WHERE i = 0 UNION ALL
 SELECT s.track, s.i, s.x, y.x1, 0.2 * s.x + 0.4 * y.x1 + 0.2 * y.x2 + 0.3 * y.y - 0.1 * y.y1, y.y FROM y JOIN samples s ON s.track = y.track AND s.i = y.i + 1) SELECT track, i, round(y, 6) AS y FROM y""")
def biquad_iir(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = scanned(samples(spark, sf_dir).select("track", "i", "x"), Cascade([((0.2, 0.4, 0.2), (-0.3, 0.1))]))
    return y.select("track", "i", r(F.col("y"), 6).alias("y"))


def _weighting_sql(c: str = "l", name: str = "k") -> str:
    """Both sections of the weighting as one recursion over the samples of a channel, one after the other."""
    ((p0, p1, p2), (q1, q2)), ((s0, s1, s2), (t1, t2)) = S.k_weighting(FS)
    first = f"{p0!r} * w.{c} + k.a1"
    return f"""{name}(track, i, a1, a2, b1, b2, y) AS (SELECT track, i, {p1!r} * {c} - {q1!r} * ({p0!r} * {c}), {p2!r} * {c} - {q2!r} * ({p0!r} * {c}), {s1!r} * ({p0!r} * {c}) - {t1!r} * ({s0!r} * ({p0!r} * {c})), {s2!r} * ({p0!r} * {c}) - {t2!r} * ({s0!r} * ({p0!r} * {c})), {s0!r} * ({p0!r} * {c}) FROM waves WHERE i = 0
 UNION ALL SELECT track, i, {p1!r} * x - {q1!r} * u + a2, {p2!r} * x - {q2!r} * u, {s1!r} * u - {t1!r} * v + b2, {s2!r} * u - {t2!r} * v, v
 FROM (SELECT w.track, w.i, w.{c} AS x, a2, b2, {first} AS u, {s0!r} * ({first}) + k.b1 AS v FROM {name} k JOIN waves w ON w.track = k.track AND w.i = k.i + 1))"""


@query(f"""WITH RECURSIVE {WAVES}, {_weighting_sql()}, e AS (SELECT track, i // 20 AS b, avg(y * y) AS e FROM k GROUP BY 1, 2), w AS (SELECT track, b, avg(e) OVER (PARTITION BY track ORDER BY b ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS mean FROM e QUALIFY b >= 3),
g AS (SELECT *, -0.691 + 10 * log10(mean) AS l FROM w WHERE mean > 0), a AS (SELECT *, -0.691 + 10 * log10(avg(mean) OVER (PARTITION BY track)) - 10 AS gate FROM g WHERE l > -70)
SELECT track, round(-0.691 + 10 * log10(avg(mean)), 4) AS lufs FROM a WHERE l > gate GROUP BY 1""")
def k_weighted_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrated loudness of each track: K-weighting as a scan over chunks, then blocks and gates as column expressions."""
    weighted = scanned(waves(spark, sf_dir).select("track", "i", F.col("l").alias("x")), Cascade(S.k_weighting(FS)))
    return integrated(weighted, 20).select("track", r(F.col("lufs")).alias("lufs"))


_PHASES = " UNION ALL ".join(f"SELECT {p} AS phase, t, CASE WHEN t = {p / 4} THEN 1 ELSE sin(pi() * (t - {p / 4})) / (pi() * (t - {p / 4})) END * (0.5 + 0.5 * cos(pi() * (t - {p / 4}) / 8)) AS h FROM (SELECT unnest(range(-7, 9)) AS t)" for p in (1, 2, 3))
#: Samples of a block of the report over line items, and the level from which they count as clipped.
REPORT_BLOCK, REPORT_LIMIT = 10, 0.9


@query(f"""WITH RECURSIVE {WAVES}, {_weighting_sql("l", "kl")}, {_weighting_sql("r", "kr")}, en AS (SELECT track, b, sum(e) AS e FROM (SELECT track, i // {REPORT_BLOCK} AS b, avg(y * y) AS e, count(*) AS n FROM kl GROUP BY 1, 2 UNION ALL SELECT track, i // {REPORT_BLOCK}, avg(y * y), count(*) FROM kr GROUP BY 1, 2) WHERE n = {REPORT_BLOCK} GROUP BY 1, 2),
w AS (SELECT track, b, n, avg(e) OVER (PARTITION BY track ORDER BY b ROWS BETWEEN n - 1 PRECEDING AND CURRENT ROW) AS mean, count(*) OVER (PARTITION BY track, n) AS m FROM en, (VALUES (4), (30)) AS v(n)),
""".replace("ROWS BETWEEN n - 1 PRECEDING AND CURRENT ROW) AS mean, count(*) OVER (PARTITION BY track, n) AS m FROM en, (VALUES (4), (30)) AS v(n)),", "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS mean, count(*) OVER (PARTITION BY track) AS m FROM en, (SELECT 4 AS n) UNION ALL SELECT track, b, n, avg(e) OVER (PARTITION BY track ORDER BY b ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), count(*) OVER (PARTITION BY track) FROM en, (SELECT 30 AS n)),") + f"""
lv AS (SELECT track, n, b, mean, -0.691 + 10 * log10(mean) AS l FROM w WHERE b >= n - 1 OR (m < n AND b = m - 1)),
g AS (SELECT *, -0.691 + 10 * log10(avg(mean) OVER (PARTITION BY track, n)) - CASE n WHEN 4 THEN 10 ELSE 20 END AS gate FROM lv WHERE l > -70),
ld AS (SELECT track, -0.691 + 10 * log10(avg(mean) FILTER (WHERE n = 4)) AS integrated, quantile_cont(l, 0.95) FILTER (WHERE n = 30) - quantile_cont(l, 0.1) FILTER (WHERE n = 30) AS lra FROM g WHERE l > gate GROUP BY 1),
mx AS (SELECT track, max(l) FILTER (WHERE n = 4) AS mm, max(l) FILTER (WHERE n = 30) AS sm FROM lv GROUP BY 1),
ch AS (SELECT track, 0 AS ch, i, l AS x FROM waves UNION ALL SELECT track, 1, i, r FROM waves), pk AS (SELECT track, ch, max(abs(x)) AS p FROM ch GROUP BY 1, 2), ph AS (SELECT phase, t, h / sum(h) OVER (PARTITION BY phase) AS h FROM ({_PHASES})),
tp AS (SELECT track, max(v) AS tp FROM (SELECT a.track, a.ch, a.i, phase, abs(sum(b.x * h)) AS v FROM ch a JOIN pk ON pk.track = a.track AND pk.ch = a.ch AND abs(a.x) >= 0.5 * p CROSS JOIN ph JOIN ch b ON b.track = a.track AND b.ch = a.ch AND b.i = a.i + t GROUP BY 1, 2, 3, 4 UNION ALL SELECT track, ch, -1, 0, p FROM pk) GROUP BY 1),
rn AS (SELECT track, ch, i - row_number() OVER (PARTITION BY track, ch ORDER BY i) AS run FROM ch WHERE abs(x) >= {REPORT_LIMIT}), cl AS (SELECT track, sum(n) AS n FROM (SELECT track, ch, run, count(*) AS n FROM rn GROUP BY 1, 2, 3 HAVING count(*) >= 3) GROUP BY 1),
sp AS (SELECT track, 20 * log10(max(greatest(abs(l), abs(r)))) AS peak, 20 * log10(sqrt(avg(pow((l + r) / 2, 2)))) AS rms FROM waves GROUP BY 1)
SELECT track, round(integrated, 4) AS integrated, round(mm, 4) AS momentary_max, round(sm, 4) AS short_term_max, round(lra, 4) + 0.0 AS lra, round(20 * log10(tp), 4) + 0.0 AS true_peak, round(peak, 4) + 0.0 AS sample_peak, round(rms, 4) + 0.0 AS rms, round(peak - rms, 4) AS crest,
 round(20 * log10(tp) - integrated, 4) AS plr, round(20 * log10(tp) - sm, 4) AS psr, CAST(coalesce(cl.n, 0) AS BIGINT) AS clipped, (SELECT count(*) FROM lv WHERE lv.track = sp.track AND n = 4) AS n_momentary, (SELECT count(*) FROM lv WHERE lv.track = sp.track AND n = 30 AND (b - 29) % 10 = 0) AS n_short_term
FROM sp JOIN ld USING (track) JOIN mx USING (track) JOIN tp USING (track) LEFT JOIN cl USING (track)""")
def loudness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report(waves(spark, sf_dir), FS, REPORT_BLOCK, REPORT_LIMIT)
    levels = ("integrated", "momentary_max", "short_term_max", "lra", "true_peak", "sample_peak", "rms", "crest", "plr", "psr")
    return rows.select("track", *(r(F.col(c)).alias(c) for c in levels), "clipped", F.size("momentary").cast("long").alias("n_momentary"), F.size("short_term").cast("long").alias("n_short_term"))


def integrated(weighted: DataFrame, block: int) -> DataFrame:
    """(track, lufs) of weighted samples (track, i, y): windows of four blocks, gated at -70 and at 10 below their mean."""
    blocks = weighted.groupBy("track", F.floor(F.col("i") / block).alias("b")).agg(F.avg(F.col("y") * F.col("y")).alias("e"))
    windows = blocks.withColumn("mean", F.avg("e").over(frame(["track"], ["b"], -3, 0))).where("b >= 3").withColumn("l", loudness(F.col("mean")))
    return gated(windows, -70, 10).groupBy("track").agg(loudness(F.avg("mean")).alias("lufs"))


@query(f"""WITH ac AS ({AUTOCORR}), teeth AS (SELECT track, CAST(lag / k AS BIGINT) AS lag, ac * w AS v FROM ac, (VALUES (1, 1.0), (2, 0.5), (3, 0.33), (4, 0.25)) AS c(k, w) WHERE lag >= 1 AND lag % k = 0),
s AS (SELECT track, lag, round(sum(v) * exp(-0.5 * pow(log2(lag / 4.0) / 0.9, 2)), 6) AS s FROM teeth GROUP BY 1, 2)
SELECT track, lag, s + 0.0 AS score FROM s QUALIFY row_number() OVER (PARTITION BY track ORDER BY s DESC, lag) = 1""")
def tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comb of autocorrelation at one to four lags under a log-normal prior, over the lag table."""
    ac = autocorr(spark, sf_dir).where("lag >= 1")
    at = lambda k, w: ac.select("track", (F.col("lag") / k).alias("lag"), (F.col("ac") * w).alias("v")).where(F.col("lag") == F.floor("lag"))
    comb = at(1, 1.0).unionByName(at(2, 0.5)).unionByName(at(3, 0.33)).unionByName(at(4, 0.25)).groupBy("track", "lag").agg(F.sum("v").alias("v"))
    prior = F.exp(-0.5 * F.pow(F.log2(F.col("lag") / 4) / 0.9, F.lit(2)))
    return top(comb.withColumn("s", F.round(F.col("v") * prior, 6)), ["track"], [F.desc("s"), F.asc("lag")]).select("track", F.col("lag").cast("long").alias("lag"), (F.col("s") + F.lit(0.0)).alias("score"))


@query()
def beat_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of each user's events, some four apart; k numbers them."""
    found = beats(samples(spark, sf_dir).select("track", "i", "x"), 4.0)
    return found.select("track", (F.row_number().over(Window.partitionBy("track").orderBy("i")) - 1).cast("long").alias("k"), "i")


@query(f"""WITH RECURSIVE {SAMPLES}, nd AS (SELECT track, i, x, least(1.0, 60 / greatest(abs(x), 1e-12)) AS need FROM samples),
ah AS (SELECT *, min(need) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ahead FROM nd),
bx AS (SELECT *, (sum(ahead) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + greatest(0, 4 - i) * first_value(ahead) OVER (PARTITION BY track ORDER BY i)) / 5 AS box FROM ah),
g(track, i, g) AS (SELECT track, i, CASE WHEN box < 1 THEN box ELSE 1 + (box - 1) * 0.1 END FROM bx WHERE i = 0 UNION ALL SELECT b.track, b.i, CASE WHEN b.box < g.g THEN b.box ELSE g.g + (b.box - g.g) * 0.1 END FROM g JOIN bx b ON b.track = g.track AND b.i = g.i + 1)
SELECT track, i, round(x * least(g, need), 4) + 0.0 AS y FROM g JOIN bx USING (track, i)""")
def limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples held under a ceiling of 60: the gain that each needs, the least of the next five, their mean with those
    before, and a release of a tenth of what is missing, as a scan over chunks."""
    x = F.col("x")
    return limited(samples(spark, sf_dir).select("track", "i", x.alias("l"), x.alias("r")), 60.0, 5, 0.1).select("track", "i", r(F.col("l")).alias("y"))


@query(f"""WITH RECURSIVE {SAMPLES}, w AS (SELECT track, i // 8 AS k, -greatest(0, 10 * log10(greatest(sum(x * x) / 8, 1e-12)) - 30) * 0.5 AS want FROM samples GROUP BY 1, 2),
g(track, k, g) AS (SELECT track, k, want * CASE WHEN want < 0 THEN 0.5 ELSE 0.1 END FROM w WHERE k = 0 UNION ALL SELECT w.track, w.k, g.g + (w.want - g.g) * CASE WHEN w.want < g.g THEN 0.5 ELSE 0.1 END FROM g JOIN w ON w.track = g.track AND w.k = g.k + 1),
n AS (SELECT track, max(k) AS m FROM g GROUP BY 1)
SELECT s.track, s.i, round(s.x * pow(10, (a.g + (b.g - a.g) * greatest(0, least(1, s.i / 8.0 - 0.5 - a.k))) / 20), 4) + 0.0 AS y FROM samples s JOIN n USING (track)
 JOIN g a ON a.track = s.track AND a.k = greatest(0, least(m, CAST(floor(s.i / 8.0 - 0.5) AS BIGINT))) JOIN g b ON b.track = s.track AND b.k = least(m, a.k + 1)""")
def glue_compressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = p.x.to_numpy()
        return pd.DataFrame({"i": p.i.to_numpy(), "y": x * S.compressor(x, 30.0, 2.0, 8, 0.5, 0.1)})

    return S.per_track(samples(spark, sf_dir).select("track", "i", "x"), ["track"], "i", run, "i long, y double").select("track", "i", r(F.col("y")).alias("y"))


def centre_of(stereo: DataFrame) -> DataFrame:
    """(track, i, center): what both channels of (track, i, l, r) share. A group is a chunk of 64 frames, whatever the track's
    length; the frames' parts are added up by sample."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        whole = len(p) >= 256 or p.chunk.iloc[0] == 0
        return pd.DataFrame({"i": p.i.to_numpy(), "center": S.center(p.l.to_numpy(), p.r.to_numpy()) if whole else np.zeros(len(p))})

    return S.per_track(chunked(stereo, 256, 128), ["track", "chunk"], "i", run, "i long, center double").groupBy("track", "i").agg(F.sum("center").alias("center"))


@query()
def center_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of each track's shared part beside that of its mid signal, and how much they are alike."""
    mid = waves(spark, sf_dir).withColumn("mid", (F.col("l") + F.col("r")) / 2)
    both = centre_of(mid.select("track", "i", "l", "r")).join(mid.select("track", "i", "mid"), ["track", "i"])
    level = lambda c: r(power_db(F.avg(F.col(c) * F.col(c))))
    return both.groupBy("track").agg(r(F.corr("center", "mid")).alias("r"), level("center").alias("center_db"), level("mid").alias("mid_db"), F.count(F.lit(1)).alias("n"))


def notes_of(points: DataFrame) -> DataFrame:
    # points that sound: the others end no note by themselves
    points = points.where("freq > 0 AND NOT isnan(freq) AND clarity >= 0.6 AND NOT isnan(clarity)")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(S.notes(*(p[c].to_numpy() for c in ("t", "freq", "clarity", "rms"))), columns=["midi", "cents", "start", "end", "velocity"])

    return S.per_track(points, ["track"], "t", run, "midi int, cents int, start double, end double, velocity int")


# events are apart by more than a gap, so each is a note of its own
NOTES = f"""{SAMPLES}, pt AS (SELECT track, i, 48.0003 + x / 20.7 AS p FROM samples), notes AS (SELECT track, i, CAST(floor(round(p, 9) + 0.5) AS INTEGER) AS midi, CAST(floor(round(100 * (p - floor(round(p, 9) + 0.5)), 6) + 0.5) AS INTEGER) AS cents,
 round(i * 20 / 100, 2) AS start, round((i * 20 + 11) / 100, 2) AS "end", CAST(least(127, greatest(20, floor(round(40 + 600 * (0.02 + p / 1000), 6) + 0.5))) AS INTEGER) AS velocity FROM pt)"""


@query(f'WITH {NOTES} SELECT track, midi, cents, start, "end", velocity FROM notes')
def segment_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_of(contour(spark, sf_dir)).withColumns({"start": F.round("start", 2), "end": F.round("end", 2)})


# Semitones of the modes above the tonic.
MODES = {"major": (0, 2, 4, 5, 7, 9, 11), "minor": (0, 2, 3, 5, 7, 8, 10)}
#: Variations of a melody: name, semitones up, seconds later.
VARIATIONS = (("plain", 0, 0.0), ("octave", 12, 0.0), ("fifth", 7, 0.0), ("echo", 0, 0.5))


def snapped(notes: DataFrame, tonic: Column, mode: Column) -> DataFrame:
    """Notes moved into a key: one outside it goes a semitone towards the sign of its cents (in major and minor each
    neighbour of such a note is inside)."""
    pc = F.pmod(F.col("midi") - tonic, F.lit(12))
    inside = F.when(mode == "major", pc.isin(*MODES["major"])).otherwise(pc.isin(*MODES["minor"]))
    return notes.withColumn("midi", F.when(inside, F.col("midi")).when(F.col("cents") < 0, F.col("midi") - 1).otherwise(F.col("midi") + 1))


@query(f"""WITH {NOTES}, k AS (SELECT track, CAST(track % 12 AS INTEGER) AS tonic, track % 2 = 0 AS major FROM notes GROUP BY 1),
s AS (SELECT track, start, "end", CASE WHEN CASE WHEN major THEN (midi - tonic) % 12 IN {MODES['major']} ELSE (midi - tonic) % 12 IN {MODES['minor']} END THEN midi WHEN cents < 0 THEN midi - 1 ELSE midi + 1 END AS midi FROM notes JOIN k USING (track))
SELECT track, name, midi + step AS midi, round(start + dt, 2) AS start, round("end" + dt, 2) AS "end" FROM s, (VALUES {', '.join(map(str, VARIATIONS))}) AS v(name, step, dt)""")
def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's notes snapped to the user's key (tonic and mode follow from the user's number), and their variations."""
    n = notes_of(contour(spark, sf_dir))
    moved = snapped(n, F.pmod(F.col("track"), F.lit(12)), F.when(F.col("track") % 2 == 0, "major").otherwise("minor"))
    moves = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(step).alias("step"), F.lit(dt).alias("dt")) for name, step, dt in VARIATIONS])
    at = lambda c: F.round(F.col(c) + F.col("v.dt"), 2).alias(c)
    return moved.withColumn("v", F.explode(moves)).select("track", "v.name", (F.col("midi") + F.col("v.step")).alias("midi"), at("start"), at("end"))


@query()
def pitch_yin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's tone of 50 ms, at a frequency that follows its value, and the pitch found in it."""
    fs, size = 8000.0, 400

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = [S.yin(0.5 * np.sin(2 * np.pi * f * np.arange(size) / fs), fs) for f in p.freq]
            yield p.assign(found=[f for f, _ in found], clarity=[c for _, c in found])

    tones = table(spark, sf_dir, "events").select("event_id", (80 * F.pow(F.lit(2.0), F.col("value") / 160)).alias("freq"))
    return tones.mapInPandas(run, "event_id long, freq double, found double, clarity double").where("found > 0").select("event_id", r(F.col("freq"), 2).alias("freq"), r(F.col("found"), 2).alias("found"), r(midi(F.col("found")), 2).alias("midi"))


@query(f"""WITH {WAVES} SELECT track, i - 200 AS i, round(l * least(1, greatest(0, least((i - 200) / 20.0, (399 - i) / 20.0))), 6) + 0.0 AS y FROM waves WHERE i >= 200 AND i < 400""")
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch of each track with linear fades of 20 samples at both ends."""
    fade = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least((F.col("i") - 200) / 20.0, (399 - F.col("i")) / 20.0)))
    return waves(spark, sf_dir).where("i >= 200 and i < 400").select("track", (F.col("i") - 200).alias("i"), r(F.col("l") * fade, 6).alias("y"))


@query(f"WITH {WAVES} SELECT track, i, round((l + r) / 2, 6) + 0.0 AS mid, round((l - r) / 2, 6) + 0.0 AS side FROM waves")
def mono_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves(spark, sf_dir).select("track", "i", r((F.col("l") + F.col("r")) / 2, 6).alias("mid"), r((F.col("l") - F.col("r")) / 2, 6).alias("side"))


@query(f"""WITH {SPECTRA}, h AS (SELECT track, power, 69 + 12 * log2(bin * 125.0 / 440) AS m FROM p WHERE bin > 0)
SELECT track, CAST(floor(round(m, 9) + 0.5) AS BIGINT) % 12 AS pc, round(sum(sqrt(power) * greatest(0, 1 - 2 * abs(m - floor(round(m, 9) + 0.5)))), 5) + 0.0 AS w FROM h GROUP BY 1, 2""")
def pitch_class_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitudes of each track by pitch class: a bin counts by how near it is to the note, which is a closed form of the
    bin's frequency instead of a range join."""
    p = spectra_of(waves(spark, sf_dir).select("track", "i", F.col("l").alias("x"))).where("bin > 0")
    h = p.withColumn("m", midi(F.col("bin") * 125.0))
    near = half_up(F.round("m", 9))
    return h.groupBy("track", F.pmod(near, F.lit(12)).cast("long").alias("pc")).agg(r(F.sum(F.sqrt("power") * F.greatest(F.lit(0.0), 1 - 2 * F.abs(F.col("m") - near))), 5).alias("w"))


@query("""WITH s AS (SELECT l_orderkey AS track, CAST(row_number() OVER w AS INTEGER) AS idx, CAST(ceil(l_quantity / 10) AS BIGINT) AS bars, sum(CAST(ceil(l_quantity / 10) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS stop FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
b AS (SELECT track, idx, CAST(stop - bars + unnest(range(0, bars)) AS BIGINT) AS bar FROM s) SELECT track, idx, bar, bar * 4 + k AS beat, (bar * 4 + k) * 0.5 AS t FROM b, (SELECT unnest([0, 1, 2, 3]) AS k)""")
def song_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars and beats (120 BPM) of each order as a song form: its line items are sections, exploded to bars and these to beats."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    length = F.ceil(F.col("l_quantity") / 10)
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), F.row_number().over(w).alias("idx"), length.alias("bars"), F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"))
    bars = s.select("track", "idx", F.explode(F.sequence(F.col("stop") - F.col("bars"), F.col("stop") - 1)).alias("bar"))
    beats = bars.select("track", "idx", "bar", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    beat = F.col("bar") * 4 + F.col("k")
    return beats.select("track", "idx", "bar", beat.alias("beat"), (beat * 0.5).alias("t"))
