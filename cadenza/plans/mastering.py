"""Dynamics of line item tracks: compressor, levels for delivery and what playback devices take off."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dynamics import block_levels, finalised, glued, integrated_level, kept_share, smoothed, soft_knee
from ..sources.dimensions import DEVICE_STAGES, device_stages
from ..sources.tables import WAVES, waves, written
from .signals import REPORT_BLOCK, _weighting_sql
from .song import FS
from .timeline import r

QUERIES, ORACLES = {}, {}
#: Samples of a level block, and the ceiling of the delivered tracks (line items never reach the usual -1 dB after their gain).
BLOCK, CEILING = 20, -8.0
#: Compressor of the line item tracks: quantile, ratio, attack and release in seconds.
GLUE = (0.6, 2.0, 0.03, 0.12)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _share(seconds: float) -> str:
    return repr(math.exp(-1 / (seconds * FS / BLOCK)))


_LEVELS = f"lv AS (SELECT track, i // {BLOCK} AS b, 10 * log10(sum((l * l + r * r) / 2) / {BLOCK} + 1e-12) AS level FROM waves GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {WAVES}, {_LEVELS}, th AS (SELECT track, quantile_cont(level, {GLUE[0]}) AS t FROM lv WHERE level > -60 GROUP BY 1),
tg AS (SELECT track, b, CASE WHEN level - t > 3 THEN (level - t) * (1 - 1 / {GLUE[1]}) WHEN level - t > -3 THEN (1 - 1 / {GLUE[1]}) * pow(level - t + 3, 2) / 12 ELSE 0 END AS x FROM lv JOIN th USING (track)),
st(track, b, g) AS (SELECT track, b, x - x * {_share(GLUE[2])} FROM tg WHERE b = 0 UNION ALL SELECT tg.track, tg.b, tg.x + (st.g - tg.x) * CASE WHEN tg.x > st.g THEN {_share(GLUE[2])} ELSE {_share(GLUE[3])} END FROM st JOIN tg ON tg.track = st.track AND tg.b = st.b + 1),
gn AS (SELECT a.track, a.b, pow(10, -a.g / 20) AS g, pow(10, -coalesce(n.g, a.g) / 20) AS n FROM st a LEFT JOIN st n ON n.track = a.track AND n.b = a.b + 1),
o AS (SELECT w.track, w.i, w.l, w.r, coalesce(g + (n - g) * (i % {BLOCK}) / {BLOCK}, 1) AS f FROM waves w LEFT JOIN gn ON gn.track = w.track AND gn.b = w.i // {BLOCK})
SELECT track, i, round(l * f, 6) + 0.0 AS l, round(r * f, 6) + 0.0 AS r FROM o""")
def glued_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels of each track through a soft-knee compressor at its own level, over chunks of blocks."""
    above, ratio, attack, release = GLUE
    out = glued(waves(spark, sf_dir), FS, above, ratio, attack, release, BLOCK)
    return out.select("track", "i", r(F.col("l"), 6).alias("l"), r(F.col("r"), 6).alias("r"))


_PEAK = 10 ** (CEILING / 20)


@query(f"""WITH RECURSIVE {WAVES}, {_weighting_sql("l", "kl")}, {_weighting_sql("r", "kr")}, en AS (SELECT track, b, sum(e) AS e FROM (SELECT track, i // {REPORT_BLOCK} AS b, avg(y * y) AS e, count(*) AS n FROM kl GROUP BY 1, 2 UNION ALL SELECT track, i // {REPORT_BLOCK}, avg(y * y), count(*) FROM kr GROUP BY 1, 2) WHERE n = {REPORT_BLOCK} GROUP BY 1, 2),
w AS (SELECT track, b, avg(e) OVER (PARTITION BY track ORDER BY b ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS mean, count(*) OVER (PARTITION BY track) AS m FROM en), lo AS (SELECT *, -0.691 + 10 * log10(mean) AS l FROM w WHERE b >= 3 OR (m < 4 AND b = m - 1)),
ga AS (SELECT *, -0.691 + 10 * log10(avg(mean) OVER (PARTITION BY track)) - 10 AS gate FROM lo WHERE l > -70), lu AS (SELECT track, -0.691 + 10 * log10(avg(mean)) AS lufs FROM ga WHERE l > gate GROUP BY 1),
sc AS (SELECT track, i, l * f AS l, r * f AS r, least(1.0, {_PEAK!r} / greatest(abs(l * f), abs(r * f), 1e-12)) AS need FROM (SELECT v.*, coalesce(pow(10, (least(lufs, -7) - lufs) / 20), 1) AS f FROM waves v LEFT JOIN lu USING (track))),
ah AS (SELECT *, min(need) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ahead FROM sc),
bx AS (SELECT *, (sum(ahead) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + greatest(0, 4 - i) * first_value(ahead) OVER (PARTITION BY track ORDER BY i)) / 5 AS box FROM ah),
st(track, i, g) AS (SELECT track, i, CASE WHEN box < 1 THEN box ELSE 1 + (box - 1) * 0.1 END FROM bx WHERE i = 0 UNION ALL SELECT b.track, b.i, CASE WHEN b.box < st.g THEN b.box ELSE st.g + (b.box - st.g) * 0.1 END FROM st JOIN bx b ON b.track = st.track AND b.i = st.i + 1)
SELECT track, i, round(l * least(g, need), 5) + 0.0 AS l, round(r * least(g, need), 5) + 0.0 AS r FROM st JOIN bx USING (track, i)""")
def finalised_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stereo track at its gated loudness, at most -7, below the ceiling; levels and limiter run over chunks."""
    stereo = written(waves(spark, sf_dir))
    out = finalised(stereo, integrated_level(stereo, FS, REPORT_BLOCK), CEILING)
    return out.select("track", "i", r(F.col("l"), 5).alias("l"), r(F.col("r"), 5).alias("r"))


_UNITS = ", ".join(f"('{d}', {c[0]}, {float(c[1])}, {_share(c[2])}, {_share(c[3])}, {float(c[4])})" for d, (_, _, c, _, _) in DEVICE_STAGES.items() if c)


@query(f"""WITH RECURSIVE {WAVES}, {_LEVELS}, dv AS (SELECT * FROM (VALUES {_UNITS}) AS v(device, threshold, ratio, a, q, knee)),
tg AS (SELECT track, device, b, a, q, CASE WHEN o > knee / 2 THEN o * (1 - 1 / ratio) WHEN o > -knee / 2 THEN (1 - 1 / ratio) * pow(o + knee / 2, 2) / (2 * knee) ELSE 0 END AS x FROM (SELECT *, level - threshold AS o FROM lv, dv)),
st(track, device, b, g) AS (SELECT track, device, b, x - x * a FROM tg WHERE b = 0 UNION ALL SELECT tg.track, tg.device, tg.b, tg.x + (st.g - tg.x) * CASE WHEN tg.x > st.g THEN a ELSE q END FROM st JOIN tg ON tg.track = st.track AND tg.device = st.device AND tg.b = st.b + 1)
SELECT track, device, round(avg(g), 4) + 0.0 AS mean_db, round(max(g), 4) + 0.0 AS max_db, count(*) AS n_blocks FROM st GROUP BY 1, 2""")
def device_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dB that the compressor of each device with one takes off each track: mean and largest over its blocks."""
    c = F.col("compressor")
    devices = device_stages(spark).where(c.isNotNull()).select("device", "compressor")
    steps = FS / BLOCK
    levels = block_levels(waves(spark, sf_dir), BLOCK).crossJoin(F.broadcast(devices))  # nine devices at most
    target = levels.select("track", "device", "b", soft_knee(F.col("level") - c.threshold, c.ratio, c.knee).alias("x"), kept_share(c.attack, steps).alias("attack"), kept_share(c.release, steps).alias("release"))
    slowest = max(math.exp(-1 / (max(v[2][2:4]) * steps)) for v in DEVICE_STAGES.values() if v[2])
    g = smoothed(target, ["track", "device"], slowest)
    return g.groupBy("track", "device").agg(r(F.avg("x")).alias("mean_db"), r(F.max("x")).alias("max_db"), F.count(F.lit(1)).alias("n_blocks"))
