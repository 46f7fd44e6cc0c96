"""Stereo image and high-band rises of line item tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stereo import high_band_rises, low_pass, stereo_report
from ..sources.tables import WAVES, waves
from .timeline import r

QUERIES, ORACLES = {}, {}
#: Samples a second and frames of the report, and of the rises with their seconds.
RATE, SIZE, HOP, SHORT, SHORT_HOP, SECONDS = 44100.0, 256, 128, 64, 32, 0.01


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _power(source: str, columns: str, size: int, hop: int, bins: str) -> str:
    """Power of the bins of each frame (track, f) of a source (track, i, columns), by the sums themselves."""
    h = f"(0.5 - 0.5 * cos(2 * pi() * j / {size}))"
    norm = f"({size} * (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * j / {size}), 2)) FROM range({size}) AS t(j)))"
    parts = ", ".join(f"(pow(sum({c} * {h} * cos(2 * pi() * k * j / {size})), 2) + pow(sum({c} * {h} * sin(2 * pi() * k * j / {size})), 2)) / {norm} AS {c}" for c in columns.split())
    frames = f"SELECT track, unnest(range(0, (max(i) + 1 - {size}) // {hop} + 1)) AS f FROM {source} GROUP BY 1 HAVING max(i) + 1 >= {size}"
    return f"""SELECT track, f, k, {parts} FROM (SELECT s.track, f, i - f * {hop} AS j, {columns.replace(' ', ', ')} FROM ({frames}) AS fr JOIN {source} AS s ON s.track = fr.track AND i >= f * {hop} AND i < f * {hop} + {size}) AS v, (SELECT unnest({bins}) AS k) AS b GROUP BY 1, 2, 3"""


((_B0, _B1, _B2), (_A1, _A2)) = low_pass(120.0, 0.707, RATE)
_NEXT = {c: f"{_B0!r} * w.{c} + p.{c}1" for c in "lr"}
_LOW = f"""lp(track, i, l, r, l1, l2, r1, r2) AS (SELECT track, i, {_B0!r} * l, {_B0!r} * r, {_B1!r} * l - {_A1!r} * {_B0!r} * l, {_B2!r} * l - {_A2!r} * {_B0!r} * l, {_B1!r} * r - {_A1!r} * {_B0!r} * r, {_B2!r} * r - {_A2!r} * {_B0!r} * r FROM waves WHERE i = 0
 UNION ALL SELECT track, i, yl, yr, {_B1!r} * xl - {_A1!r} * yl + l2, {_B2!r} * xl - {_A2!r} * yl, {_B1!r} * xr - {_A1!r} * yr + r2, {_B2!r} * xr - {_A2!r} * yr
 FROM (SELECT w.track, w.i, w.l AS xl, w.r AS xr, l2, r2, {_NEXT['l']} AS yl, {_NEXT['r']} AS yr FROM lp p JOIN waves w ON w.track = p.track AND w.i = p.i + 1))"""
_CORR = "CASE WHEN sum(l * l) < 1e-12 OR sum(r * r) < 1e-12 THEN 1 ELSE sum(l * r) / sqrt(sum(l * l) * sum(r * r)) END"


def _width(lo: int, hi: int) -> str:
    inside = f"k >= greatest(1, floor({lo} / {RATE / SIZE!r})) AND k < ceil({hi} / {RATE / SIZE!r})"
    side, mid = (f"coalesce(sum({c}) FILTER (WHERE {inside}), 0)" for c in ("side", "mid"))
    return f"CASE WHEN {mid} + {side} > 1e-12 THEN {side} / ({mid} + {side}) ELSE 0 END"


_BANDS = {"width": (20, 20000), "width_120": (20, 120), "width_500": (120, 500), "width_2k": (500, 2000), "width_8k": (2000, 8000), "width_high": (8000, 20000)}


@query(f"""WITH RECURSIVE {WAVES}, {_LOW}, ms AS (SELECT track, i, (l + r) / 2 AS mid, (l - r) / 2 AS side FROM waves), fp AS ({_power('ms', 'mid side', SIZE, HOP, f'range(0, {SIZE // 2 + 1})')}),
lt AS (SELECT track, k, avg(mid) AS mid, avg(side) AS side FROM fp GROUP BY 1, 2), wd AS (SELECT track, {', '.join(f'{_width(*v)} AS {n}' for n, v in _BANDS.items())} FROM lt GROUP BY 1),
lo AS (SELECT track, {_CORR} AS low FROM lp GROUP BY 1), en AS (SELECT track, {_CORR} AS c, sum(l * l) AS el, sum(r * r) AS er, sum(l * r) AS x FROM waves GROUP BY 1)
SELECT track, round(c, 5) + 0.0 AS correlation, round(low, 5) + 0.0 AS low_correlation, {', '.join(f'round(coalesce({n}, 0), 5) + 0.0 AS {n}' for n in _BANDS)}, round(10 * log10(greatest(el / greatest(er, 1e-12), 1e-12)), 4) + 0.0 AS balance_db,
 round(CASE WHEN el + er > 1e-12 THEN least(0, 10 * log10(greatest((el + er + 2 * x) / 2 / (el + er), 1e-12))) ELSE 0 END, 4) + 0.0 AS mono_loss_db FROM en JOIN lo USING (track) LEFT JOIN wd USING (track)""")
def stereo_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stereo report of each track: likeness of the channels, also of their lows, width by band, balance, loss in mono."""
    rows = stereo_report(waves(spark, sf_dir), RATE, SIZE, HOP)
    widths = [r(F.get("widths", F.lit(k)), 5).alias(n) for k, n in enumerate(list(_BANDS)[1:])]
    return rows.select("track", r(F.col("correlation"), 5).alias("correlation"), r(F.col("low_correlation"), 5).alias("low_correlation"), r(F.col("width"), 5).alias("width"), *widths, r(F.col("balance_db")).alias("balance_db"), r(F.col("mono_loss_db")).alias("mono_loss_db"))


_SPAN = int(RATE * SECONDS + 0.5)
_FIRST = int(5000 / (RATE / SHORT))


@query(f"""WITH {WAVES}, n AS (SELECT track, least(count(*), {_SPAN}) AS span, (count(*) - least(count(*), {_SPAN})) // 2 AS start FROM waves GROUP BY 1),
cut AS (SELECT track, i - start AS i, (l + r) / 2 AS x FROM waves JOIN n USING (track) WHERE i >= start AND i < start + span), fp AS ({_power('cut', 'x', SHORT, SHORT_HOP, f'range({_FIRST}, {SHORT // 2 + 1})')}),
lv AS (SELECT track, f, ln(1 + 1e5 * sum(x)) AS v FROM fp JOIN n USING (track) WHERE f < (span - {SHORT}) // {SHORT_HOP} GROUP BY 1, 2)
SELECT track, f, round(greatest(0, coalesce(v - lag(v) OVER (PARTITION BY track ORDER BY f), 0)), 5) + 0.0 AS rise FROM lv""")
def high_band_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rises of the energy above 5 kHz in the middle of each track's mid signal."""
    mono = waves(spark, sf_dir).select("track", "i", ((F.col("l") + F.col("r")) / 2).alias("x"))
    return high_band_rises(mono, RATE, SHORT, SHORT_HOP, seconds=SECONDS).select("track", "f", r(F.col("rise"), 5).alias("rise"))
