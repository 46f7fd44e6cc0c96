"""Melodies of notes: key, and the next note by the singer's own habits and general ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import rotated, upper_median
from ..operators.windows import top
from ..sources.tables import SAMPLES, samples
from .relational import KK_MAJOR, KK_MINOR, T_MAJOR, T_MINOR, _profile_sql
from .signals import MODES
from .timeline import r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# How likely a step of so many semitones is (up to 0, 2, 4, 7, and more); what a step back after a leap of
# LEAP or more, the tonic, and the third or fifth count more; semitones of the register's spread; notes that count for it;
# shares of motif, interval pair and interval; the singer's largest weight, the notes that give it all, and its factor.
PRIORS, LEAP, BACK, TONIC, CHORD = ((0, 0.9), (2, 1.0), (4, 0.55), (7, 0.3), (12, 0.1)), 5, 1.8, 1.35, 1.15
SPREAD, REGISTER, SHARES, MOST, FULL, FACTOR = 6, 12, (0.5, 0.3, 0.2), 0.7, 24, 3

EVENT_NOTES = f"{SAMPLES}, en AS (SELECT track, i, CAST(floor(48 + x / 20) AS INTEGER) AS midi FROM samples)"
KEY_SQL = f"""{_profile_sql()}, h AS (SELECT track, (midi + 144) % 12 AS pc, count(*) AS v FROM en GROUP BY 1, 2), h12 AS (SELECT t.track, p.pc, coalesce(v, 0) AS v FROM (SELECT track FROM en GROUP BY 1 HAVING count(*) >= 4) t CROSS JOIN (SELECT unnest(range(0, 12)) AS pc) p LEFT JOIN h ON h.track = t.track AND h.pc = p.pc),
ks AS (SELECT track, tonic, mode, round(coalesce(0.5 * corr(v, kk) + 0.5 * corr(v, tt), 0), 9) AS s FROM h12, (SELECT unnest(range(0, 12)) AS tonic), prof WHERE k = (pc - tonic + 12) % 12 GROUP BY 1, 2, 3),
key AS (SELECT track, tonic, mode FROM ks QUALIFY row_number() OVER (PARTITION BY track ORDER BY s DESC, mode, tonic) = 1)"""


def event_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notes of their user: (track, i, midi)."""
    return notes_of_events(samples(spark, sf_dir))


def notes_of_events(signal: DataFrame) -> DataFrame:
    return signal.select("track", "i", F.floor(48 + F.col("x") / 20).cast("int").alias("midi"))


def keys_of(notes: DataFrame) -> DataFrame:
    """(track, tonic, mode) of tracks of four notes or more: the rotation whose two profiles fit the pitch classes best."""
    sums = notes.groupBy("track").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.pmod("midi", F.lit(12)) == k).cast("double").alias(f"p{k}") for k in range(12)]).where("n >= 4")
    return keys_of_chroma(sums.select("track", F.array(*[f"p{k}" for k in range(12)]).alias("v")))


def keys_of_chroma(chroma: DataFrame) -> DataFrame:
    """(track, mode, tonic) of each track's pitch classes (track, v): one row a track in, 24 fits of 12 numbers, one row out."""
    keys = [F.struct(F.lit(m).alias("mode"), F.lit(t).alias("tonic")) for m in ("major", "minor") for t in range(12)]
    tests = chroma.withColumn("k", F.explode(F.array(*keys))).select("track", "v", "k.mode", "k.tonic")
    profile = lambda a, b: F.when(F.col("mode") == "major", rotated(a, F.col("tonic"))).otherwise(rotated(b, F.col("tonic")))
    rows = tests.withColumn("z", F.explode(F.arrays_zip("v", profile(KK_MAJOR, KK_MINOR).alias("kk"), profile(T_MAJOR, T_MINOR).alias("tt"))))
    fit = rows.groupBy("track", "mode", "tonic").agg(F.round(F.coalesce(0.5 * F.corr("z.v", "z.kk") + 0.5 * F.corr("z.v", "z.tt"), F.lit(0.0)), 9).alias("s"))
    return top(fit, ["track"], [F.desc("s"), F.asc("mode"), F.asc("tonic")]).select("track", "mode", F.col("tonic").cast("int").alias("tonic"))


def next_notes(notes: DataFrame, keys: DataFrame, best: int = 3) -> DataFrame:
    """(track, midi, p, place) of the likeliest next notes of each track of notes (track, i from 0, midi).

    Candidates are the key's notes within an octave of the last one (all notes where the track has no key). The singer's
    own habits are counts over all of the track's notes: what followed the last two notes (later ones count more), which
    interval followed the last one, and which intervals there are; shares of them back each other off where one has
    nothing to say. They are mixed with how likely steps, stable degrees and the middle of the register are, the more the
    more notes there are. Ties go to the lower note.

    Notes are gathered by track for their order only; habits are sums by (track, interval) or (track, note).
    """
    line = Window.partitionBy("track").orderBy("i")
    n = notes.withColumns({"b": F.lag("midi").over(line), "a": F.lag("midi", 2).over(line), "late": F.row_number().over(Window.partitionBy("track").orderBy(F.desc("i")))})
    n = n.withColumns({"iv": F.col("midi") - F.col("b"), "iv_before": F.col("b") - F.col("a")})
    last = n.groupBy("track").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("midi", "i").alias("last"), F.max_by("b", "i").alias("prev"),
        upper_median(F.collect_list(F.when(F.col("late") <= REGISTER, F.col("midi")))).alias("centre"),
    ).withColumn("last_iv", F.col("last") - F.col("prev"))
    own = n.join(last, "track")
    motif = own.where((F.col("a") == F.col("prev")) & (F.col("b") == F.col("last")) & (F.col("i") < F.col("n") - 1))
    motif = motif.groupBy("track", F.col("midi").alias("m")).agg(F.sum(1 + (F.col("i") - 2) / F.col("n")).alias("motif"))
    steps = own.where(F.col("iv").isNotNull()).groupBy("track", "iv").agg(F.count(F.lit(1)).alias("uni"), F.count_if(F.col("iv_before") == F.col("last_iv")).alias("bi"))
    share = lambda df, c: df.withColumn(c, F.coalesce(F.try_divide(F.col(c), F.sum(c).over(Window.partitionBy("track"))), F.lit(0.0)))
    motif, steps = share(motif, "motif"), share(share(steps, "uni"), "bi")

    c = last.join(keys, "track", "left").withColumn("iv", F.explode(F.sequence(F.lit(-12), F.lit(12)))).withColumn("m", F.col("last") + F.col("iv"))
    degree = F.pmod(F.col("m") - F.col("tonic"), F.lit(12))
    c = c.withColumn("degree", degree).where(F.col("mode").isNull() | F.when(F.col("mode") == "major", degree.isin(*MODES["major"])).otherwise(degree.isin(*MODES["minor"])))
    size, leap = F.abs("iv"), F.col("last_iv")
    prior = F.coalesce(*[F.when(size <= most, p) for most, p in PRIORS])
    back = F.coalesce((F.abs(leap) >= LEAP) & (F.signum("iv") == -F.signum(leap)) & (size <= 2), F.lit(False))
    stable = F.when(F.col("degree") == 0, TONIC).when((F.col("degree") == 7) | (F.col("degree") == F.when(F.col("mode") == "major", 4).otherwise(3)), CHORD).otherwise(1.0)
    off = (F.col("m") - F.col("centre")) / SPREAD
    prior = prior * F.when(back, BACK).otherwise(1.0) * stable * F.exp(-0.5 * off * off)
    known = c.join(motif, ["track", "m"], "left").join(steps, ["track", "iv"], "left")
    habit = sum(w * F.coalesce(x, F.lit(0.0)) for w, x in zip(SHARES, ("motif", "bi", "uni"), strict=True))
    weight = F.least(F.lit(MOST), F.col("n") / FULL)
    scored = known.withColumn("s", (1 - weight) * prior + weight * habit * FACTOR)
    scored = scored.withColumn("p", F.round(F.col("s") / F.sum("s").over(Window.partitionBy("track")), 9))
    return top(scored, ["track"], [F.desc("p"), F.asc("m")], best, "place").select("track", F.col("m").alias("midi"), "p", "place")


def _prior_sql() -> str:
    return "CASE " + " ".join(f"WHEN abs(iv) <= {most} THEN {p}" for most, p in PRIORS) + " END"


@query(f"""WITH {EVENT_NOTES}, {KEY_SQL}, w AS (SELECT *, midi - b AS iv, b - a AS ivb FROM (SELECT *, lag(midi) OVER v AS b, lag(midi, 2) OVER v AS a, row_number() OVER (PARTITION BY track ORDER BY i DESC) AS late, count(*) OVER (PARTITION BY track) AS n FROM en WINDOW v AS (PARTITION BY track ORDER BY i))),
l AS (SELECT track, n, midi AS last, b AS prev, midi - b AS liv FROM w WHERE late = 1), ce AS (SELECT track, list_sort(list(midi)) AS c FROM w WHERE late <= {REGISTER} GROUP BY 1),
mo AS (SELECT w.track, midi AS m, sum(1 + (w.i - 2) / w.n) AS v FROM w JOIN l ON l.track = w.track AND a = prev AND b = last WHERE w.i < w.n - 1 GROUP BY 1, 2), st AS (SELECT w.track, iv, count(*) AS uni, count(*) FILTER (WHERE ivb = liv) AS bi FROM w JOIN l USING (track) WHERE iv IS NOT NULL GROUP BY 1, 2),
mt AS (SELECT track, sum(v) AS t FROM mo GROUP BY 1), sts AS (SELECT track, sum(uni) AS tu, sum(bi) AS tb FROM st GROUP BY 1),
c AS (SELECT l.*, ce.c[len(ce.c) // 2 + 1] AS centre, key.mode, d.iv, last + d.iv AS m, (last + d.iv - key.tonic + 144) % 12 AS deg FROM l JOIN ce USING (track) LEFT JOIN key USING (track), (SELECT unnest(range(-12, 13)) AS iv) d),
k AS (SELECT * FROM c WHERE mode IS NULL OR CASE mode WHEN 'major' THEN deg IN {MODES['major']} ELSE deg IN {MODES['minor']} END),
s AS (SELECT k.track, k.m, (1 - least({MOST}, n / {FULL})) * {_prior_sql().replace('iv', 'k.iv')} * CASE WHEN abs(liv) >= {LEAP} AND sign(k.iv) = -sign(liv) AND abs(k.iv) <= 2 THEN {BACK} ELSE 1 END
 * CASE WHEN deg = 0 THEN {TONIC} WHEN deg = 7 OR deg = CASE mode WHEN 'major' THEN 4 ELSE 3 END THEN {CHORD} ELSE 1 END * exp(-0.5 * pow((k.m - centre) / {SPREAD}, 2))
 + least({MOST}, n / {FULL}) * {FACTOR} * ({SHARES[0]} * coalesce(mo.v / mt.t, 0) + {SHARES[1]} * coalesce(bi / nullif(tb, 0), 0) + {SHARES[2]} * coalesce(uni / tu, 0)) AS s
 FROM k LEFT JOIN mo ON mo.track = k.track AND mo.m = k.m LEFT JOIN mt ON mt.track = k.track LEFT JOIN st ON st.track = k.track AND st.iv = k.iv LEFT JOIN sts ON sts.track = k.track)
SELECT track, m AS midi, round(s / t, 4) AS p, CAST(row_number() OVER (PARTITION BY track ORDER BY round(s / t, 9) DESC, m) AS INTEGER) AS place FROM (SELECT *, sum(s) OVER (PARTITION BY track) AS t FROM s) QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(s / t, 9) DESC, m) <= 3""")
def next_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = event_notes(spark, sf_dir)
    return next_notes(notes, keys_of(notes)).withColumn("p", r(F.col("p")))
