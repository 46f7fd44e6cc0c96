"""Scores, advice and tonal balance over features made of orders and embeddings, with the fixed dimensions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import bell, biquad, clamp, dot, half_up, hann, hz, midi, minute_second, norm, note_name, power_db, response_db, upper_median
from ..operators.windows import spaced, top
from ..sources.dimensions import DEVICES, GENRES, MONO, PRESETS, TARGETS, THIRDS, TONE_BANDS, ANCHORS, anchors, device_filters, floats, genres, thirds, values
from ..sources.tables import table
from .timeline import r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# A song's features out of an order and its line items.
FEATURES = """feat AS (SELECT o_orderkey AS track, 60 + o_orderkey % 120 AS bpm, 90 + o_custkey % 180 AS duration, -16 + (o_totalprice % 12) AS lufs, 4 + (o_totalprice % 11) AS plr, CAST(floor(o_totalprice) AS BIGINT) % 900 AS clipped,
 -2 + (o_totalprice % 3) AS true_peak, n AS occurrences, hook, rep, lift, spread, 20 + o_orderkey % 45 AS sub, 10 + o_custkey % 30 AS mid, (o_orderkey % 10) / 10.0 AS dance, (o_orderkey % 21) / 20.0 AS low_corr, -(o_custkey % 7) / 2.0 AS mono_loss,
 -5 + (o_custkey % 30) / 10.0 AS tilt, (o_orderkey % 13) / 100.0 AS vocal_contrast, (o_custkey % 11) / 12.0 AS vocal_chorus, -3 + (o_orderkey % 7) AS presence FROM orders JOIN (SELECT l_orderkey, count(*) AS n, min(l_quantity) AS hook, avg(l_discount) * 10 AS rep, avg(l_tax) * 100 - 2 AS lift, (max(l_quantity) - min(l_quantity)) / 50 AS spread FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("l_quantity").alias("hook"), (F.avg("l_discount") * 10).alias("rep"),
        (F.avg("l_tax") * 100 - 2).alias("lift"), ((F.max("l_quantity") - F.min("l_quantity")) / 50).alias("spread"),
    )
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    o = table(spark, sf_dir, "orders").select(
        key.alias("track"), (60 + key % 120).alias("bpm"), (90 + cust % 180).alias("duration"), (-16 + price % 12).alias("lufs"), (4 + price % 11).alias("plr"),
        (F.floor(price) % 900).alias("clipped"), (-2 + price % 3).alias("true_peak"),
        (20 + key % 45).alias("sub"), (10 + cust % 30).alias("mid"), (key % 10 / 10.0).alias("dance"), (key % 21 / 20.0).alias("low_corr"), (-(cust % 7) / 2.0).alias("mono_loss"),
        (-5 + cust % 30 / 10.0).alias("tilt"), (key % 13 / 100.0).alias("vocal_contrast"), (cust % 11 / 12.0).alias("vocal_chorus"), (-3 + key % 7).alias("presence"),
    )
    return o.join(li, "track")


def tempo_distance(bpm: Column, windows: Column) -> Column:
    """Octaves from the nearest tempo window, 0 inside one."""
    far = F.transform(windows, lambda w: F.when((bpm >= w.lo) & (bpm <= w.hi), 0.0).when(bpm < w.lo, F.abs(F.log2(bpm / w.lo))).otherwise(F.abs(F.log2(bpm / w.hi))))
    return F.array_min(far)


GENRE_SQL = values([(i, f, float(d[0]), float(d[1]), float(l[0]), float(l[1])) for i, f, _, l, d, *_ in GENRES], ["id", "family", "dlo", "dhi", "lmin", "lmax"], "genre") + ", " + values(
    [(i, float(a), float(b)) for i, _, ws, *_ in GENRES for a, b in ws], ["gid", "wlo", "whi"], "win"
)


def _fit_sql(bpm: str) -> str:
    return f"min(CASE WHEN {bpm} BETWEEN wlo AND whi THEN 0 WHEN {bpm} < wlo THEN abs(log2({bpm} / wlo)) ELSE abs(log2({bpm} / whi)) END)"


@query(f"WITH {FEATURES}, {GENRE_SQL} SELECT track, gid AS genre, round({_fit_sql('bpm')}, 6) + 0.0 AS octaves FROM feat, win GROUP BY 1, 2")
def tempo_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.broadcast(genres(spark).select(F.col("id").alias("genre"), "bpm_windows"))
    return features(spark, sf_dir).select("track", "bpm").crossJoin(g).select("track", "genre", r(tempo_distance(F.col("bpm"), F.col("bpm_windows")), 6).alias("octaves"))


@query(f"""WITH {FEATURES}, {GENRE_SQL}, t AS (SELECT track, gid, any_value(sub) AS sub, any_value(dance) AS dance, any_value(bpm) AS bpm, any_value(tilt) AS tilt, any_value(vocal_contrast) AS contrast, -4 * {_fit_sql('bpm')} AS s FROM feat, win GROUP BY 1, 2),
z AS (SELECT track, gid, s + CASE WHEN sub > 55 THEN CASE gid WHEN 'rap' THEN 1.2 WHEN 'drill' THEN 0.8 WHEN 'latin' THEN 0.4 WHEN 'edm' THEN 0.3 ELSE 0 END ELSE CASE gid WHEN 'pop' THEN 0.5 WHEN 'rock' THEN 0.4 ELSE 0 END END
 + CASE WHEN gid = 'edm' AND dance > 0.35 AND bpm BETWEEN 118 AND 132 THEN 0.8 ELSE 0 END + CASE WHEN gid = 'rock' AND tilt > -3.2 THEN 0.3 WHEN gid = 'edm' AND contrast < 0.03 THEN 0.5 ELSE 0 END - CASE WHEN gid = 'drill' THEN 0.3 ELSE 0 END AS s FROM t)
SELECT track, gid AS genre FROM z QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(s, 9) DESC, gid) = 1""")
def genre_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The bonuses of low end, pulse, tilt and missing voice, and the malus of a narrow window
    g = genres(spark).select(F.col("id").alias("genre"), "bpm_windows")
    gid = F.col("genre")
    heavy = F.create_map(*[F.lit(x) for p in (("rap", 1.2), ("drill", 0.8), ("latin", 0.4), ("edm", 0.3)) for x in p])
    light = F.create_map(F.lit("pop"), F.lit(0.5), F.lit("rock"), F.lit(0.4))
    bonus = F.when(F.col("sub") > 55, F.coalesce(F.try_element_at(heavy, gid), F.lit(0.0))).otherwise(F.coalesce(F.try_element_at(light, gid), F.lit(0.0)))
    pulse = F.when((gid == "edm") & (F.col("dance") > 0.35) & F.col("bpm").between(118, 132), 0.8).otherwise(0.0)
    bright = F.when((gid == "rock") & (F.col("tilt") > -3.2), 0.3).when((gid == "edm") & (F.col("vocal_contrast") < 0.03), 0.5).otherwise(0.0)
    s = -4 * tempo_distance(F.col("bpm"), F.col("bpm_windows")) + bonus + pulse + bright - F.when(gid == "drill", 0.3).otherwise(0.0)
    z = features(spark, sf_dir).select("track", "bpm", "sub", "dance", "tilt", "vocal_contrast").crossJoin(F.broadcast(g)).withColumn("s", F.round(s, 9))
    return top(z, ["track"], [F.desc("s"), F.asc("genre")]).select("track", "genre")


def _bell_sql(x: str, lo, hi, soft) -> str:
    return f"CASE WHEN {x} BETWEEN {lo} AND {hi} THEN 1.0 WHEN {x} < {lo} THEN exp(-0.5 * pow(({lo} - {x}) / {soft}, 2)) ELSE exp(-0.5 * pow(({x} - {hi}) / {soft}, 2)) END"


def _clamp_sql(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


CRITERIA_SQL = f"""{FEATURES}, {GENRE_SQL}, pf AS (SELECT feat.*, least({_fit_sql('bpm')}, {_fit_sql('bpm * 2.0')}, {_fit_sql('bpm / 2.0')}) AS tf FROM feat, win WHERE gid = 'pop' GROUP BY ALL),
crit AS (SELECT track, clipped, 'hook-timing' AS id, 18 AS w, CASE WHEN hook <= 3 THEN 100 WHEN hook <= 5 THEN 92 WHEN hook <= 10 THEN 92 - (hook - 5) * 6 WHEN hook <= 20 THEN 62 - (hook - 10) * 3 ELSE greatest(8, 32 - (hook - 20) * 1.2) END AS s FROM pf
UNION ALL SELECT track, clipped, 'hook-strength', 16, 100 * (0.4 * least(1.0, occurrences / 3) + 0.35 * dance + 0.25 * {_bell_sql('lift', 1.5, 5, 1.5)}) FROM pf
UNION ALL SELECT track, clipped, 'memorability', 10, 100 * {_bell_sql('rep', 0.35, 0.8, 0.15)} FROM pf
UNION ALL SELECT track, clipped, 'groove', 12, 100 * (0.6 * dance + 0.4 * exp(-0.5 * pow(tf / 0.08, 2))) FROM pf
UNION ALL SELECT track, clipped, 'energy', 8, 100 * (0.7 * {_bell_sql('spread', 0.3, 0.85, 0.15)} + 0.3 * CASE WHEN occurrences > 4 THEN 1 ELSE 0.4 END) FROM pf
UNION ALL SELECT track, clipped, 'loudness', 10, 100 * {_clamp_sql(f"0.6 * {_bell_sql('lufs', -11, -7.5, 2.2)} + 0.4 * {_bell_sql('plr', 6, 12, 2)} - CASE WHEN clipped > 0 THEN least(0.5, clipped / 2000) ELSE 0 END - CASE WHEN true_peak > 0 THEN 0.25 WHEN true_peak > -0.5 THEN 0.1 ELSE 0 END")} FROM pf
UNION ALL SELECT track, clipped, 'vocal', 10, CASE WHEN vocal_contrast > 0.03 THEN 100 * {_clamp_sql(f"0.55 * {_clamp_sql('vocal_chorus / 0.7')} + 0.45 * {_bell_sql('presence', -1.5, 2.5, 2)}")} ELSE 90 * (0.5 + 0.5 * {_bell_sql('presence', -1.5, 2.5, 2)}) END FROM pf
UNION ALL SELECT track, clipped, 'translation', 10, 100 * {_clamp_sql(f"0.45 * {_clamp_sql('(mid - 12) / 25')} + 0.3 * {_clamp_sql('(low_corr - 0.5) / 0.45')} + 0.25 * {_clamp_sql('1 + mono_loss / 3')} - CASE WHEN sub > 45 THEN 0.15 ELSE 0 END")} FROM pf
UNION ALL SELECT track, clipped, 'format', 6, 100 * (0.7 * {_bell_sql('duration', 140, 210, 30)} + 0.3 * dance) FROM pf)"""


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criterion rows (track, clipped, id, w, s) of the pop profile: one array of structs exploded, so one pass over the features."""
    g = next(x for x in GENRES if x[0] == "pop")
    windows = F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in g[2]])
    bpm, c = F.col("bpm"), F.col
    tf = F.least(tempo_distance(bpm, windows), tempo_distance(bpm * 2.0, windows), tempo_distance(bpm / 2.0, windows))
    hook = F.when(c("hook") <= 3, 100).when(c("hook") <= 5, 92).when(c("hook") <= 10, 92 - (c("hook") - 5) * 6).when(c("hook") <= 20, 62 - (c("hook") - 10) * 3).otherwise(F.greatest(F.lit(8), 32 - (c("hook") - 20) * 1.2))
    clip = F.when(c("clipped") > 0, F.least(F.lit(0.5), c("clipped") / 2000)).otherwise(0)
    peak = F.when(c("true_peak") > 0, 0.25).when(c("true_peak") > -0.5, 0.1).otherwise(0)
    # The nine criteria with their weights, windows and steps
    scores = [
        ("hook-timing", 18, hook),
        ("hook-strength", 16, 100 * (0.4 * F.least(F.lit(1.0), c("occurrences") / 3) + 0.35 * c("dance") + 0.25 * bell(c("lift"), 1.5, 5, 1.5))),
        ("memorability", 10, 100 * bell(c("rep"), 0.35, 0.8, 0.15)),
        ("groove", 12, 100 * (0.6 * c("dance") + 0.4 * F.exp(-0.5 * F.pow(tf / 0.08, F.lit(2))))),
        ("energy", 8, 100 * (0.7 * bell(c("spread"), 0.3, 0.85, 0.15) + 0.3 * F.when(c("occurrences") > 4, 1.0).otherwise(0.4))),
        ("loudness", 10, 100 * clamp(0.6 * bell(c("lufs"), g[3][0], g[3][1], 2.2) + 0.4 * bell(c("plr"), 6, 12, 2) - clip - peak)),
        ("vocal", 10 if g[7] else 5, F.when(c("vocal_contrast") > 0.03, 100 * clamp(0.55 * clamp(c("vocal_chorus") / 0.7) + 0.45 * bell(c("presence"), -1.5, 2.5, 2))).otherwise(90 * (0.5 + 0.5 * bell(c("presence"), -1.5, 2.5, 2)))),
        ("translation", 10, 100 * clamp(0.45 * clamp((c("mid") - 12) / 25) + 0.3 * clamp((c("low_corr") - 0.5) / 0.45) + 0.25 * clamp(1 + c("mono_loss") / 3) - F.when(c("sub") > 45, 0.15).otherwise(0))),
        ("format", 6, 100 * (0.7 * bell(c("duration"), g[4][0], g[4][1], 30) + 0.3 * c("dance"))),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(w).alias("w"), s.cast("double").alias("s")) for i, w, s in scores])
    return features(spark, sf_dir).select("track", "clipped", F.explode(rows).alias("x")).select("track", "clipped", "x.id", "x.w", "x.s")


@query(f"""WITH {CRITERIA_SQL}, t AS (SELECT track, sum(w * least(100, greatest(0, s))) / sum(w) AS s, max(clipped) AS c FROM crit GROUP BY track), z AS (SELECT track, CAST(floor(round(CASE WHEN c > 500 THEN least(s, 80) ELSE s END, 6) + 0.5) AS BIGINT) AS score FROM t)
SELECT track, score, CASE WHEN score >= 88 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'E' END AS grade FROM z""")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = criteria(spark, sf_dir).groupBy("track").agg((F.sum(F.col("w") * clamp(F.col("s"), 0.0, 100.0)) / F.sum("w")).alias("s"), F.max("clipped").alias("c"))
    score = half_up(F.round(F.when(F.col("c") > 500, F.least(F.col("s"), F.lit(80.0))).otherwise(F.col("s")), 6))
    z = t.select("track", score.alias("score"))
    s = F.col("score")
    return z.select("track", "score", F.when(s >= 88, "A").when(s >= 75, "B").when(s >= 60, "C").when(s >= 40, "D").otherwise("E").alias("grade"))


@query(f"""WITH {CRITERIA_SQL} SELECT track, id, CAST(row_number() OVER (PARTITION BY track ORDER BY round(w * (100 - s), 6) DESC, id) AS INTEGER) AS place FROM crit WHERE round(s, 6) < 85 QUALIFY place <= 3""")
def levers(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = criteria(spark, sf_dir).where(F.round("s", 6) < 85).withColumn("gap", F.round(F.col("w") * (100 - F.col("s")), 6))
    return top(low, ["track"], [F.desc("gap"), F.asc("id")], 3, "place").select("track", "id", "place")


# Advice rules (area, severity, condition); severity 3 is the gravest.
RULES = [
    ("mix", 3, "clipped > 0", "clip"), ("mix", 3, "low_corr < 0.5", "lowmono"), ("mix", 2, "low_corr >= 0.5 AND low_corr < 0.8", "lowmono"), ("mix", 2, "mono_loss < -2.5", "phase"),
    ("master", 3, "true_peak > 0", "tp"), ("master", 2, "true_peak > -1 AND true_peak <= 0", "tp"), ("master", 2, "lufs < -12", "quiet"), ("master", 2, "plr < 6", "crushed"),
    ("structure", 3, "hook > 8", "late-hook"), ("structure", 1, "occurrences < 3", "few-hooks"),
]


@query(f"WITH {FEATURES}, x AS (" + " UNION ALL ".join(f"SELECT track, '{a}' AS area, {s} AS severity, '{i}' AS id, {k} AS k FROM feat WHERE {c}" for k, (a, s, c, i) in enumerate(RULES)) + ") SELECT track, area, severity, id, CAST(row_number() OVER (PARTITION BY track ORDER BY severity DESC, k) AS INTEGER) AS place FROM x WHERE area <> 'structure' OR severity > 1")
def advice_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in one pass: an array of the rules that hold, exploded and ranked by severity, then rule order."""
    rules = F.array(*[F.when(F.expr(c), F.struct(F.lit(a).alias("area"), F.lit(s).alias("severity"), F.lit(i).alias("id"), F.lit(k).alias("k"))) for k, (a, s, c, i) in enumerate(RULES)])
    x = features(spark, sf_dir).select("track", F.explode(F.array_compact(rules)).alias("x")).select("track", "x.*").where("area <> 'structure' or severity > 1")
    return x.withColumn("place", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("severity"), "k"))).select("track", "area", "severity", "id", "place")


@query(f"WITH {FEATURES} SELECT track, CASE WHEN bpm < 90 AND sub > 40 THEN bpm * 2 ELSE bpm END AS shown, CASE WHEN lift > 0 THEN least(hook, lift) ELSE hook END AS hook_time FROM feat")
def double_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when((F.col("bpm") < 90) & (F.col("sub") > 40), F.col("bpm") * 2).otherwise(F.col("bpm"))
    return features(spark, sf_dir).select("track", shown.alias("shown"), F.least("hook", F.when(F.col("lift") > 0, F.col("lift"))).alias("hook_time"))


# An embedding's first 29 components stand for third-octave levels in dB
THIRDS_SQL = values([(k, f) for k, f in enumerate(THIRDS)], ["band", "f"], "third") + ", " + values(
    [(fam, float(a), float(b), float(x), float(y)) for fam, db in TARGETS.items() for a, b, x, y in zip(ANCHORS, ANCHORS[1:], db, db[1:])], ["family", "lo", "hi", "db_lo", "db_hi"], "anchor"
)
TARGET_SQL = "target AS (SELECT family, band, f, db_lo + CASE WHEN f <= lo THEN 0 ELSE ln(f / lo) / ln(hi / lo) END * (db_hi - db_lo) AS db FROM third JOIN anchor ON (f > lo AND f <= hi) OR (f = 25 AND lo = 25))"
LEVELS_SQL = "lv AS (SELECT vec_id, unnest(list_transform(embedding[1:29], lambda x: 60 * CAST(x AS DOUBLE))) AS db, unnest(range(0, 29)) AS band FROM embeddings)"


def targets(spark: SparkSession) -> DataFrame:
    """family, band, f, db: target curves at the third-octave bands, log-interpolated between anchors (fixed tables)."""
    t, a = thirds(spark), F.broadcast(anchors(spark))
    inside = ((F.col("f") > F.col("lo")) & (F.col("f") <= F.col("hi"))) | ((F.col("f") == 25) & (F.col("lo") == 25))
    share = F.when(F.col("f") <= F.col("lo"), 0.0).otherwise(F.ln(F.col("f") / F.col("lo")) / F.ln(F.col("hi") / F.col("lo")))
    return t.join(a, inside).select("family", "band", "f", (F.col("db_lo") + share * (F.col("db_hi") - F.col("db_lo"))).alias("target"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform(F.slice("embedding", 1, 29), lambda x: 60 * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v).alias("band", "db"))


@query(f"""WITH {THIRDS_SQL}, pt AS (SELECT p_partkey, 25 * pow(2, (p_partkey % 90) / 10.0) AS f FROM part)
SELECT p_partkey, family, round(db_lo + CASE WHEN f <= lo THEN 0 ELSE ln(f / lo) / ln(hi / lo) END * (db_hi - db_lo), 5) + 0.0 AS db FROM pt JOIN anchor ON (f > lo AND f <= hi) OR (f = 25 AND lo = 25)""")
def bracket_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's frequency on the target curve of every family, log-interpolated between the anchors around it."""
    f = F.col("f")
    parts = table(spark, sf_dir, "part").select("p_partkey", (25 * F.pow(F.lit(2.0), (F.col("p_partkey") % 90) / 10.0)).alias("f"))
    near = parts.join(F.broadcast(anchors(spark)), ((f > F.col("lo")) & (f <= F.col("hi"))) | ((f == 25) & (F.col("lo") == 25)))
    share = F.when(f <= F.col("lo"), 0.0).otherwise(F.ln(f / F.col("lo")) / F.ln(F.col("hi") / F.col("lo")))
    return near.select("p_partkey", "family", r(F.col("db_lo") + share * (F.col("db_hi") - F.col("db_lo")), 5).alias("db"))


BANDS_SQL = values([(b, float(lo), float(hi)) for b, lo, hi in TONE_BANDS], ["id", "blo", "bhi"], "tone")
BALANCE_SQL = f"""{THIRDS_SQL}, {TARGET_SQL}, {LEVELS_SQL}, df AS (SELECT vec_id, lv.band, f, lv.db - target.db AS d FROM lv JOIN target ON target.band = lv.band AND family = 'pop'),
mid AS (SELECT vec_id, list_sort(list(d) FILTER (WHERE f BETWEEN 100 AND 8000)) AS l FROM df GROUP BY 1), dev AS (SELECT vec_id, band, f, d - l[len(l) // 2 + 1] AS d FROM df JOIN mid USING (vec_id))"""


def deviations(spark: SparkSession, sf_dir: str, family: str = "pop") -> DataFrame:
    """Third-octave deviations from the family's target after alignment by the upper median of 100 Hz to 8 kHz."""
    t = F.broadcast(targets(spark).where(F.col("family") == family).select("band", "f", "target"))
    d = levels(spark, sf_dir).join(t, "band").withColumn("d", F.col("db") - F.col("target"))
    mid = d.groupBy("vec_id").agg(upper_median(F.collect_list(F.when(F.col("f").between(100, 8000), F.col("d")))).alias("off"))
    return d.join(mid, "vec_id").select("vec_id", "band", "f", (F.col("d") - F.col("off")).alias("d"))


@query(f"WITH {BALANCE_SQL}, {BANDS_SQL} SELECT v.vec_id, id AS band, round(coalesce(avg(d), 0), 5) + 0.0 AS deviation FROM (SELECT DISTINCT vec_id FROM dev) v CROSS JOIN tone LEFT JOIN dev ON dev.vec_id = v.vec_id AND f >= blo AND f < bhi GROUP BY 1, 2")
def tonal_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    tone = F.broadcast(spark.createDataFrame([(b, float(lo), float(hi)) for b, lo, hi in TONE_BANDS], "id string, lo double, hi double"))
    d = deviations(spark, sf_dir).crossJoin(tone)
    inside = F.when((F.col("f") >= F.col("lo")) & (F.col("f") < F.col("hi")), F.col("d"))
    return d.groupBy("vec_id", F.col("id").alias("band")).agg(r(F.coalesce(F.avg(inside), F.lit(0.0)), 5).alias("deviation"))


# All advice rules (id, area, condition, severity) in their order; severity 3 is the gravest.
ALL_RULES = [
    ("mud", "mix", "mud > 2.5", "CASE WHEN mud > 4.5 THEN 3 ELSE 2 END"), ("boxy", "mix", "boxy > 2.5", "2"), ("harsh", "mix", "harsh > 2.5", "CASE WHEN harsh > 4 THEN 3 ELSE 2 END"),
    ("sibilance", "voice", "sibilance > 3", "2"), ("dull", "mix", "air < -4", "1"), ("thin", "mix", "low_end < -4", "3"), ("boomy", "mix", "low_end > 4", "3"),
    ("lowmono", "stereo", "low_corr < 0.8", "CASE WHEN low_corr < 0.5 THEN 3 ELSE 2 END"), ("phase", "stereo", "mono_loss < -2.5", "3"), ("narrow", "stereo", "width < 0.06", "1"),
    ("clip", "master", "clipped > 0", "3"), ("tp", "master", "true_peak > -1", "CASE WHEN true_peak > 0 THEN 3 ELSE 2 END"), ("quiet", "master", "lufs < lmin - 1", "2"),
    ("crushed", "master", "lufs > lmax + 0.5 OR plr < 6", "2"), ("lra", "master", "lra > 9 AND genre <> 'rock'", "1"), ("late-hook", "structure", "hook > 8", "3"), ("few-hooks", "structure", "occurrences < 3", "2"),
]
#: Third-octave ranges of which the largest deviation counts, and bands of which the mean does.
WORST = {"mud": (160, 500), "boxy": (500, 1200), "harsh": (2000, 5000), "sibilance": (5000, 10000)}
MEAN = {b: (lo, hi) for b, lo, hi in TONE_BANDS if b in ("air", "sub", "bass")}


@query(f"""WITH {FEATURES}, {GENRE_SQL}, {THIRDS_SQL}, {TARGET_SQL}, {LEVELS_SQL}, guess AS ({ORACLES["genre_guess"]}),
df AS (SELECT vec_id, family, f, lv.db - target.db AS d FROM lv JOIN target ON target.band = lv.band), mid AS (SELECT vec_id, family, list_sort(list(d) FILTER (WHERE f BETWEEN 100 AND 8000)) AS l FROM df GROUP BY 1, 2),
dev AS (SELECT vec_id, family, f, round(d - l[len(l) // 2 + 1], 6) AS d FROM df JOIN mid USING (vec_id, family)),
tone_of AS (SELECT vec_id, family, {", ".join(f"(list(d ORDER BY abs(d) DESC, f) FILTER (WHERE f BETWEEN {a} AND {b}))[1] AS {k}" for k, (a, b) in WORST.items())}, {", ".join(f"avg(d) FILTER (WHERE f >= {a} AND f < {b}) AS {k}" for k, (a, b) in MEAN.items())} FROM dev GROUP BY 1, 2),
whole AS (SELECT feat.*, guess.genre, genre.lmin, genre.lmax, (duration - 90) % 20 / 100.0 AS width, feat.track % 15 AS lra, mud, boxy, harsh, sibilance, round(air, 6) AS air, round((tone_of.sub + bass) / 2, 6) AS low_end
 FROM feat JOIN guess ON guess.track = feat.track JOIN genre ON genre.id = guess.genre LEFT JOIN tone_of ON tone_of.family = genre.family AND tone_of.vec_id = feat.track % (SELECT max(vec_id) + 1 FROM embeddings)),
x AS ({" UNION ALL ".join(f"SELECT track, '{a}' AS area, {s} AS severity, '{i}' AS id, {k} AS k FROM whole WHERE {c}" for k, (i, a, c, s) in enumerate(ALL_RULES))})
SELECT track, area, severity, id, CAST(row_number() OVER (PARTITION BY track ORDER BY severity DESC, k) AS INTEGER) AS place FROM x""")
def all_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 17 rules, with the loudness limits and the target curve of each track's guessed genre.

    A track's spectrum is the vector of its number among the embeddings (modulo the largest), its width and loudness
    range come from its customer and its number, as its other features do. No such vector: no tonal advice.
    """
    t = F.broadcast(targets(spark).select("family", "band", "f", "target"))
    d = levels(spark, sf_dir).join(t, "band").withColumn("d", F.col("db") - F.col("target"))
    item = F.array_sort(F.collect_list(F.struct("f", "d")))
    off = upper_median(F.collect_list(F.when(F.col("f").between(100, 8000), F.col("d"))))
    v = d.groupBy("vec_id", "family").agg(item.alias("l"), off.alias("off"))
    v = v.withColumn("l", F.transform("l", lambda p: F.struct(p.f.alias("f"), F.round(p.d - F.col("off"), 6).alias("d"))))

    def furthest(lo: float, hi: float) -> Column:
        inside = F.filter("l", lambda p: p.f.between(lo, hi))
        return F.array_min(F.transform(inside, lambda p: F.struct((-F.abs(p.d)).alias("s"), p.f.alias("f"), p.d.alias("d")))).d

    def mean(lo: float, hi: float) -> Column:
        inside = F.filter("l", lambda p: (p.f >= lo) & (p.f < hi))
        return F.aggregate(inside, F.lit(0.0), lambda s, p: s + p.d) / F.size(inside)

    m = {k: mean(*x) for k, x in MEAN.items()}
    tones = v.select("vec_id", "family", *[furthest(*x).alias(k) for k, x in WORST.items()], F.round(m["air"], 6).alias("air"), F.round((m["sub"] + m["bass"]) / 2, 6).alias("low_end"))
    g = F.broadcast(genres(spark).select(F.col("id").alias("genre"), "family", F.col("lufs.min").alias("lmin"), F.col("lufs.max").alias("lmax")))
    n = F.broadcast(table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("_n")))
    f = features(spark, sf_dir).join(genre_guess(spark, sf_dir), "track").join(g, "genre").crossJoin(n)
    f = f.withColumns({"vec_id": F.col("track") % F.col("_n"), "width": (F.col("duration") - 90) % 20 / 100.0, "lra": F.col("track") % 15}).join(tones, ["vec_id", "family"], "left")
    rules = F.array(*[F.when(F.expr(c), F.struct(F.lit(a).alias("area"), F.expr(s).alias("severity"), F.lit(i).alias("id"), F.lit(k).alias("k"))) for k, (i, a, c, s) in enumerate(ALL_RULES)])
    x = f.select("track", F.explode(F.array_compact(rules)).alias("x")).select("track", "x.*")
    return x.withColumn("place", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("severity"), "k"))).select("track", "area", "severity", "id", "place")


@query(f"""WITH {LEVELS_SQL}, {THIRDS_SQL}, {BANDS_SQL}, p AS (SELECT vec_id, f, pow(10, db / 10) AS p FROM lv JOIN third USING (band))
SELECT vec_id, round(regr_slope(10 * log10(p), log2(f)) FILTER (WHERE f BETWEEN 100 AND 10000), 5) + 0.0 AS tilt, round(sum(p * f) / sum(p), 3) AS centroid, round(100 * sum(p) FILTER (WHERE f < 250) / sum(p), 5) AS low_share FROM p GROUP BY 1""")
def spectrum_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = levels(spark, sf_dir).join(F.broadcast(thirds(spark)), "band").withColumn("p", F.pow(F.lit(10.0), F.col("db") / 10))
    in_range = F.col("f").between(100, 10000)
    slope = F.regr_slope(F.when(in_range, 10 * F.log10("p")), F.when(in_range, F.log2("f")))
    share = 100 * F.sum(F.when(F.col("f") < 250, F.col("p"))) / F.sum("p")
    return p.groupBy("vec_id").agg(r(slope, 5).alias("tilt"), r(F.sum(F.col("p") * F.col("f")) / F.sum("p"), 3).alias("centroid"), r(share, 5).alias("low_share"))


@query(f"""WITH RECURSIVE {BALANCE_SQL}, sm AS (SELECT vec_id, f, (coalesce(lag(d) OVER w, d) + 2 * d + coalesce(lead(d) OVER w, d)) / 4 AS d FROM dev WINDOW w AS (PARTITION BY vec_id ORDER BY band)),
cd AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(abs(d), 9) DESC, f) AS k FROM sm WHERE f BETWEEN 60 AND 12500 AND abs(d) > 2),
g(vec_id, k, fs, ds) AS (SELECT vec_id, 1, [f], [d] FROM cd WHERE k = 1 UNION ALL SELECT g.vec_id, g.k + 1, CASE WHEN len(g.fs) < 4 AND len(list_filter(g.fs, lambda p: abs(log2(p / c.f)) <= 0.9)) = 0 THEN list_append(g.fs, c.f) ELSE g.fs END,
 CASE WHEN len(g.fs) < 4 AND len(list_filter(g.fs, lambda p: abs(log2(p / c.f)) <= 0.9)) = 0 THEN list_append(g.ds, c.d) ELSE g.ds END FROM g JOIN cd c ON c.vec_id = g.vec_id AND c.k = g.k + 1),
l AS (SELECT vec_id, arg_max(fs, k) AS fs, arg_max(ds, k) AS ds FROM g GROUP BY 1) SELECT vec_id, unnest(fs) AS f, round(least(3, greatest(-3, -0.5 * unnest(ds))), 5) + 0.0 AS gain FROM l""")
def auto_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four corrective filters per spectrum, the largest smoothed deviations at least 0.9 octaves apart."""
    line = Window.partitionBy("vec_id").orderBy("band")
    d = F.col("d")
    sm = deviations(spark, sf_dir).withColumn("d", (F.coalesce(F.lag(d).over(line), d) + 2 * d + F.coalesce(F.lead(d).over(line), d)) / 4)
    cand = sm.where(F.col("f").between(60, 12500) & (F.abs("d") > 2)).select("vec_id", F.log2("f").alias("o"), "f", "d", F.round(F.abs("d"), 9).alias("size"))
    picked = spaced(cand, "size", "o", ["vec_id"], 0.9, most=4)
    return cand.join(picked, ["vec_id", "o"]).select("vec_id", "f", r(clamp(-0.5 * F.col("d"), -3.0, 3.0), 5).alias("gain"))


@query(f"""WITH {LEVELS_SQL}, {THIRDS_SQL}, pr AS (SELECT a.vec_id, a.band, f, b.db - a.db AS d FROM lv a JOIN lv b ON b.vec_id = a.vec_id + 1 AND b.band = a.band JOIN third ON third.band = a.band WHERE a.vec_id % 2 = 0),
md AS (SELECT vec_id, list_sort(list(d) FILTER (WHERE f BETWEEN 100 AND 8000)) AS l FROM pr GROUP BY 1), g AS (SELECT vec_id, f, least(4, greatest(-4, 0.6 * (d - l[len(l) // 2 + 1]))) AS g FROM pr JOIN md USING (vec_id) WHERE f BETWEEN 31 AND 16000)
SELECT vec_id, f, round(g, 5) + 0.0 AS gain FROM g WHERE abs(g) >= 0.5""")
def match_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each even spectrum against the next one as reference, joined by place and band."""
    lv = levels(spark, sf_dir)
    other = lv.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), "band", F.col("db").alias("ref"))
    pr = lv.where("vec_id % 2 = 0").join(other, ["vec_id", "band"]).join(F.broadcast(thirds(spark)), "band").withColumn("d", F.col("ref") - F.col("db"))
    md = pr.groupBy("vec_id").agg(upper_median(F.collect_list(F.when(F.col("f").between(100, 8000), F.col("d")))).alias("off"))
    g = pr.join(md, "vec_id").where(F.col("f").between(31, 16000)).withColumn("g", clamp(0.6 * (F.col("d") - F.col("off")), -4.0, 4.0))
    return g.where(F.abs("g") >= 0.5).select("vec_id", "f", r(F.col("g"), 5).alias("gain"))


FS = 48000.0


def _filters_sql() -> str:
    rows = [(d, k, t, float(f), float(q), float(g)) for d, fs in DEVICES.items() for k, (t, f, q, g) in enumerate(fs)]
    return f"""{values(rows, ["device", "place", "type", "freq", "q", "gain"], "flt")},
base AS (SELECT *, pow(10, gain / 40) AS a, cos(2 * pi() * freq / {FS}) AS c, sin(2 * pi() * freq / {FS}) / (2 * q) AS al FROM flt), sh AS (SELECT *, 2 * sqrt(a) * al AS s, (a + 1) + (a - 1) * c AS up, (a + 1) - (a - 1) * c AS dn FROM base),
co AS (SELECT device, place, type, CASE type WHEN 'lowpass' THEN (1 - c) / 2 WHEN 'highpass' THEN (1 + c) / 2 WHEN 'peaking' THEN 1 + al * a WHEN 'lowshelf' THEN a * (dn + s) ELSE a * (up + s) END AS b0,
 CASE type WHEN 'lowpass' THEN 1 - c WHEN 'highpass' THEN -(1 + c) WHEN 'peaking' THEN -2 * c WHEN 'lowshelf' THEN 2 * a * ((a - 1) - (a + 1) * c) ELSE -2 * a * ((a - 1) + (a + 1) * c) END AS b1,
 CASE type WHEN 'lowpass' THEN (1 - c) / 2 WHEN 'highpass' THEN (1 + c) / 2 WHEN 'peaking' THEN 1 - al * a WHEN 'lowshelf' THEN a * (dn - s) ELSE a * (up - s) END AS b2,
 CASE type WHEN 'peaking' THEN 1 + al / a WHEN 'lowshelf' THEN up + s WHEN 'highshelf' THEN dn + s ELSE 1 + al END AS a0,
 CASE type WHEN 'lowshelf' THEN -2 * ((a - 1) + (a + 1) * c) WHEN 'highshelf' THEN 2 * ((a - 1) - (a + 1) * c) ELSE -2 * c END AS a1,
 CASE type WHEN 'peaking' THEN 1 - al / a WHEN 'lowshelf' THEN up - s WHEN 'highshelf' THEN dn - s ELSE 1 - al END AS a2 FROM sh),
rsp AS (SELECT device, band, f, sum(10 * log10(greatest((pow(b0 + b1 * cos(w) + b2 * cos(2 * w), 2) + pow(b1 * sin(w) + b2 * sin(2 * w), 2)) / (pow(a0 + a1 * cos(w) + a2 * cos(2 * w), 2) + pow(a1 * sin(w) + a2 * sin(2 * w), 2)), 1e-12))) AS db
 FROM co, (SELECT band, f, 2 * pi() * f / {FS} AS w FROM third) GROUP BY 1, 2, 3)"""


def device_response(spark: SparkSession) -> DataFrame:
    """device, band, f, db: summed responses of each device's filters at the third-octave bands (all fixed tables)."""
    k = biquad(F.col("type"), F.col("freq"), F.col("q"), F.col("gain"), FS)
    flt = device_filters(spark).select("device", *[c.alias(n) for n, c in k.items()])
    db = response_db({n: F.col(n) for n in k}, F.col("f"), FS)
    return flt.crossJoin(F.broadcast(thirds(spark))).groupBy("device", "band", "f").agg(F.sum(db).alias("db"))


@query(f"""WITH {_filters_sql().rsplit("rsp AS", 1)[0].rstrip().rstrip(",")}, pt AS (SELECT p_partkey, 2 * pi() * 25 * pow(2, (p_partkey % 90) / 10.0) / {FS} AS w FROM part)
SELECT p_partkey, device, round(sum(10 * log10(greatest((pow(b0 + b1 * cos(w) + b2 * cos(2 * w), 2) + pow(b1 * sin(w) + b2 * sin(2 * w), 2)) / (pow(a0 + a1 * cos(w) + a2 * cos(2 * w), 2) + pow(a1 * sin(w) + a2 * sin(2 * w), 2)), 1e-12))), 4) + 0.0 AS db FROM co, pt GROUP BY 1, 2""")
def filter_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each device's filters do, one after the other, at each part's frequency."""
    k = biquad(F.col("type"), F.col("freq"), F.col("q"), F.col("gain"), FS)
    flt = F.broadcast(device_filters(spark).select("device", *[c.alias(n) for n, c in k.items()]))
    parts = table(spark, sf_dir, "part").select("p_partkey", (25 * F.pow(F.lit(2.0), (F.col("p_partkey") % 90) / 10.0)).alias("f"))
    db = response_db({n: F.col(n) for n in k}, F.col("f"), FS)
    return parts.crossJoin(flt).groupBy("p_partkey", "device").agg(r(F.sum(db)).alias("db"))


DEVICE_SQL = values([(d, d in MONO) for d in DEVICES], ["device", "mono"], "dv")


@query(f"""WITH {THIRDS_SQL}, {TARGET_SQL}, {LEVELS_SQL}, {DEVICE_SQL}, {_filters_sql()}, x AS (SELECT vec_id, dv.device, lv.db - target.db AS d FROM lv JOIN target ON target.band = lv.band AND family = 'pop' CROSS JOIN dv LEFT JOIN rsp ON rsp.device = dv.device AND rsp.band = lv.band WHERE coalesce(rsp.db, 0) > -12),
m AS (SELECT vec_id, device, list_sort(list(d)) AS l FROM x GROUP BY 1, 2), e AS (SELECT x.vec_id, x.device, sqrt(avg(pow(d - l[len(l) // 2 + 1], 2))) AS rms FROM x JOIN m ON m.vec_id = x.vec_id AND m.device = x.device GROUP BY 1, 2)
SELECT vec_id, device, CASE WHEN device = 'studio' THEN 100.0 ELSE floor(round(100 * exp(-0.5 * pow(greatest(0, rms - 2) / 4, 2)), 6) + 0.5) END AS score FROM e""")
def device_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a spectrum keeps its shape on each device, over the bands that the device reproduces. The studio is the reference: 100."""
    dv = spark.createDataFrame([(d,) for d in DEVICES], "device string").crossJoin(thirds(spark).select("band"))
    heard = dv.join(device_response(spark).select("device", "band", F.col("db").alias("resp")), ["device", "band"], "left").where(F.coalesce("resp", F.lit(0.0)) > -12)
    t = targets(spark).where("family = 'pop'").select("band", "target")
    x = levels(spark, sf_dir).join(F.broadcast(t), "band").join(F.broadcast(heard.select("device", "band")), "band").withColumn("d", F.col("db") - F.col("target"))
    per = x.groupBy("vec_id", "device").agg(F.collect_list("d").alias("l"))
    off = upper_median(F.col("l"))
    square = F.aggregate("l", F.lit(0.0), lambda a, v: a + (v - F.col("off")) * (v - F.col("off"))) / F.size("l")
    rms = per.withColumn("off", off).withColumn("rms", F.sqrt(square))
    score = half_up(F.round(100 * F.exp(-0.5 * F.pow(F.greatest(F.lit(0.0), F.col("rms") - 2) / 4, F.lit(2))), 6)).cast("double")
    return rms.select("vec_id", "device", F.when(F.col("device") == "studio", 100.0).otherwise(score).alias("score"))


_GENRE_PLACE = values([(i, k) for k, (i, *_) in enumerate(GENRES)], ["pid", "place"], "placed")


@query(f"""WITH {GENRE_SQL}, {_GENRE_PLACE}, d AS (SELECT id, any_value(family) AS family, count(*) AS n_windows, min(wlo) AS lo, max(whi) AS hi, any_value(dhi - dlo) AS span FROM genre JOIN win ON gid = id GROUP BY 1)
SELECT id, family, n_windows, lo, hi, span, count(*) AS n_customers, round(avg(c_acctbal), 2) AS balance FROM customer JOIN placed ON place = c_custkey % {len(GENRES)} JOIN d ON id = pid GROUP BY ALL""")
def dims_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the genre that their number names, with the genre's tempo windows and length from the dimension."""
    g = genres(spark).select("id", "family", F.col("duration.hi").alias("dhi"), F.col("duration.lo").alias("dlo"), F.explode("bpm_windows").alias("w"))
    d = g.groupBy("id", "family").agg(F.count(F.lit(1)).alias("n_windows"), F.min("w.lo").alias("lo"), F.max("w.hi").alias("hi"), F.first(F.col("dhi") - F.col("dlo")).alias("span"))
    place = spark.createDataFrame([(i, k) for k, (i, *_) in enumerate(GENRES)], "id string, place int")
    by = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % len(GENRES)).cast("int").alias("place")).agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.avg("c_acctbal"), 2).alias("balance"))
    return by.join(F.broadcast(d.join(place, "id")), "place").drop("place")


@query(f"WITH {values([(p[0], float(p[1]), float(p[5]), float(p[8])) for p in PRESETS], ['id', 'lufs', 'width', 'ratio'], 'preset')} SELECT p_partkey, id, round(p_retailprice / 100 + lufs, 6) AS gain, p_size * width AS w FROM part, preset WHERE p_size > 45 AND ratio >= 2")
def preset_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    preset = spark.createDataFrame([(p[0], *floats((p[1], p[5], p[8]))) for p in PRESETS], "id string, lufs double, width double, ratio double").where("ratio >= 2")
    part = table(spark, sf_dir, "part").where("p_size > 45").select("p_partkey", "p_size", "p_retailprice")
    return part.crossJoin(F.broadcast(preset)).select("p_partkey", "id", r(F.col("p_retailprice") / 100 + F.col("lufs"), 6).alias("gain"), (F.col("p_size") * F.col("width")).alias("w"))


@query("""SELECT event_id, round(10 * log10(greatest(value, 1e-12)), 6) AS db, round(69 + 12 * log2(value / 440), 6) AS midi, round(440 * pow(2, (round(least(value, 130)) - 69) / 12), 4) AS hz, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS p, round(tanh(value / 100), 6) AS sat,
 CAST(floor(value + 0.5) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(value + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM events""")
def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    # a logarithm that Spark gives as NULL is minus infinity or no number in the SQL
    note = F.when(v == 0, float("-inf")).when(v < 0, float("nan")).otherwise(r(midi(v), 6))
    return table(spark, sf_dir, "events").select(
        "event_id", r(power_db(v), 6).alias("db"), note.alias("midi"), r(hz(F.round(F.least(v, F.lit(130.0)))), 4).alias("hz"), r(1 / (1 + F.exp(-(v - 50) / 10)), 6).alias("p"),
        r(F.tanh(v / 100), 6).alias("sat"), minute_second(v).alias("clock"),
    )


@query("""SELECT event_id, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][CAST(floor(value + 0.5) AS BIGINT) % 12 + 1] || CAST(CAST(floor(value + 0.5) AS BIGINT) // 12 - 1 AS VARCHAR) AS note FROM events""")
def note_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", note_name(F.col("value")).alias("note"))


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings) SELECT vec_id, round(sqrt(list_inner_product(a, a)), 6) AS norm,
 round(list_sum([a[n + 1] * cos({math.pi} / 64 * (n + 0.5) * 2) for n in range(0, 64)]), 5) + 0.0 AS c2, round(a[62], 6) + 0.0 AS turned, round(list_sum([a[n + 1] * (0.5 - 0.5 * cos(2 * {math.pi} * n / 64)) for n in range(0, 64)]), 5) + 0.0 AS windowed FROM v""")
def scalar_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm, second cosine coefficient, circular shift and window of vectors of 64 components."""
    a = F.transform("embedding", lambda x: x.cast("double"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", a.alias("a"))
    c2 = F.aggregate(F.transform("a", lambda x, n: x * F.cos(math.pi / 64 * (n + 0.5) * 2)), F.lit(0.0), lambda s, x: s + x)
    windowed = F.aggregate(F.transform("a", lambda x, n: x * hann(n, 64)), F.lit(0.0), lambda s, x: s + x)
    turned = F.get(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("a", F.pmod(i - 3, F.lit(64)))), F.lit(0))
    return v.select("vec_id", r(norm(F.col("a")), 6).alias("norm"), r(c2, 5).alias("c2"), r(turned, 6).alias("turned"), r(windowed, 5).alias("windowed"))


@query("WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings) SELECT a.vec_id, round(list_inner_product(a.a, b.a), 6) + 0.0 AS dot FROM u a JOIN u b ON b.vec_id = a.vec_id + 1")
def neighbour_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.transform("embedding", lambda x: x.cast("double"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", a.alias("a"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return v.join(nxt, "vec_id").select("vec_id", r(dot(F.col("a"), F.col("b")), 6).alias("dot"))
