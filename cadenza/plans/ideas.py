"""Ideas for a song from its features, features of units brought to one scale, and names of stems."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import NOTE_NAMES, half_up
from ..functions.text import STEM_ALIASES, STEMS, stem_of
from ..sources.dimensions import GENRES
from ..sources.tables import table
from .relational import UNITS, units
from .scoring import FEATURES, features, hz
from .timeline import r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _note(steps: int) -> Column:
    return F.get(F.array(*map(F.lit, NOTE_NAMES)), F.pmod(F.col("tonic") + steps, F.lit(12)).cast("int"))


def ideas_of(songs: DataFrame) -> DataFrame:
    """(track, place, tag, idea, value, note), one row for each idea that a song's features call for, in order of place.

    songs: track, family, genre, tonic (0 to 11), minor, bpm, bar_sec, width, lift, drops, clip_start. An idea has a number
    (Hz, seconds, beats a minute) or a note where it needs one. A missing feature calls for nothing.
    """
    c = F.col
    none, always = F.lit(None).cast("double"), F.lit(True)
    rules = [
        ("bass", "tune_bass", c("family").isin("hiphop", "edm"), hz(24 + c("tonic")), _note(0)),
        ("bass", "glide_a_fifth", c("family").isin("hiphop", "edm"), none, _note(7)),
        ("hook", "double_the_hook", always, none, None),
        ("energy", "beat_of_silence", (c("drops") == 0) | ((F.abs("lift") < math.inf) & (c("lift") < 2)), none, None),
        ("transition", "opening_filter", always, 2 * c("bar_sec"), None),
        ("gimmick", "signature_sound", always, none, None),
        ("space", "narrow_verse_wide_chorus", c("width") < 0.12, none, None),
        ("version", "faster", c("bpm").isNotNull(), half_up(c("bpm") * 1.2).cast("double"), None),
        ("version", "slower", c("bpm").isNotNull(), half_up(c("bpm") * 0.84).cast("double"), None),
        ("clip", "push_the_clip", c("clip_start").isNotNull(), c("clip_start"), None),
        ("harmony", "relative_major", c("minor"), none, _note(3)),
        ("harmony", "borrowed_minor_fourth", ~c("minor"), none, F.concat(_note(5), F.lit("m"))),
    ]
    rows = [
        F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(k).alias("place"), F.lit(tag).alias("tag"), F.lit(idea).alias("idea"), value.cast("double").alias("value"), (F.lit(None).cast("string") if note is None else note).alias("note")))
        for k, (tag, idea, rule, value, note) in enumerate(rules, 1)
    ]
    return songs.select("track", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("track", "x.*")


_GENRES = ", ".join(f"({k}, '{g[0]}', '{g[1]}')" for k, g in enumerate(GENRES))
_NOTES = "[" + ", ".join(f"'{n}'" for n in NOTE_NAMES) + "]"


@query(f"""WITH {FEATURES}, f AS (SELECT track, family, CAST(track * 7 % 12 AS INTEGER) AS tonic, track % 2 = 1 AS minor, bpm, 240.0 / bpm AS bar, spread / 4 AS width, lift, occurrences % 3 AS drops, hook FROM feat JOIN (SELECT * FROM (VALUES {_GENRES}) AS v(gk, genre, family)) AS g ON gk = track % 8)
SELECT track, place, tag, idea, round(value, 4) AS value, note FROM (
SELECT track, 1 AS place, 'bass' AS tag, 'tune_bass' AS idea, 440 * pow(2, (24 + tonic - 69) / 12) AS value, {_NOTES}[tonic + 1] AS note FROM f WHERE family IN ('hiphop', 'edm')
UNION ALL SELECT track, 2, 'bass', 'glide_a_fifth', NULL, {_NOTES}[(tonic + 7) % 12 + 1] FROM f WHERE family IN ('hiphop', 'edm')
UNION ALL SELECT track, 3, 'hook', 'double_the_hook', NULL, NULL FROM f
UNION ALL SELECT track, 4, 'energy', 'beat_of_silence', NULL, NULL FROM f WHERE drops = 0 OR lift < 2
UNION ALL SELECT track, 5, 'transition', 'opening_filter', 2 * bar, NULL FROM f
UNION ALL SELECT track, 6, 'gimmick', 'signature_sound', NULL, NULL FROM f
UNION ALL SELECT track, 7, 'space', 'narrow_verse_wide_chorus', NULL, NULL FROM f WHERE width < 0.12
UNION ALL SELECT track, 8, 'version', 'faster', floor(bpm * 1.2 + 0.5), NULL FROM f
UNION ALL SELECT track, 9, 'version', 'slower', floor(bpm * 0.84 + 0.5), NULL FROM f
UNION ALL SELECT track, 10, 'clip', 'push_the_clip', hook, NULL FROM f
UNION ALL SELECT track, 11, 'harmony', 'relative_major', NULL, {_NOTES}[(tonic + 3) % 12 + 1] FROM f WHERE minor
UNION ALL SELECT track, 12, 'harmony', 'borrowed_minor_fourth', NULL, {_NOTES}[(tonic + 5) % 12 + 1] || 'm' FROM f WHERE NOT minor)""")
def song_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideas for each order as a song: its key, width and drops are taken from the order's numbers and line items."""
    g = F.broadcast(spark.createDataFrame([(k, x[0], x[1]) for k, x in enumerate(GENRES)], "gk int, genre string, family string"))
    f = features(spark, sf_dir).withColumn("gk", (F.col("track") % 8).cast("int")).join(g, "gk")
    songs = f.select(
        "track", "genre", "family", (F.col("track") * 7 % 12).cast("int").alias("tonic"), (F.col("track") % 2 == 1).alias("minor"), "bpm", (240.0 / F.col("bpm")).alias("bar_sec"),
        (F.col("spread") / 4).alias("width"), "lift", (F.col("occurrences") % 3).alias("drops"), F.col("hook").alias("clip_start"),
    )
    return ideas_of(songs).withColumn("value", F.round("value", 4))


def normalised(features_: DataFrame) -> DataFrame:
    """(track, u, kind, k, v) of (track, u, t, c): each value k of both kinds of feature, comparable over the units of a track.

    chroma (c) is divided by its sum, less the track's mean, and brought to length 1; timbre (t) is brought to the track's
    mean and deviation (of the population, plus 0.001) and to length 1. A unit whose values are all 0 stays at 0.
    """
    e = features_.select("track", "u", F.explode(F.array(F.struct(F.lit("chroma").alias("kind"), F.col("c").alias("x")), F.struct(F.lit("timbre").alias("kind"), F.col("t").alias("x")))).alias("e"))
    total = F.aggregate("e.x", F.lit(0.0), lambda s, v: s + v)
    share = F.when((F.col("e.kind") == "chroma") & (total != 0), total).otherwise(1.0)
    values = e.select("track", "u", "e.kind", share.alias("s"), F.posexplode("e.x").alias("k", "v")).withColumn("v", F.col("v") / F.col("s"))
    # partial sums first: a track's mean and deviation of each value
    stats = values.groupBy("track", "kind", "k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))
    z = values.join(stats, ["track", "kind", "k"]).select("track", "u", "kind", "k", ((F.col("v") - F.col("mean")) / F.when(F.col("kind") == "timbre", F.col("deviation") + 1e-3).otherwise(1.0)).alias("z"))
    length = F.sqrt(F.sum(F.col("z") * F.col("z")).over(Window.partitionBy("track", "u", "kind")))
    return z.select("track", "u", "kind", "k", (F.col("z") / F.when(length > 0, length).otherwise(1.0)).alias("v"))


@query(f"""WITH {UNITS}, e AS (SELECT track, u, 'chroma' AS kind, unnest(range(0, 12)) AS k, unnest(c) / CASE WHEN list_sum(c) <> 0 THEN list_sum(c) ELSE 1 END AS v FROM units UNION ALL SELECT track, u, 'timbre', unnest(range(0, 24)), unnest(t) FROM units),
z AS (SELECT track, u, kind, k, (v - avg(v) OVER w) / CASE kind WHEN 'timbre' THEN stddev_pop(v) OVER w + 1e-3 ELSE 1 END AS z FROM e WINDOW w AS (PARTITION BY track, kind, k)), n AS (SELECT *, sqrt(sum(z * z) OVER (PARTITION BY track, u, kind)) AS n FROM z)
SELECT track, u, kind, CAST(k AS INTEGER) AS k, round(z / CASE WHEN n > 0 THEN n ELSE 1 END, 5) + 0.0 AS v FROM n""")
def normalised_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(units(spark, sf_dir)).select("track", "u", "kind", "k", r(F.col("v"), 5).alias("v"))


_FORMS = ["'song_(Vocals)_' || n", "'mix (No Vocals) ' || n || '.wav'", "'bass.' || n", "'(accompaniment)'", "n || '_take.flac'"]
_ALIAS_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STEM_ALIASES.items())


@query(f"""WITH f AS (SELECT page_id, CASE page_id % 5 {' '.join(f'WHEN {k} THEN {f}' for k, f in enumerate(_FORMS))} END AS name FROM (SELECT page_id, regexp_extract(url, '[^/?]*[?]|[^/]*$') AS n FROM pages)),
w AS (SELECT page_id, name, lower(trim(CASE WHEN regexp_matches(name, '[(][^)]+[)]') THEN regexp_extract(name, '[(]([^)]+)[)]', 1) ELSE regexp_replace(name, '(.)[.][^.]*$', '\\1') END, ' ')) AS w FROM f),
a AS (SELECT page_id, name, CASE w {_ALIAS_SQL} ELSE w END AS w FROM w)
SELECT page_id, name, CASE WHEN w IN ({', '.join(f"'{s}'" for s in STEMS)}) THEN w ELSE coalesce(nullif(regexp_replace(regexp_replace(w, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'stem') END AS stem FROM a""")
def stem_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of separated files whose names are made of the last part of each url."""
    n = F.regexp_extract("url", "[^/?]*[?]|[^/]*$", 0)
    forms = [F.concat(F.lit("song_(Vocals)_"), n), F.concat(F.lit("mix (No Vocals) "), n, F.lit(".wav")), F.concat(F.lit("bass."), n), F.lit("(accompaniment)"), F.concat(n, F.lit("_take.flac"))]
    name = F.coalesce(*[F.when(F.col("page_id") % len(forms) == k, f) for k, f in enumerate(forms)])
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name")).withColumn("stem", stem_of(F.col("name")))
