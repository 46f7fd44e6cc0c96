"""The registered engines over the given tables, their status, and one row of features a song."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engines import Engine, start, status, tables
from ..operators.levels import report
from ..sources.dimensions import KEYS
from ..sources.tables import samples_of, table, waves_of
from . import melody, structure
from .signals import REPORT_BLOCK, REPORT_LIMIT
from .song import FS
from .timeline import r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def features(own: DataFrame, sections: DataFrame, hooks: DataFrame) -> DataFrame:
    """One row a song: length, level, key, form, landmarks, hook and clips. Every part is one row a song, joined once."""
    whole = own.groupBy("track").agg((F.count(F.lit(1)) * structure.UNIT_SEC).alias("seconds"), r(F.avg("level")).alias("level"), r(F.stddev_pop("level")).alias("level_spread"), *[F.sum(F.get("chroma", F.lit(k))).alias(f"p{k}") for k in range(12)])
    keys = melody.keys_of_chroma(whole.select("track", F.array(*[f"p{k}" for k in range(12)]).alias("v")))
    names = F.array(*map(F.lit, KEYS))
    key = keys.select("track", F.concat(F.element_at(names, F.col("tonic") + 1), F.lit(" "), F.col("mode")).alias("key"))
    line = F.array_sort(F.collect_list(F.struct("run", "label", "kind")))
    form = sections.groupBy("track").agg(
        F.array_join(F.transform(line, lambda s: s.label), "").alias("form"), F.count_if(F.col("kind") == "chorus").alias("n_choruses"),
        r(F.sum(F.when(F.col("kind") == "chorus", F.col("end") - F.col("start")).otherwise(0)) / F.sum(F.col("end") - F.col("start"))).alias("chorus_share"),
    )
    marks = structure.landmarks(own, sections, hooks, structure.UNIT_SEC).withColumns({c: r(F.col(c)) for c in ("lift", "repetition", "confidence")})
    starts = structure.clip_rows(own, sections, hooks).groupBy("track").agg(*[F.max(F.when(F.col("kind") == k, F.col("start") * structure.PER_BAR * structure.UNIT_SEC)).alias(f"{k}_at") for k in ("clip", "micro")])
    out = whole.drop(*[f"p{k}" for k in range(12)])
    for part in (key, form, marks, starts):
        out = out.join(part, "track", "left")
    return out


_VECTORS = ("vec_id", "embedding")
ENGINES = {
    e.name: e
    for e in (
        Engine("features", {"embeddings": _VECTORS}, lambda spark, t: structure.of_units(features, structure.units_of(t["embeddings"]))),
        Engine("structure", {"embeddings": _VECTORS}, lambda spark, t: structure.of_units(structure.section_rows, structure.units_of(t["embeddings"]))),
        Engine("clips", {"embeddings": _VECTORS}, lambda spark, t: structure.of_units(structure.clip_rows, structure.units_of(t["embeddings"]))),
        Engine("loudness", {"lineitem": ("l_suppkey", "l_quantity", "l_discount")}, lambda spark, t: report(waves_of(t["lineitem"]), FS, REPORT_BLOCK, REPORT_LIMIT)),
        Engine("melody", {"events": ("user_id", "ts", "event_id", "value")}, lambda spark, t: _melody(t["events"], t.get("customer")), {"customer": ("c_custkey", "c_name")}),
        Engine("lyrics", {"lyrics": ("song", "text")}, lambda spark, t: t["lyrics"]),
    )
}


def _melody(events: DataFrame, customers: DataFrame | None) -> DataFrame:
    """Next notes of every user; with the optional customers, of those whom it names too."""
    notes = melody.notes_of_events(samples_of(events))
    found = melody.next_notes(notes, melody.keys_of(notes))
    return found if customers is None else found.join(customers.select(F.col("c_custkey").alias("track"), F.col("c_name").alias("name")), "track", "left")


@query("""SELECT name, available, detail, n_rows FROM (VALUES ('features', true, 'ready', (SELECT count(*) FROM embeddings)), ('structure', true, 'ready', (SELECT count(*) FROM embeddings)), ('clips', true, 'ready', (SELECT count(*) FROM embeddings)),
 ('loudness', true, 'ready', (SELECT count(*) FROM lineitem)), ('melody', true, 'with customer', (SELECT count(*) FROM events)), ('lyrics', false, 'lacks lyrics', 0)) AS v(name, available, detail, n_rows)""")
def engine_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which engines can run on the folder's tables, why others can't, and how many rows their inputs have."""
    names = sorted({n for e in ENGINES.values() for n in (*e.inputs, *dict(e.optional))})
    given = tables(spark, sf_dir, names)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in given.items()]
    told = [(e.name, s.available, s.detail, name) for e in ENGINES.values() for s in (status(e, given),) for name in e.inputs]
    rows = spark.createDataFrame(told, "name string, available boolean, detail string, `table` string")
    both = counts[0]
    for c in counts[1:]:
        both = both.unionByName(c)
    return rows.join(both, "table", "left").groupBy("name", "available", "detail").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


@query()
def song_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return start(ENGINES["features"], spark, {"embeddings": table(spark, sf_dir, "embeddings")})
