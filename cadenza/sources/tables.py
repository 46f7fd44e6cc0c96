"""The driver tables and the domain views over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; only a local session may do without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def passing(spark: SparkSession, kind: str) -> str:
    """A new place in the shared folder that goes when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, so that it is computed once."""
    path = passing(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(table(spark, sf_dir, "events"))


def samples_of(events: DataFrame) -> DataFrame:
    """Events as a signal per user: (track, i, x, ts, event_id, event_type), i from 0 in time order."""
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("track"), (F.row_number().over(line) - 1).cast("long").alias("i"), F.col("value").alias("x"), "ts", "event_id", "event_type"
    )


SAMPLES = """samples AS (SELECT user_id AS track, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i,
 value AS x, ts, event_id, event_type FROM events)"""


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves_of(table(spark, sf_dir, "lineitem"))


def waves_of(items: DataFrame) -> DataFrame:
    """Line items as a stereo signal per supplier: (track, i, l, r), i from 0 by order and line; quantity on the left and
    discount on the right, both scaled to -1..1."""
    line = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return items.select(
        F.col("l_suppkey").alias("track"), (F.row_number().over(line) - 1).cast("long").alias("i"), ((F.col("l_quantity") - 25.5) / 24.5).alias("l"), (20 * F.col("l_discount") - 1).alias("r")
    )


WAVES = """waves AS (SELECT l_suppkey AS track, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS i,
 (l_quantity - 25.5) / 24.5 AS l, 20 * l_discount - 1 AS r FROM lineitem)"""


def contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pitch points of their user (track, t, freq, clarity, rms), one each 10 ms: an event sounds for 12 points, at
    a pitch that follows its value, and 8 points of silence follow."""
    pitch = 48.0003 + F.col("x") / 20.7  # no value lies half way between two notes or cents
    points = samples(spark, sf_dir).select("track", "i", pitch.alias("pitch"), F.explode(F.array(*map(F.lit, range(20)))).alias("m"))
    freq = F.when(F.col("m") < 12, 440 * F.pow(F.lit(2.0), (F.col("pitch") - 69) / 12)).otherwise(0.0)
    return points.select("track", ((F.col("i") * 20 + F.col("m")) / 100).alias("t"), freq.alias("freq"), F.lit(0.9).alias("clarity"), (0.02 + F.col("pitch") / 1000).alias("rms"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly energy per event type: (track, b, energy), b from 0 over the hours that have events."""
    hour = F.date_trunc("hour", "ts")
    by_hour = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("track"), hour.alias("hour")).agg(F.avg(F.col("value") * F.col("value")).alias("energy"))
    line = Window.partitionBy("track").orderBy("hour")
    return by_hour.select("track", (F.row_number().over(line) - 1).cast("long").alias("b"), "energy")


BLOCKS = """blocks AS (SELECT track, CAST(row_number() OVER (PARTITION BY track ORDER BY hour) - 1 AS BIGINT) AS b, energy FROM
 (SELECT event_type AS track, date_trunc('hour', ts) AS hour, avg(value * value) AS energy FROM events GROUP BY 1, 2))"""


def lyric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank trimmed lines of documents: (doc_id, pos, text), pos the place among all lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw"))
    return docs.select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim("raw").alias("text")).where(F.col("text") != "")


def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines, signs) of documents, blank lines counted too."""
    text = F.col("text")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", (breaks + 1).alias("lines"), F.length(text).alias("signs"))


LINES = r"""lines AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, text FROM (SELECT doc_id, unnest(range(0, len(l))) AS pos, trim(unnest(l), ' ') AS text
 FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS l FROM documents)) WHERE text <> '')"""
