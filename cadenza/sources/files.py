"""Catalogs and listings of songs, tables kept from one run to the next, and report files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "song string, language string"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(song, language) of CSV files with a header; of lines with the same song the smallest language counts."""
    rows = spark.read.schema(CATALOG).option("header", True).option("escape", '"').csv(path)
    return rows.where(F.col("song").isNotNull()).groupBy("song").agg(F.min("language").alias("language"))


def listing(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(song, path, length) of the files of a folder and those below it; song is the name without its ending. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", "([^/]*?)(\\.[^./]*)?$", 1)
    return files.select(name.alias("song"), "path", "length")


def with_language(songs: DataFrame, languages: DataFrame, default: str = "en") -> DataFrame:
    """songs with the catalog's language, the default where it has none. The catalog is joined by size, not by decree."""
    return songs.join(languages, "song", "left").withColumn("language", F.coalesce("language", F.lit(default)))


def kept(spark: SparkSession, path: str, made: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first if no finished one is there. path must be shared by all executors."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        made().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report(rows: DataFrame, path: str, scores: list[str]) -> DataFrame:
    """Writes a line for every row to path/rows and the count and means of `scores` to path/summary, as CSV; returns the summary."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    means = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in scores])
    means.write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    schema = ", ".join(["n long", *[f"{c} double" for c in scores]])
    return rows.sparkSession.read.schema(schema).option("header", True).csv(f"{path}/summary")
