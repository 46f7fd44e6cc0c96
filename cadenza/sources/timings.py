"""Timed lyric lines as text: `start,end,text` a line, in a file of its own for each song."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normal_line, words
from ..operators.repeats import marks_of, parted, similar_bags, similar_runs
from ..sources.tables import written

#: The first two commas part the fields; the text may hold more, and quotes around it.
ROW = r'^([^,]+),([^,]+),\s*(.*?)\s*$'


def parsed(rows: DataFrame) -> DataFrame:
    """(song, start, end, text, problem) of (song, row). Quotes around a text go, doubled ones inside are one.

    problem says what is wrong: "fields" without two commas, "times" where a time is no number or the end comes before the
    start; such rows keep what could be read. A header is a row with a problem. Blank rows are left out.
    """
    bare = F.regexp_replace(F.regexp_extract("row", ROW, 3), '^"|"$', "")
    number = lambda k: F.trim(F.regexp_extract("row", ROW, k)).try_cast("double")
    fields = rows.where(F.trim("row") != "").select("song", "row", number(1).alias("start"), number(2).alias("end"), F.replace(bare, F.lit('""'), F.lit('"')).alias("text"))
    finite = F.coalesce((F.abs("start") < float("inf")) & (F.abs("end") < float("inf")) & (F.col("start") <= F.col("end")), F.lit(False))
    problem = F.when(~F.col("row").rlike(ROW), "fields").when(~finite, "times")
    return fields.select("song", "start", "end", "text", problem.alias("problem"))


def read_timings(spark: SparkSession, folder: str) -> DataFrame:
    """parsed() rows of every .csv file in a folder; a song is named by its file. Long files are split like any text."""
    files = spark.read.option("pathGlobFilter", "*.csv").text(folder)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    return parsed(files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("song"), F.col("value").alias("row")))


def labelled(lines: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(song, i, start, end, text, rep) of lines (song, start, end, text): i from 0 by time; rep where a line lies in two or
    more successive lines that come again, alike (Dice 0.75 of their words), later or before, without a line in common.

    sizes: (song, lines, signs) of the songs, which may be too high; counted here if left out.
    """
    lines = lines.select("song", "start", "end", "text")
    if sizes is None:
        sizes = lines.groupBy("song").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("signs"))
    short, rest = parted(lines, "song", sizes)
    rep = F.when(F.col("song").isNotNull(), F.col("rep")).otherwise(F.lit(False))  # songs without a name are not told apart
    rows = short.select("song", F.posexplode(F.arrays_zip("rows", marks_of(F.col("rows.text")).alias("rep"))).alias("i", "x"))
    found = rows.select("song", F.col("i").cast("long").alias("i"), "x.rows.*", F.col("x.rep").alias("rep")).withColumn("rep", rep)
    return found if rest is None else found.unionByName(_labelled_long(rest))


def _labelled_long(lines: DataFrame) -> DataFrame:
    order = Window.partitionBy("song").orderBy("start", "end", "text")
    numbered = written(lines.select("song", (F.row_number().over(order) - 1).cast("long").alias("i"), "start", "end", "text"))
    runs = similar_runs(*similar_bags(numbered.select(F.col("song").alias("doc_id"), "i", words(normal_line(F.col("text"))).alias("w")))).where("d >= 2")
    # covered stretches as steps up and down, so that a passage is not counted line by line for each of its runs
    ends = [F.struct(F.col("i").alias("i"), F.lit(1).alias("s")), F.struct((F.col("i") + F.col("n")).alias("i"), F.lit(-1).alias("s"))]
    ends += [F.struct((F.col("i") + F.col("d")).alias("i"), F.lit(1).alias("s")), F.struct((F.col("i") + F.col("d") + F.col("n")).alias("i"), F.lit(-1).alias("s"))]
    steps = runs.select(F.col("doc_id").alias("song"), F.explode(F.array(*ends)).alias("e")).groupBy("song", "e.i").agg(F.sum("e.s").alias("s"))
    depth = F.sum(F.coalesce("s", F.lit(0))).over(Window.partitionBy("song").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.join(steps.hint("merge"), ["song", "i"], "left").select("song", "i", "start", "end", "text", (depth > 0).alias("rep"))
