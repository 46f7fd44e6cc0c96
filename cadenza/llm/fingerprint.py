"""Document fingerprints: bottom-k sketches of shingle hashes. Native: DataFrame functions only."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import NOT_WORD, numbered, repeated, written

#: Words a shingle, hashes a sketch: a resemblance J is off by sqrt(J (1 - J) / HASHES), 0.044 at most.
WORDS, HASHES = 5, 128
#: Most buckets of in_line(); their first keys, some 40 bytes each, are in every task.
BUCKETS = 1 << 16


def sketch(text: Column, words: int = WORDS, size: int = HASHES) -> Column:
    """The `size` smallest 64-bit hashes of the text's distinct shingles of `words` lower-cased words, ascending.

    A text of fewer words, but not none, is one shingle of all its words; a null text and one without words have an
    empty sketch. The sketch of a text of no more than `size` distinct shingles holds them all, so that what is
    estimated from it is exact. Texts are read whole; a text's words lie in the memory of one task.
    """
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")

    def smallest(w: Column) -> Column:
        first = F.slice(w, F.lit(1), F.when(F.size(w) < words, F.least(F.size(w), F.lit(1))).otherwise(F.size(w) - (words - 1)))
        shingles = F.transform(first, lambda a, i: F.xxhash64(a, *[F.get(w, i + k) for k in range(1, words)]))
        return F.slice(F.sort_array(F.array_distinct(shingles)), 1, size)

    return let(parts, smallest)


def said(own: Column) -> Column:
    """A sketch as a string: its hashes in hexadecimal, ascending as signed numbers."""
    return F.array_join(F.transform(own, lambda h: F.hex(h)), " ")


def merged(a: Column, b: Column, size: int = HASHES) -> Column:
    """The sketch of both inputs' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def likeness(a: Column, b: Column, size: int = HASHES) -> Column:
    """Estimated resemblance (Jaccard): the share of the merged sketch that both have. Two empty sketches are alike."""

    def share(both: Column) -> Column:
        return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))

    return let(merged(a, b, size), share)


def distinct_shingles(own: Column, size: int = HASHES) -> Column:
    """Estimated number of distinct shingles: exact below a full sketch, else from how far the largest hash stands."""
    share = (F.element_at(own, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(own) < size, F.size(own).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = HASHES) -> Column:
    """Estimated share of a's shingles that b has, from the resemblance and both counts; an empty a is contained."""
    j, n, m = likeness(a, b, size), distinct_shingles(a, size), distinct_shingles(b, size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j / (1 + j) * (n + m) / n))


def merge_sketches(df: DataFrame, by: Sequence[str], column: str = "sketch", size: int = HASHES) -> DataFrame:
    """One sketch for each group of `by` (parts of a document, documents of a source, ...), equal to the sketch of all.

    Hashes are made distinct before they are ranked, and each task keeps a group's `size` smallest before they are
    shuffled, so a group of any share moves `size` hashes a task. Groups of empty sketches only have an empty one.
    """
    ranks = Window.partitionBy(*by).orderBy("_h")
    own = df.select(*by, F.explode(column).alias("_h")).distinct()
    least = own.withColumn("_r", F.row_number().over(ranks)).where(F.col("_r") <= size)
    full = least.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(column))
    keys = df.select(*by).distinct()
    same = None
    for k in by:
        term = keys[k].eqNullSafe(full[k])
        same = term if same is None else same & term
    return keys.join(full, same, "left").select(*[keys[k] for k in by], F.coalesce(full[column], F.expr("cast(array() as array<bigint>)")).alias(column))


def in_line(docs: DataFrame, per_task: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rows of docs with a bucket b such that each row's next row by doc_id is the next of its bucket, and repeated rows.

    Rows ascend by doc_id, null first, those of one id by their text's hash, and the last is followed by the first. The
    first table, (b, guest, none, k, h, doc_id, text), is to be sorted in each bucket by guest and key (none, k, h): its
    last row is a guest, the row that follows the bucket. The second, (doc_id, text, n), has what is left out of it: rows
    of which there are so many equal ones that they would fill buckets; n of them are followed by themselves.

    Buckets are per_task for every shuffle partition, BUCKETS at most, and begin at keys that are evenly spread in the
    sorted line of all distinct keys. Only keys are sorted; the driver holds the buckets' first keys, and a row finds its
    bucket among them by halving, so that texts move once, by bucket.
    """
    spark = docs.sparkSession
    key = ["none", "k", "h"]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.select("*", F.when(F.col("doc_id").isNull(), 0).otherwise(1).cast("long").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("k"), F.xxhash64("text").alias("h"))
    line = written(numbered(own.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), [], key))
    keys, rows = line.agg(F.max("number_total"), F.sum("n")).first()
    n_buckets = min(BUCKETS, per_task * int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = -(-(keys or 1) // n_buckets)
    first = [tuple(r) for r in line.where(F.col("number") % size == 0).orderBy("number").select(*key).collect()]
    many = [tuple(r) for r in line.where((F.col("n") > 1) & (F.col("n") * n_buckets > (rows or 0))).select(*key, "n").collect()]
    schema = "none long, k long, h long"
    chosen = F.broadcast(spark.createDataFrame([*{*first, *(m[:3] for m in many)}], schema))
    chosen = written(own.join(chosen, key).groupBy(*key).agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text")))
    often = F.broadcast(spark.createDataFrame(many, schema + ", n long"))
    single = own.join(often.drop("n"), key, "left_anti").unionByName(chosen.join(often.drop("n"), key))
    bounds = F.from_json(F.lit(json.dumps([dict(zip(key, x, strict=True)) for x in first])), "array<struct<none: long, k: long, h: long>>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(first).bit_length()))])
    halved = lambda x: F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s) <= x, at + s).otherwise(at))
    placed = single.withColumn("b", let(F.struct(*key), halved)).withColumn("guest", F.lit(0))
    before = spark.createDataFrame([(*x, (i - 1) % len(first)) for i, x in enumerate(first)], schema + ", b int")
    guests = chosen.join(F.broadcast(before), key).withColumn("guest", F.lit(1))
    return placed.unionByName(guests), chosen.join(often, key).select("doc_id", "text", (F.col("n") - 1).alias("n"))


def edited(text: Column, head: Column) -> Column:
    """The text with its last quarter (rounded down) replaced by head, which may be shorter."""
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter(F.length(text))), head)


def quarter(chars: Column) -> Column:
    return F.floor(chars / 4).cast("int")


def fingerprints(docs: DataFrame, size: int = HASHES) -> DataFrame:
    """(doc_id, text, edited, sketch, edited_sketch, next_sketch) of every row of docs (doc_id, text).

    edited: the text's last quarter of code points replaced by the first as many of the next row's text (or all of it). See
    in_line for the order, null ids and repeated rows; a null text counts as empty, and a single row is its own next. Rows
    that repeat by the thousand are worked once and then repeated. An empty table gives no rows; other columns are not read.
    """
    placed, again = in_line(docs)
    own = sketch(F.col("text"), size=size)
    line = Window.partitionBy("b").orderBy("guest", "none", "k", "h")
    rows = placed.repartition("b").withColumn("sketch", own)
    rows = rows.withColumns({"next": F.lead("text").over(line), "next_sketch": F.lead("sketch").over(line)}).where("guest = 0")
    again = again.withColumn("sketch", own).withColumns({"next": F.col("text"), "next_sketch": F.col("sketch")})
    names = ["doc_id", "text", "edited", "sketch", "edited_sketch", "next_sketch"]

    def done(df: DataFrame) -> DataFrame:
        head = F.substring("next", F.lit(1), quarter(F.length("text")))
        return df.withColumn("edited", edited(F.col("text"), head)).withColumn("edited_sketch", sketch(F.col("edited"), size=size))

    return done(rows).select(*names).unionByName(repeated(written(done(again).select(*names, "n")), "n", "copy").select(*names))
