"""Proportional stratified interleaving into shards. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import copies, ranked


def interleaved_shards(docs: DataFrame, n_shards: int, seed: int = 17, stratum: str = "source", n_buckets: int = 4096) -> DataFrame:
    """Every row of docs once, as (doc_id, stratum, size, text_crc32, position, shard, slot).

    Rows are shuffled by a seeded hash inside each stratum and ranked; the fractional rank (rank + 1/2) / rows
    orders all strata together, so each stretch of the order holds the strata in their shares. The order is cut
    into n_shards stretches whose row counts differ by one at most (law `rows`); slot counts from 0 in a shard.

    A null text has no bytes and crc 0; a null stratum is a stratum of its own; a null doc_id is a row as any
    other; repeated rows are numbered and each get their own slot; an empty table gives no rows. n_buckets bounds what one task
    ranks: a stratum's rows are spread over that many hash buckets, whatever its share.
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(
        "doc_id",
        F.col(stratum).alias("stratum"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        crc.alias("text_crc32"),
    )
    # text and number among equal rows too, or rows of one doc_id, and equal rows, would fall into one bucket
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_crc32"), F.col("copy"))
    rows = copies(rows, "copy").withColumn("h", h)
    order = [F.col(c) for c in ("h", "doc_id", "text_crc32", "size")]
    inside = ranked(rows, ["stratum"], F.pmod(F.col("h"), F.lit(n_buckets)), order, "rank")
    share = inside.withColumn("share", (F.col("rank") + F.lit(0.5)) / F.col("rank_total"))
    bucket = F.floor(F.col("share") * n_buckets)
    line = ranked(share, [], bucket, [F.col("share"), F.col("stratum"), *order], "position")
    exact = F.expr(f"cast((position * {n_shards}L) div position_total as int)")
    first = F.expr(f"(cast(shard as long) * position_total + {n_shards - 1}L) div {n_shards}L")
    out = line.withColumn("shard", exact)
    return out.select("doc_id", "stratum", "size", "text_crc32", "position", "shard", (F.col("position") - first).alias("slot"))
