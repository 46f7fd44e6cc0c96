"""Exact top-k search by integer inner product in three phases with a uniform threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Products that a task holds at once.
BLOCK_PRODUCTS = 1 << 21


def scaled(column: pa.ChunkedArray | pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of a list column as a matrix, short rows padded with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles, in which products of integers are exact below 2**53, else as 64-bit integers."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    return (q, x) if top < 2**53 else (q.astype(np.int64), x.astype(np.int64))


class Queries:
    """A block of queries: ids in order and scaled vectors, and once known the cutoffs."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, cuts: np.ndarray | None = None):
        self.ids, self.q, self.cuts = ids, q, cuts


def _column(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.int64))


def _products(batches: Iterator[pa.RecordBatch], own: Queries, scale: int, at: slice) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """(vec_ids, slice of the queries, partial scores queries x rows) of one list, in blocks of bounded size."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            b = batch.slice(start, 1024)
            ids = b.column(0).to_numpy()
            q, x = exact(own.q[:, at], scaled(b.column(1), scale, at.stop - at.start))
            step = max(1, BLOCK_PRODUCTS // max(1, len(ids)))
            for a in range(0, len(q), step):
                part = slice(a, min(a + step, len(q)))
                yield ids, part, (q[part] @ x.T).astype(np.int64)


def _first(queries, scale: int, at: slice, number: int, k: int) -> Callable:
    """Phase 1 of one list: the k best partial scores of each query among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        low = np.iinfo(np.int64).min
        best, who = np.full((len(own.ids), k), low), np.zeros((len(own.ids), k), np.int64)
        for ids, part, p in _products(batches, own, scale, at):
            p[own.ids[part][:, None] == ids[None, :]] = low
            # of most blocks nothing is better than what is known
            some = np.flatnonzero(p.max(1) > best[part].min(1))
            if not len(some):
                continue
            rows = some + part.start
            n = min(k, len(ids))
            top = np.argpartition(p[some], len(ids) - n, axis=1)[:, len(ids) - n :]
            both = np.concatenate([best[rows], np.take_along_axis(p[some], top, 1)], 1)
            ids_both = np.concatenate([who[rows], ids[top]], 1)
            keep = np.argpartition(both, n, axis=1)[:, n:]
            best[rows], who[rows] = np.take_along_axis(both, keep, 1), np.take_along_axis(ids_both, keep, 1)
        q, j = np.nonzero(best > low)
        yield pa.RecordBatch.from_arrays([_column(own.ids[q]), _column(who[q, j]), _column(best[q, j]), _column(np.full(len(q), number))], names=["query_id", "vec_id", "part", "list"])

    return run


def _second(queries, scale: int, at: slice, number: int, lists: int) -> Callable:
    """Phase 2 of one list: the entries at or above the uniform threshold, cutoff / lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        least = -(-own.cuts // lists)
        for ids, part, p in _products(batches, own, scale, at):
            enough = (p >= least[part][:, None]) & (own.ids[part][:, None] != ids[None, :])
            q, j = np.nonzero(enough)
            if len(q):
                yield pa.RecordBatch.from_arrays([_column(own.ids[part][q]), _column(ids[j]), _column(p[q, j]), _column(np.full(len(q), number))], names=["query_id", "vec_id", "part", "list"])

    return run


def _third(queries, scale: int, where: list[slice]) -> Callable:
    """The exact scores of rows (vec_id, embedding, hits): known parts are summed, lists that sent none are computed.
    Scores below the cutoff, where there is one, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        n = len(own.ids)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                b = batch.slice(start, 256)
                x = scaled(b.column(1), scale, own.q.shape[1])
                hits = b.column(2)
                query, part, list_ = (pc.struct_field(hits.flatten(), k).to_numpy() for k in range(3))
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(hits).to_numpy())
                pairs, at = np.unique(row * n + np.searchsorted(own.ids, query), return_inverse=True)
                total, sent = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
                np.add.at(total, at, part)
                np.bitwise_or.at(sent, at, np.left_shift(1, list_))
                row, query = np.divmod(pairs, n)
                q, x = exact(own.q, x)
                for number, stretch in enumerate(where):
                    rest = np.flatnonzero((sent >> number) & 1 == 0)
                    total[rest] += (q[query[rest], stretch] * x[row[rest], stretch]).sum(1).astype(np.int64)
                good = slice(None) if own.cuts is None else np.flatnonzero(total >= own.cuts[query])
                yield pa.RecordBatch.from_arrays([_column(own.ids[query[good]]), _column(b.column(0).to_numpy()[row[good]]), _column(total[good])], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, is_query: Column) -> DataFrame:
    """vec_id, embedding, _q of the rows that take part."""
    own = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("_q"))
    own = own.where(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return own.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("_q").alias("_q"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, lists: int = 2, block_bytes: int = 8 << 20, counts: list[dict] | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows by inner product of floor(scale * x).

    The components are cut into `lists` stretches; the products of a query with one stretch of all rows are one
    score list, and each list has tasks of its own, which see no other stretch. Queries (the rows where is_query
    holds) go by blocks of about block_bytes, dealt by hash: a block is broadcast and destroyed before the next
    one, and the rows stay where they are. For each block:
    Phase 1 gathers the k best entries of every list, completes the scores of these few rows, and takes the k-th
    best of them as the query's cutoff, which is safe: k rows at least reach it. Phase 2 broadcasts the cutoffs.
    A row whose scores sum to the cutoff has a list with cutoff / lists or more (whatever the signs), so each list
    sends just its entries above that uniform threshold. They are gathered by row. Phase 3 computes the lists that
    did not send a row, of these rows only, and the k best remain. Products of the lists are computed in phase 1 and again in
    phase 2, as kept lists would hold an entry for each row and query.

    A row is no candidate for its own vec_id. Null vec_ids, null vectors and vectors with a null or non-finite
    component take no part; of rows that repeat a vec_id the one with the smallest vector does; shorter vectors
    are padded with zeros; a query with fewer candidates gets them all; ties go to the smaller vec_id; of rows
    with equal vectors only the k + 1 of smallest vec_id can be among any k best, so only they are searched (a
    frequent vector costs no more than a rare one); empty tables give no rows. counts, where given, gets for each
    block the pairs of phase 1, the entries of phase 2 and the pairs completed in phase 3.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, is_query))
    n_queries, width = rows.agg(F.coalesce(F.sum(F.col("_q").cast("int")), F.lit(0)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    n_blocks = max(1, -(-n_queries * max(1, width) * 8 // block_bytes))
    alike = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    stock = written(rows.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k + 1).select("vec_id", "embedding"))
    edge = np.linspace(0, width, min(lists, max(1, width)) + 1).astype(int).tolist()
    where = [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    m = len(where)
    stretch = lambda at: stock.select("vec_id", F.slice("embedding", at.start + 1, at.stop - at.start).alias("part"))
    every = lambda task, schema: reduce(DataFrame.unionByName, [stretch(at).mapInArrow(task(at, number), schema) for number, at in enumerate(where)])
    found = "query_id long, vec_id long, score long"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def complete(entries: DataFrame, queries, n: int) -> DataFrame:
        # a row of some 256 queries' entries for one vector, so that its components move once and not for every query
        part = F.pmod(F.xxhash64("query_id"), F.lit(-(-n // 256)))
        hits = entries.groupBy("vec_id", part.alias("_p")).agg(F.collect_list(F.struct("query_id", "part", "list")).alias("hits"))
        return hits.join(stock, "vec_id").select("vec_id", "embedding", "hits").mapInArrow(_third(queries, scale, where), found)

    done = []
    for block in range(n_blocks):
        mine = rows.where("_q").where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block).select("vec_id", "embedding").toArrow().sort_by("vec_id")
        ids, q = mine.column("vec_id").to_numpy(), scaled(mine.column("embedding"), scale, width)
        if not len(ids):
            continue
        queries = spark.sparkContext.broadcast(Queries(ids, q))
        entry = "query_id long, vec_id long, part long, list long"
        line = Window.partitionBy("query_id", "list").orderBy(F.desc("part"))
        first = every(lambda at, number, queries=queries: _first(queries, scale, at, number, k), entry)
        first = first.withColumn("_r", F.row_number().over(line)).where(F.col("_r") <= k)
        known = written(complete(first, queries, len(ids)))
        top = known.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
        cuts = np.full(len(ids), -(2**56))  # with fewer than k candidates every entry is sent
        for r in top.where(F.col("n") >= k).collect():
            cuts[np.searchsorted(ids, r.query_id)] = r.low
        queries.destroy()

        queries = spark.sparkContext.broadcast(Queries(ids, q, cuts))
        entries = every(lambda at, number, queries=queries: _second(queries, scale, at, number, m), entry)
        if counts is not None:
            entries = written(entries)
        final = complete(entries, queries, len(ids)).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
        done.append(written(final.select("query_id", F.col("_r").alias("rank"), "vec_id", "score")))
        if counts is not None:
            counts.append({"queries": len(ids), "rows": stock.count(), "first": known.count(), "entries": entries.count(), "completed": entries.select("query_id", "vec_id").distinct().count()})
        queries.destroy()
        dropped(known)
    dropped(rows)
    dropped(stock)
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, done)
