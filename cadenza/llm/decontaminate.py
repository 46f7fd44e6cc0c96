"""Benchmark decontamination: an FM-index per shard of training text, searched for all test windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mapped, written
from .fmindex import FMIndex
from .textops import gram_hashes, slices, text_bytes, word_hashes

FOUND = "n_words long, n_hit long, item_ids array<long>, spans array<struct<start:long,end:long>>, clean_text string"
ADDED = ["n_words", "n_hit", "item_ids", "spans", "clean_text"]


class Windows:
    """The distinct windows of some benchmark items: places in one array of word hashes, lengths, and each window's items."""

    def __init__(self, item_ids: list[int], texts: list[str], width: int):
        self.words, _, _, rows = word_hashes(pa.array(texts, pa.string()))
        hashes, item = gram_hashes(self.words, rows, width)
        count = np.diff(rows)
        per_item = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
        first = np.repeat(rows[:-1], per_item) + np.arange(len(item)) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        _, at, window = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts = first[at]
        self.lengths = np.minimum(rows[1:][item[at]] - self.starts, width)
        pairs = np.unique(np.column_stack([window.reshape(-1), np.array(item_ids, np.int64)[item]]), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.items = pairs[:, 1]
        self.item_rows = np.searchsorted(pairs[:, 0], np.arange(len(at) + 1))


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... (n[k] of them) for each k, one after the other."""
    return np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _loaded(part: Broadcast[Windows], alone: bool) -> Windows:
    """A part's windows; of several parts a task keeps one at a time."""
    value = part.value
    if not alone:
        vars(part).pop("_value", None)
    return value


def _found(column: pa.Array, parts: list[Broadcast[Windows]], sample: int) -> list[pa.Array]:
    """The ADDED columns of one shard: one index, in which the windows of all parts are looked up."""
    words, starts, ends, rows = word_hashes(column)
    n = len(column)
    hit = np.zeros(len(words) + 1, np.int64)
    pairs = np.empty((0, 2), np.int64)
    index = FMIndex(words, rows, sample) if len(words) and parts else None
    for part in parts if index else ():
        windows = _loaded(part, len(parts) == 1)
        lo, hi = index.search(windows.words, windows.starts, windows.lengths)
        occurs = hi - lo
        window = np.repeat(np.arange(len(lo)), occurs)
        row, place = index.locate(_runs(lo, occurs))
        begin = rows[row] + place
        np.add.at(hit, begin, 1)
        np.add.at(hit, begin + windows.lengths[window], -1)
        # a window counts once in a row, however often it occurs there, before its items are looked up
        row, window = np.divmod(np.unique(row * len(lo) + window), len(lo)) if len(window) else (row, window)
        n_items = np.diff(windows.item_rows)[window]
        more = np.column_stack([np.repeat(row, n_items), windows.items[_runs(windows.item_rows[window], n_items)]])
        pairs = np.unique(np.concatenate([pairs, more]), axis=0)
    pair_row, pair_item = pairs[:, 0], pairs[:, 1]
    hit = np.cumsum(hit)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    # merged spans of hit words inside a row, in code points
    left, right = np.zeros(len(hit), bool), np.zeros(len(hit), bool)
    left[1:], right[:-1] = hit[:-1], hit[1:]
    full = rows[:-1] < rows[1:]
    left[rows[:-1][full]] = False
    right[rows[1:][full] - 1] = False
    first, last = np.flatnonzero(hit & ~left), np.flatnonzero(hit & ~right)
    span_rows = np.searchsorted(first, rows)
    data, offsets = text_bytes(column)
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    row_of = np.repeat(np.arange(n), np.diff(span_rows))
    base = point[offsets[:-1][row_of]]
    spans = pa.StructArray.from_arrays([pa.array(point[starts[first]] - base, pa.int64()), pa.array(point[ends[last]] - base, pa.int64())], ["start", "end"])
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, starts[first], 1)
    np.add.at(edge, ends[last], -1)
    stay = np.cumsum(edge)[:-1] == 0
    clean_offsets = np.concatenate([[0], np.cumsum(stay)])[offsets].astype(np.int32)
    clean = pa.StringArray.from_buffers(n, pa.py_buffer(clean_offsets), pa.py_buffer(np.ascontiguousarray(data[stay])))
    if column.null_count:
        clean = pc.if_else(pc.is_null(column), pa.scalar(None, pa.string()), clean)
    span_offsets = pa.array(span_rows.astype(np.int32))
    item_offsets = np.searchsorted(pair_row, np.arange(n + 1)).astype(np.int32)
    return [
        pa.array(np.diff(rows), pa.int64()),
        pa.array(total[rows[1:]] - total[rows[:-1]], pa.int64()),
        pa.ListArray.from_arrays(pa.array(item_offsets), pa.array(pair_item, pa.int64())),
        pa.ListArray.from_arrays(span_offsets, spans),
        clean,
    ]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_bytes: int = 2 << 20, sample: int = 8, part_bytes: int = 4 << 20) -> DataFrame:
    """docs' columns with n_words, n_hit, item_ids, spans and clean_text added.

    Texts are lower-cased (A-Z) and cut into words; a window is `width` consecutive words of a benchmark item,
    or the whole item where it is shorter. Each run of about shard_bytes of whole documents is a training shard
    with an FM-index of its own: all windows are looked up by backward search through wavelet-tree ranks, their
    occurrences located by sampled suffix positions and merged into removal spans (code point offsets from the
    first to behind the last hit word). clean_text is the text without them; item_ids are the items that occur.
    Words are compared by 64-bit hashes.

    A null text has no words and stays null; an empty or wordless text has no spans; null items, items without
    words and items with null item_id take no part; items that repeat or share windows are all reported; docs'
    own columns of the added names are replaced; empty tables give no rows or no hits.

    The benchmark, a bounded collection of tests, is broadcast in parts: items are dealt by hash so that a part has
    about part_bytes of text, which the driver reads, hashes and lets go before the next. A part takes some five
    times its text. A task builds a shard's index once and looks the parts up in it one after the other, so neither
    the driver nor a task ever holds more than one of them; the parts lie on the executors' disks.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = -(-size // part_bytes)
    docs = docs.drop(*ADDED)
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n_parts))))
    if n_parts > 1:  # lies in order of its parts, so that each is read alone
        dealt = written(dealt.repartitionByRange("part").sortWithinPartitions("part"))
    parts = []
    for k in range(n_parts):
        rows = dealt.where(F.col("part") == k).collect()
        parts.append(docs.sparkSession.sparkContext.broadcast(Windows([r.item_id for r in rows], [r.text for r in rows], width)))

    def run(text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in slices(batch, text, shard_bytes):
                yield pa.RecordBatch.from_arrays([*shard.columns, *_found(shard.column(text), parts, sample)], names=[*shard.schema.names, *ADDED])

    return mapped(docs, run, **{f.name: f.dataType for f in StructType.fromDDL(FOUND)})
