"""Best-two-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import copies, ranked, written
from .textops import ASCII_ALNUM, ASCII_SIGN, LOWERED, NOT_SPACE, run_hashes, runs, slices, text_bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Parts of text that a task keeps the ids of, and how many new ones are tokenised at once (an encoding takes about 1 kB).
CACHE_PARTS, ENCODE_PARTS = 1_000_000, 4_096


class WordTokens:
    """ids of texts by way of their parts between white space, each tokenised once and kept.

    Exact for tokenizers like word_bpe_49k, which lower-case, drop white space, never join across it and never
    join letters or digits with other signs. Parts are also cut between an ASCII letter or digit and an ASCII
    sign other than the apostrophe (contractions keep theirs), and ASCII case is folded, unless a text holds
    `<|`, with which special tokens begin. The store is emptied beyond CACHE_PARTS, which costs time only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.first, self.n = np.empty(0, np.int64), np.empty(0, np.int32)

    def _add(self, hashes: np.ndarray, parts: list[str]) -> None:
        sizes, found = [], []
        for at in range(0, len(parts), ENCODE_PARTS):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts[at : at + ENCODE_PARTS], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            found.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))
        n, flat = np.concatenate(sizes), np.concatenate(found)
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.known, hashes)
        self.slot = np.insert(self.slot, at, np.arange(len(n), dtype=np.int32) + len(self.n))
        self.known = np.insert(self.known, at, hashes)
        self.first = np.concatenate([self.first, self.used + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n.astype(np.int32)])
        self.used += len(flat)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, each row ended by id 0, and the rows' n + 1 offsets among them."""
        data, offsets = text_bytes(column)
        begins = None
        if not ((data[:-1] == ord("<")) & (data[1:] == ord("|"))).any():
            data = LOWERED[data]
            alnum, sign = ASCII_ALNUM[data], ASCII_SIGN[data]
            begins = np.zeros(len(data), bool)
            begins[1:] = (alnum[:-1] & sign[1:]) | (sign[:-1] & alnum[1:])
        starts, ends, rows = runs(data, offsets, NOT_SPACE, begins)
        values, at, inverse = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_PARTS:
            self.clear()
        place = np.searchsorted(self.known, values)
        new = np.ones(len(values), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != values[inside]
        if new.any():
            raw = data.tobytes()
            self._add(values[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        slot = self.slot[np.searchsorted(self.known, values)][inverse]
        n = self.n[slot].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(n)])
        per_row = before[rows[1:]] - before[rows[:-1]] + 1
        out_rows = np.concatenate([[0], np.cumsum(per_row)])
        out = np.zeros(int(out_rows[-1]), np.uint32)
        row_of = np.repeat(np.arange(len(per_row)), np.diff(rows))
        spot = np.arange(int(n.sum()))
        out[spot + np.repeat(row_of, n)] = self.ids[spot + np.repeat(self.first[slot] - before[:-1], n)]
        return out, out_rows


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, slice_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, piece, start, length and crc32 of the ids (little-endian uint32) of every piece of every document.

    A document is its ids and a 0. One of over `length` ids is cut every `length` ids; others are one piece. A
    null or empty text is the single id 0; repeated rows and null doc_ids give pieces of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                ids, rows = tokens(part.column("text"))
                n = np.diff(rows)
                pieces = -(-n // length)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = rows[:-1][row] + piece * length
                size = np.minimum(first + length, rows[1:][row]) - first
                little = memoryview(ids.astype("<u4").view(np.uint8))
                crc = [zlib.crc32(little[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(piece * length, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Packs counts[size] pieces of each size; pieces of one size are alike, so whole runs of equal bins are made at once.

    A bin opens with the largest piece left and is filled greedily with the largest that fits. Then its smallest
    piece is given back for two unpacked ones that fit the gap so widened more tightly, until no pair does. As
    many such bins are made as the counts allow, so the work depends on the number of sizes, not of pieces.
    Returns rows (size, from, to, first sequence, bins, offset): pieces `from` to `to` of that size, counted
    from 0, go `bins` at a time to the sequences from `first` on, the k-th such layer at offset + k * size.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    taken = np.zeros(capacity + 1, np.int64)
    sizes = np.arange(capacity + 1)
    out, sequence = [], 0
    while left.any():
        use: dict[int, int] = {}
        fit = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the largest size left up to each size

        def take(size: int, n: int = 1, use=use, fit=fit) -> None:
            use[size] = use.get(size, 0) + n
            if not use[size]:
                del use[size]
            if n < 0 or use.get(size, 0) == left[size]:
                free = np.where(left > 0, sizes, 0)
                for k, u in use.items():
                    if u == left[k]:
                        free[k] = 0
                fit[:] = np.maximum.accumulate(free)

        def fill(gap: int, use=use, fit=fit) -> int:
            while gap and (best := int(fit[gap])):
                n = min(gap // best, int(left[best]) - use.get(best, 0))
                take(best, n)
                gap -= n * best
            return gap

        gap = fill(capacity)
        while gap and len(use) and sum(use.values()) > 1:
            small = min(use)
            wide = gap + small
            one = sizes[1:wide]
            free = np.array([fit[k] == k and k > 0 for k in one]) if wide < 64 else fit[one] == one
            two = fit[wide - one]
            single = np.zeros(capacity + 1, bool)
            for k in np.flatnonzero(left == 1):
                single[k] = True
            for k, u in use.items():
                single[k] = left[k] - u == 1
            both = np.where(free & (two > 0) & ~((two == one) & single[one]), one + two, 0)
            if not len(both) or both.max() <= small:
                break
            x = int(one[both.argmax()])
            y = int(two[both.argmax()])
            take(small, -1)
            take(x)
            take(y)
            gap = fill(wide - x - y)
        bins = min(int(left[k]) // u for k, u in use.items())
        offset = 0
        for size, u in sorted(use.items(), reverse=True):
            out.append((size, int(taken[size]), int(taken[size]) + u * bins, sequence, bins, offset))
            taken[size] += u * bins
            left[size] -= u * bins
            offset += u * size
        sequence += bins
    return out


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, n_buckets: int = 256) -> DataFrame:
    """Every piece of every document (see token_pieces) with its sequence_id and offset in that sequence.

    Only the counts of pieces by size, at most `length` numbers, come to the driver, where best_two_fit plans
    the bins. Pieces are ranked inside their size, in hash buckets so that a frequent size (a third of all rows
    may be copies) is spread over tasks, and find their bin by that rank. An empty table gives no rows.
    """
    pieces = written(token_pieces(docs, tokenizer_path, length))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = sorted(best_two_fit(counts, length))
    keys = np.array([(p[0] << 44) + p[1] for p in plan], np.int64)
    first, bins, offset, begin = (np.array([p[k] for p in plan], np.int64) for k in (3, 4, 5, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, (size << 44) + rank, side="right") - 1
            k = rank - begin[at]
            found = [pa.array(first[at] + k % bins[at], pa.int64()), pa.array(offset[at] + k // bins[at] * size, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *found], names=[*b.schema.names[:5], "sequence_id", "offset"])

    order = [F.col(c) for c in ("_h", "doc_id", "piece", "ids_crc32")]
    # equal pieces are told apart by their number, or those of null doc_ids would fall into one bucket
    spread = copies(pieces, "copy").withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32", "copy"))
    line = ranked(spread, ["length"], F.pmod(F.col("_h"), F.lit(n_buckets)), order)
    return line.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
