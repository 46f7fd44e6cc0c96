"""Words and hashes of Arrow text columns with numpy, used inside tasks of mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
LOWERED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words after lower-casing A-Z: digits, a-z and all of non-ASCII.
IN_WORD = ((LOWERED >= 48) & (LOWERED <= 57)) | ((LOWERED >= 97) & (LOWERED <= 122)) | (LOWERED >= 128)
ASCII_ALNUM = IN_WORD & (_BYTES < 128)
#: ASCII signs, without the apostrophe.
ASCII_SIGN = (_BYTES > 32) & (_BYTES < 127) & ~ASCII_ALNUM & (_BYTES != 39)
NOT_SPACE = ~np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_BLOCK = 1 << 21
_factors = np.empty(0, np.uint64)


def factors(n: int) -> np.ndarray:
    """The first n of a fixed sequence of odd 64-bit factors; a longer call gives a longer prefix of the same sequence."""
    global _factors
    if len(_factors) < n:
        size = 1 << max(10, (n - 1).bit_length())
        _factors = mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _factors[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with up to max_bytes of text each (one longer row stands alone)."""
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the rows' n + 1 offsets in them; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of `inside` bytes that lies in one row, and the rows' n + 1 offsets among the runs.

    begins, where given, marks bytes that begin a new run even inside one.
    """
    m = inside[data]
    before, after = np.zeros(len(m), bool), np.zeros(len(m), bool)
    before[1:], after[:-1] = m[:-1], m[1:]
    if begins is not None:
        before &= ~begins
        after[:-1] &= ~begins[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes: a multilinear hash with fixed factors, then mixed."""
    lengths = ends - starts
    out = np.empty(len(starts), np.uint64)
    total = np.cumsum(lengths)
    f = factors(int(lengths.max()) + 1) if len(lengths) else None
    at = 0
    while at < len(starts):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + _BLOCK)))
        n = lengths[at:to]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        value = (data[inside + np.repeat(starts[at:to], n)].astype(np.uint64) + np.uint64(1)) * f[inside + 1]
        out[at:to] = np.add.reduceat(value, first) + n.astype(np.uint64) * f[0]
        at = to
    return mixed(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a text column, their byte starts and ends, and the rows' n + 1 offsets among them."""
    data, offsets = text_bytes(column)
    starts, ends, rows = runs(data, offsets, IN_WORD)
    return run_hashes(LOWERED[data], starts, ends), starts, ends, rows


def gram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams row by row, and the row of each. A row of fewer words, but not none, is one gram."""
    count = np.diff(rows)
    grams = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    row = np.repeat(np.arange(len(count)), grams)
    first = np.repeat(rows[:-1], grams) + np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
    stop = rows[1:][row]
    f = factors(n + 1)
    h = np.minimum(stop - first, n).astype(np.uint64) * f[0]
    padded = np.append(words, np.zeros(n, np.uint64))
    for k in range(n):
        h += np.where(first + k < stop, padded[first + k] * f[k + 1], np.uint64(0))
    return mixed(h), row
