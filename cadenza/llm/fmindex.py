"""An FM-index over word ids with numpy: suffix sorting, a wavelet matrix, backward search and sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Order of the suffixes of x (ids from 0; each separator must be an id of its own). Prefix doubling, after a
    first sort by three ids; later rounds sort only suffixes that are still tied."""
    n = len(x)
    width = int(x.max()) + 2 if n else 2
    triple = 3 * (width - 1).bit_length() <= 62
    key = x.astype(np.int64) + 1
    if triple:
        nxt = np.append(key[1:], 0)
        key = (key * width + nxt) * width + np.append(nxt[1:], 0)
    sa = np.argsort(key)
    step = 3 if triple else 1
    new = np.empty(n, bool)
    new[:1] = True
    sorted_key = key[sa]
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the first place of each group of ties
    rank = np.empty(n, np.int64)
    rank[sa] = first
    last = np.append(new[1:], True)
    open_at = np.flatnonzero(~(new & last))
    while len(open_at):
        at = sa[open_at]
        further = at + step
        second = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        group = rank[at]
        order = np.lexsort((second, group))
        at, second, group = at[order], second[order], group[order]
        sa[open_at] = at
        fresh = np.empty(len(at), bool)
        fresh[:1] = True
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        rank[at] = np.maximum.accumulate(np.where(fresh, open_at, 0))
        alone = fresh & np.append(fresh[1:], True)
        open_at = open_at[~alone]
        step *= 2
    return sa


class FMIndex:
    """Index of a list of texts of word hashes, given as one array and the texts' n + 1 offsets.

    Separators stand after each text and are no part of any pattern. Row r of the index is the r-th smallest
    suffix. Positions that are multiples of `sample`, and each text's first, are kept for locate().
    """

    def __init__(self, words: np.ndarray, rows: np.ndarray, sample: int = 8):
        n_texts = len(rows) - 1
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        row = np.repeat(np.arange(n_texts), np.diff(rows))
        place = np.arange(len(words)) + row
        n = len(words) + n_texts
        text = np.empty(n, np.int64)
        ends = rows[1:] + np.arange(n_texts)
        text[ends] = np.arange(n_texts)
        text[place] = ids + n_texts
        sa = suffix_array(text)
        symbol = np.zeros(n, np.int64)  # 0 for separators, 1 for the first word
        symbol[place] = ids + 1
        before = symbol[sa - 1]  # the separator at the end stands before the first text
        self.n = n
        self.starts = np.concatenate([[0, n_texts], n_texts + np.cumsum(np.bincount(ids, minlength=len(self.vocabulary)))])
        # wavelet matrix: per bit, from the highest, the ones up to each place and the number of zeros
        self.levels = []
        at = before
        for bit in reversed(range(int(len(self.vocabulary)).bit_length())):
            b = (at >> bit) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.levels.append((bit, ones, n - int(ones[-1])))
            set_ = b.astype(bool)
            at = np.concatenate([at[~set_], at[set_]])
        head = np.concatenate([[0], ends[:-1] + 1])
        keep = np.zeros(n, bool)
        keep[::sample] = True
        keep[head[head < n]] = True
        kept = keep[sa]
        self.sampled = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
        self.is_sampled = kept
        self.samples = sa[kept]
        self.ends = ends

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first i symbols before suffixes."""
        lo, hi = np.zeros(len(i), np.int64), i.astype(np.int64)
        for bit, ones, zeros in self.levels:
            up = ((symbol >> bit) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return hi - lo

    def step_back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one place earlier. Not for a text's first suffix."""
        symbol, i = np.zeros(len(row), np.int64), row.astype(np.int64)
        lo = np.zeros(len(row), np.int64)
        for _, ones, zeros in self.levels:
            up = ones[i + 1] > ones[i]
            symbol = symbol * 2 + up
            a, b = ones[lo], ones[i]
            lo, i = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, i - b)
        return self.starts[symbol] + (i - lo)

    def search(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each pattern: `lengths` hashes of words from `starts` on."""
        n = len(starts)
        lo, hi = np.zeros(n, np.int64), np.where(lengths > 0, self.n, 0).astype(np.int64)
        if not len(self.vocabulary):
            return lo, lo.copy()
        for k in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((k < lengths) & (lo < hi))
            word = words[starts[live] + lengths[live] - 1 - k]
            found = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
            known = self.vocabulary[found] == word
            hi[live[~known]] = lo[live[~known]]
            live, symbol = live[known], found[known] + 1
            base = self.starts[symbol]
            lo[live], hi[live] = base + self.rank(symbol, lo[live]), base + self.rank(symbol, hi[live])
        return lo, hi

    def locate(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and word place in it of each row, by steps back to a sampled position."""
        at, back = row.astype(np.int64).copy(), np.zeros(len(row), np.int64)
        live = np.flatnonzero(~self.is_sampled[at])
        while len(live):
            at[live] = self.step_back(at[live])
            back[live] += 1
            live = live[~self.is_sampled[at[live]]]
        place = self.samples[self.sampled[at]] + back
        text = np.searchsorted(self.ends, place)
        return text, place - np.where(text > 0, self.ends[text - 1] + 1, 0)
