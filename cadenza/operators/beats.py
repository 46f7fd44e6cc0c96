"""Beats by dynamic programming over chunks: scores as a max-plus scan, the way back as a scan of jumps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import upper_median
from ..sources.tables import written
from .scan import _rows, chunks_of, laid, stepped, strips, with_states
from .windows import top


class Scores:
    """A frame's score is its strength and the best of an earlier score less what their distance costs (from half to two
    periods). State: a constant 0 and the last scores, the newest first. In terms of maximum and sum a chunk is a matrix;
    the first chunk of a track, whose first frames have no earlier ones, is a constant one."""

    def __init__(self, period: float, tightness: float):
        self.near, self.far = math.floor(period / 2 + 0.5), math.floor(2 * period + 0.5)
        self.cost = -tightness * np.log(np.arange(self.near, self.far + 1) / period) ** 2
        self.start = np.concatenate([[0.0], np.full(self.far, -np.inf)])

    def run(self, x: np.ndarray, n: np.ndarray, past: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and last pasts of rows of x; where `first`, a frame without earlier ones has its strength alone."""
        side, far = (len(x), *[1] * (past.ndim - 2)), self.far
        line = np.full((far + x.shape[1], *past.shape[:-1]), -np.inf)  # by time, the past before it
        line[:far] = np.moveaxis(past, -1, 0)[::-1]
        cost, begin = self.cost[::-1].reshape(-1, *[1] * (past.ndim - 1)), first.reshape(side)
        for t, v in enumerate(np.ascontiguousarray(x.T)):
            best = (line[t : t + len(cost)] + cost).max(0)
            score = v.reshape(side) + np.where(np.isneginf(best) & begin, 0.0, best)
            line[far + t] = np.where((t < n).reshape(side), score, -np.inf)
        last = line[n[:, None] + np.arange(far)[::-1], np.arange(len(x))[:, None]]
        return np.moveaxis(line[far:], 0, -1), np.moveaxis(last, 1, -1)

    def back(self, past: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How many frames before each the one lies that its score was built on, the nearest of equals; 0 for a first beat."""
        line = np.concatenate([past[:, ::-1], scores], 1)
        best, out = np.full(scores.shape, -np.inf), np.zeros(scores.shape, np.int32)
        for g, cost in zip(range(self.near, self.far + 1), self.cost, strict=True):
            score = line[:, self.far - g : self.far - g + scores.shape[1]] + cost
            better = score > best
            best[better], out[better] = score[better], g
        return out

    def maps(self, x: np.ndarray, n: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        size = self.far + 1
        out = np.full((len(x), size, size), -np.inf)
        out[:, 0, 0] = 0.0
        unit = np.full((self.far, self.far), -np.inf)
        np.fill_diagonal(unit, 0.0)
        _, last = self.run(x, n, np.tile(unit, (len(x), 1, 1)), np.zeros(len(x), bool))
        out[:, 1:, 1:] = np.swapaxes(last, 1, 2)
        begin = chunk == 0
        if begin.any():
            _, last = self.run(x[begin], n[begin], np.full((int(begin.sum()), self.far), -np.inf), np.ones(int(begin.sum()), bool))
            out[begin, 1:, 1:] = -np.inf
            out[begin, 1:, 0] = last
        return out.reshape(len(x), -1)

    def through(self, m: np.ndarray, state: np.ndarray) -> np.ndarray:
        return (m.reshape(len(state), -1) + state).max(1)

    def joined(self, m: np.ndarray, then: np.ndarray) -> np.ndarray:
        size = self.far + 1
        a, b = m.reshape(size, size), then.reshape(size, size)
        return np.stack([(row[:, None] + a).max(0) for row in b]).ravel()


class Jumps:
    """Where the way back leaves a chunk, for each of the last places at which it may come in; -1 where it has ended. Places
    count back from the chunk's end."""

    start = np.array([0.0])

    def through(self, m: np.ndarray, state: np.ndarray) -> np.ndarray:
        return m[int(state[0])][None] if state[0] >= 0 else state

    def joined(self, m: np.ndarray, then: np.ndarray) -> np.ndarray:
        return np.where(m >= 0, then[np.maximum(m, 0).astype(int)], -1.0)


def strength_rows(onsets: DataFrame, period: float, size: int) -> DataFrame:
    """(track, chunk, row): the strengths of each chunk of `size` frames in order, from onsets (track, i from 0 without gaps, x).

    A chunk is gathered with the frames of its neighbours that the bell reaches, and many are smoothed at once; a track's
    root mean square is made of its chunks' sums.
    """
    sigma = max(1.0, period / 32)
    half = math.ceil(3 * sigma)
    bell = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x, n = laid(p.x, p.lead, size, half, half)
        x = np.where(np.isnan(x), 0.0, x)  # nothing known adds nothing
        own = x[:, half:-half]
        out = np.zeros_like(own)
        for k, w in enumerate(bell):
            out += x[:, k : k + own.shape[1]] * w
        known = [row[lead : lead + m] for row, lead, m in zip(p.x, p.lead, n, strict=True)]
        sums = {"n": [int((~np.isnan(v)).sum()) for v in known], "squares": [float(row[:m] @ row[:m]) for row, m in zip(own, n, strict=True)]}
        return pd.DataFrame({"track": p.track, "chunk": p.chunk, "row": [row[:m] for row, m in zip(out, n, strict=True)], **sums})

    track = f"track {onsets.schema['track'].dataType.simpleString()}"
    rows = strips(onsets.withColumn("x", F.col("x").cast("double")), ["x"], size, half, half)
    smooth = written(rows.mapInPandas(stepped(run), f"{track}, chunk long, row array<double>, n long, squares double"))
    rms = F.sqrt(F.sum("squares") / F.sum("n"))
    size_of = smooth.groupBy("track").agg(F.when(rms > 0, rms).otherwise(1.0).alias("rms"))
    return smooth.join(size_of, "track").select("track", "chunk", F.transform("row", lambda x: x / F.col("rms")).alias("row"))


def strengths(onsets: DataFrame, period: float) -> DataFrame:
    """(track, i, x): onsets (track, i from 0 without gaps, x) smoothed by a bell of a 32nd of the period (a frame at least) over their root mean
    square. A task has chunks of tracks, so no track is gathered."""
    size = max(1024, math.ceil(period))
    rows = strength_rows(onsets, period, size).select("track", "chunk", F.posexplode("row").alias("p", "x"))
    return rows.select("track", (F.col("chunk") * size + F.col("p")).alias("i"), "x")


def beats_of(strength: DataFrame, period: float, tightness: float = 100.0, size: int = 1024, width: int = 64) -> DataFrame:
    """(track, i, x): beats of strengths (track, i from 0 without gaps, x), some `period` frames apart.

    The last beat is the best score of the last period; the way back follows what each score was built on. Weak beats at
    both ends, under a quarter of the upper median strength, go. A chunk of `size` frames is stepped through at a time,
    and no task has more than `width` chunks' maps.
    """
    size = max(size, 2 * Scores(period, tightness).far)
    return _beats(chunks_of(strength, size), period, tightness, size, width)


def beats(onsets: DataFrame, period: float, tightness: float = 100.0, size: int = 1024, width: int = 64) -> DataFrame:
    """beats_of the strengths of onsets (track, i from 0 without gaps, x), which stay in their chunks."""
    size = max(size, 2 * Scores(period, tightness).far)
    return _beats(strength_rows(onsets, period, size), period, tightness, size, width)


def _beats(rows: DataFrame, period: float, tightness: float, size: int, width: int) -> DataFrame:
    scan = Scores(period, tightness)
    far, late = scan.far, math.ceil(period)
    own = written(rows)
    track = f"track {own.schema['track'].dataType.simpleString()}"
    many = max(1, (1 << 20) // (far * far))

    def maps(p: pd.DataFrame) -> pd.DataFrame:
        x, n = _rows(p.row)
        return pd.DataFrame({"track": p.track, "chunk": p.chunk, "m": list(scan.maps(x, n, p.chunk.to_numpy()))})

    def scores(p: pd.DataFrame) -> pd.DataFrame:
        x, n = _rows(p.row)
        past = np.stack(p.state.to_numpy())[:, 1:]
        found, _ = scan.run(x, n, past, p.chunk.to_numpy() == 0)
        back = [b[:k] for b, k in zip(scan.back(past, found), n, strict=True)]
        return pd.DataFrame({"track": p.track, "chunk": p.chunk, "row": p.row, "back": back, "tail": [s[max(0, k - late) : k] for s, k in zip(found, n, strict=True)]})

    mapped = lambda chunks: chunks.mapInPandas(stepped(maps, many), f"{track}, chunk long, m array<double>")
    before = with_states(own, F.size("row") < size, mapped, scan, width)
    scored = written(before.mapInPandas(stepped(scores), f"{track}, chunk long, row array<double>, back array<int>, tail array<double>"))
    end = F.col("chunk") * size + F.size("back")
    ends = scored.groupBy("track").agg(F.max(end).alias("n"), F.max("chunk").alias("top"))
    each = scored.select("track", end.alias("end"), F.size("tail").alias("m"), F.posexplode("tail").alias("p", "score")).select("track", (F.col("end") - F.col("m") + F.col("p")).alias("i"), "score")
    tail = each.join(ends, "track").where(F.col("i") >= F.col("n") - late)
    last = top(tail, ["track"], [F.desc("score"), F.asc("i")]).select("track", F.col("i").alias("last"), "top")
    done = written(scored.drop("tail").join(last, "track").withColumn("turned", F.col("top") - F.col("chunk")))

    def trail(back: np.ndarray, p: int) -> tuple[list[int], int]:
        """Places of a chunk on the way back from p, and where it leaves the chunk (negative), or -far - 1 at its end."""
        out = []
        while p >= 0:
            out.append(p)
            if not back[p]:
                return out, -far - 1
            p -= int(back[p])
        return out, p

    def jumps(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for back, chunk, end in zip(p.back, p.chunk, p["last"], strict=True):
            place = int(end) - int(chunk) * size
            if place < 0:
                out.append(np.zeros(far))
                continue
            begins = [place] * far if place < len(back) else [len(back) - 1 - o for o in range(far)]
            left = [trail(back, b)[1] for b in begins[: 1 if place < len(back) else far]]
            left = left * far if place < len(back) else left
            out.append(np.array([-1.0 if v < -far else -1.0 - v for v in left]))
        return pd.DataFrame({"track": p.track, "chunk": p.turned, "m": out})

    def places(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, back, chunk, end, state in zip(p.row, p.back, p.chunk, p["last"], p.state, strict=True):
            place = int(end) - int(chunk) * size
            begin = place if 0 <= place < len(back) else len(back) - 1 - int(state[0]) if place >= 0 and state[0] >= 0 else -1
            at = np.array(trail(back, begin)[0], np.int64)
            out.append((at + int(chunk) * size, row[at]))
        return pd.DataFrame({"track": p.track, "i": [i for i, _ in out], "x": [x for _, x in out]})

    turns = lambda chunks: chunks.mapInPandas(stepped(jumps), f"{track}, chunk long, m array<double>")
    into = with_states(done, F.col("chunk") == 0, turns, Jumps(), width, "turned")
    found = into.mapInPandas(stepped(places), f"{track}, i array<long>, x array<double>").select("track", F.explode(F.arrays_zip("i", "x")).alias("v"))
    beats = written(found.select("track", "v.i", "v.x"))
    weak = beats.groupBy("track").agg((0.25 * upper_median(F.collect_list("x"))).alias("least"), F.max("i").alias("end"))
    strong, line = F.when(F.col("x") >= F.col("least"), F.col("i")), Window.partitionBy("track")
    span = beats.join(weak, "track").withColumns({"a": F.min(strong).over(line), "b": F.max(strong).over(line)})
    return span.where(F.col("i").between(F.coalesce("a", "end"), F.coalesce("b", "end"))).select("track", "i", "x")
