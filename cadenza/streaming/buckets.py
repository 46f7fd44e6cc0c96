"""Rate limits and a value cache with bounded state, on transformWithState: timers let idle keys go, and a shard of keys keeps
only those used last."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Keys beyond which those used longest ago are let go, seconds after which a key is idle.
MOST_KEYS, IDLE_SECONDS = 10_000, 600.0


class _Buckets(StatefulProcessor):
    """Token buckets of a shard's keys. State: a map from key to (tokens, last call)."""

    def __init__(self, per_second: float, burst: float, most: int, idle: float):
        self.per_second, self.burst, self.most, self.idle = per_second, burst, most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "key string", "tokens double, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["t", "id"])
        known = {k[0]: tuple(v) for k, v in self.buckets.iterator()} if self.buckets.exists() else {}
        out, changed = [], {}
        for who, t, i in calls[["key", "t", "id"]].itertuples(index=False):
            tokens, last = changed.get(who) or known.get(who) or (self.burst, t)
            tokens = min(self.burst, tokens + max(0.0, t - last) * self.per_second)
            ok = tokens >= 1
            changed[who] = (tokens - ok, max(t, last))
            out.append((who, i, bool(ok), float(tokens - ok)))
        for who, (tokens, last) in changed.items():
            self.buckets.updateValue((who,), (float(tokens), float(last)))
        known |= changed
        now = float(calls.t.max())
        # as few as are needed go: idle keys once the shard is full, then those used longest ago
        if len(known) > self.most:
            oldest = sorted(known, key=lambda k: (known[k][1], k))
            for k in oldest[: len(known) - self.most] + [k for k in oldest[len(known) - self.most :] if now - known[k][1] >= self.idle]:
                self.buckets.removeKey((k,))
        yield pd.DataFrame(out, columns=["key", "id", "ok", "tokens"])

    def close(self) -> None:
        pass


def admitted(calls: DataFrame, per_second: float, burst: float, shards: int = 1, most_keys: int = MOST_KEYS, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """Admission of each call (key string, t seconds, id) of a stream: (key, id, ok, tokens left); denied calls take none.

    Keys are dealt to shards by hash, which are the groups of state: each keeps most_keys / shards keys at most, so that all
    together keep most_keys. Beyond that, keys idle for idle_seconds by the calls' own clock go, and those used longest ago.
    A key that comes back after it was let go has a full bucket.
    """
    sharded = calls.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "t", "id")
    processor = _Buckets(per_second, burst, max(1, most_keys // shards), idle_seconds)
    return sharded.groupBy("shard").transformWithStateInPandas(processor, "key string, id long, ok boolean, tokens double", "Append", "None")


class _Cached(StatefulProcessor):
    """The last value of a key, looked up afresh when it is older than its time to live; a timer lets it go after that."""

    def __init__(self, seconds: float, idle: float | None):
        self.seconds, self.idle = seconds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string, at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["t", "id"])
        value, at = self.held.get() if self.held.exists() else (None, float("-inf"))
        out = []
        for t, i, fresh in asked[["t", "id", "fresh"]].itertuples(index=False):
            hit = t - at < self.seconds
            if not hit:
                value, at = fresh, float(t)
            out.append((key[0], i, value, bool(hit)))
        self.held.update((value, at))
        if self.idle is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.idle))
        yield pd.DataFrame(out, columns=["key", "id", "value", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=str), "id": pd.Series(dtype="int64"), "value": pd.Series(dtype=str), "hit": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def cached(lookups: DataFrame, seconds: float = 30.0, idle_seconds: float | None = None) -> DataFrame:
    """(key, id, value, hit) of a stream of lookups (key string, t seconds, id, fresh): a value is served for `seconds` from
    when it was fetched, then the fresh one is taken. With idle_seconds, a timer sweeps the state of a key that has had no
    lookups for so long; without, every key stays."""
    mode = "None" if idle_seconds is None else "ProcessingTime"
    return lookups.groupBy("key").transformWithStateInPandas(_Cached(seconds, idle_seconds), "key string, id long, value string, hit boolean", "Append", mode)
