"""Bounded rate limits and the value cache against plain Python."""

from pyspark.sql import functions as F

from cadenza.streaming import buckets, live

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run(spark, path, batches, schema, make):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        return live.finished(make(live.stream_of(spark, f"{path}/in", schema)), str(path)).collect()
    finally:
        for k in STORE:
            spark.conf.unset(k)


def plain(calls, per_second, burst):
    left, out = {}, {}
    for key, t, i in calls:
        tokens, last = left.get(key, (burst, t))
        tokens = min(burst, tokens + (t - last) * per_second)
        out[i] = (tokens >= 1, round(tokens - (tokens >= 1), 6))
        left[key] = (tokens - (tokens >= 1), t)
    return out


def test_buckets_equal_plain_python(spark, tmp_path):
    calls = [(f"k{i % 5}", i * 0.7, i) for i in range(60)]
    batches = [calls[a : a + 20] for a in (0, 20, 40)]
    got = run(spark, tmp_path, batches, "key string, t double, id long", lambda s: buckets.admitted(s, 0.2, 2.0, shards=2))
    assert {r.id: (r.ok, round(r.tokens, 6)) for r in got} == plain(calls, 0.2, 2.0)


def test_the_key_used_longest_ago_is_let_go(spark, tmp_path):
    """10,001 keys use up their only token; then the last 10,000 are denied, as they are kept, and the first is new again."""
    first = [(f"k{i:05}", i / 1000, i) for i in range(10_001)]
    again = [(f"k{i:05}", 20.0 + i / 1000, 20_000 + i) for i in range(10_001)]
    got = {r.id: r.ok for r in run(spark, tmp_path, [first, again[1:], again[:1]], "key string, t double, id long", lambda s: buckets.admitted(s, 1e-9, 1.0))}
    assert all(got[i] for i in range(10_001))
    assert not any(got[20_000 + i] for i in range(1, 10_001)) and got[20_000]


def test_cache(spark, tmp_path):
    asked = [("a", 0.0, 1, "x"), ("a", 29.0, 2, "y"), ("b", 5.0, 3, "z")], [("a", 30.0, 4, "y"), ("a", 31.0, 5, "w"), ("b", 34.0, 6, "q")]
    got = run(spark, tmp_path, asked, "key string, t double, id long, fresh string", buckets.cached)
    assert {r.id: (r.value, r.hit) for r in got} == {1: ("x", False), 2: ("x", True), 3: ("z", False), 4: ("y", False), 5: ("y", True), 6: ("z", True)}


def test_idle_values_are_swept(spark, tmp_path):
    """A value whose time to live is not over is gone once its timer has fired (only running queries have timers)."""
    schema = "key string, t double, id long, fresh string"
    spark.createDataFrame([("a", 0.0, 1, "x")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    for k, v in STORE.items():
        spark.conf.set(k, v)
    out = buckets.cached(live.stream_of(spark, f"{tmp_path}/in", schema), 30.0, 0.5)
    try:
        writer = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        query = writer.trigger(processingTime="200 milliseconds").start()
        live.waited(query, seconds=20)
        spark.createDataFrame([("a", 1.0, 2, "y")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.waited(query, seconds=20)
        query.stop()
    finally:
        for k in STORE:
            spark.conf.unset(k)
    assert {(r.id, r.value, r.hit) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "x", False), (2, "y", False)}
