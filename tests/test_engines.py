"""The engines' contract, and features of songs."""

import pytest
from pyspark.sql import functions as F

from cadenza.engines import Engine, MissingInputs, start, status, tables
from cadenza.plans import QUERIES
from cadenza.plans.service import ENGINES

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    seen = []
    engine = Engine("e", {"x": ("a", "b")}, lambda spark, t: t["x"].withColumn("n", F.lit(len(t))), {"y": ("c",)})
    assert not status(engine, {}).available and status(engine, {}).detail == "lacks x"
    assert status(engine, {"x": df.drop("b")}).detail == "lacks x.b" and status(engine, {"x": df}).detail == "ready"
    assert status(engine, {"x": df, "y": df}).detail == "lacks y.c" and status(engine, {"x": df, "y": df.withColumn("c", F.lit(1))}).detail == "with y"
    assert start(engine, spark, {"x": df, "z": df}, lambda *p: seen.append(p)).first().n == 1 and seen == [("inputs", 0.0), ("planned", 1.0)]
    with pytest.raises(MissingInputs) as e:
        start(engine, spark, {"y": df})
    assert e.value.names == ["x", "y.c"] and "needs x" in str(e.value)
    broken = Engine("b", {"x": ("a",)}, lambda spark, t: t["x"])
    assert status(broken, {"x": None}).detail.startswith("error") and not status(broken, {"x": None}).available


def test_tables_that_are_there(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a.parquet")
    assert set(tables(spark, str(tmp_path), ["a", "b"])) == {"a"}


def test_registered_engines_run(spark):
    given = tables(spark, SF, ["events", "customer", "embeddings", "lineitem"])
    rows = start(ENGINES["melody"], spark, given).collect()
    assert len(rows) == 45 and {r.name for r in rows} - {None}
    assert "name" not in start(ENGINES["melody"], spark, {"events": given["events"]}).columns


def test_features_have_one_row_a_song(spark):
    rows = QUERIES["song_features"](spark, SF).collect()
    assert sorted(r.track for r in rows) == list(range(5)) and all(r.seconds == 100 and r.key and r.form and 0 <= r.chorus_share <= 1 and r.clip_at is not None for r in rows)
