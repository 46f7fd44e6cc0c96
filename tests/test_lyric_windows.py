"""Lyric lines are scored once for windows of all lengths, and the quicker pattern of address words finds the same lines."""

import random

from pyspark.sql import functions as F

from cadenza.plans.lyrics import ADDRESS, ADDRESSED, QUERIES


def test_windows_of_lines_score_them_once(spark):
    plan = QUERIES["lyric_window"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_address_words_are_the_same(spark):
    rng = random.Random(4)
    parts = ["tu", "toi", "te", "t'", "you", "your", "we", "nous", "on", " ", "_", "-", "é", "a", "9", "\r", "!"]
    df = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randrange(6))),) for _ in range(5000)], "x string")
    assert df.where(F.col("x").rlike(ADDRESS.replace("''", "'")) != F.col("x").rlike(ADDRESSED)).count() == 0
    assert 0 < df.where(F.col("x").rlike(ADDRESSED)).count() < 5000
