"""Similarity of feature vectors: pairs inside a track, nearest neighbours, lags and diagonals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dot


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def unit(v: Column) -> Column:
    """v divided by its length (plus epsilon)."""
    n = F.sqrt(dot(v, v)) + 1e-12
    return F.transform(v, lambda x: x / n)


def pairs(df: DataFrame, keys: list[str], u: str, columns: list[str]) -> DataFrame:
    """Ordered pairs a < b inside each track. Tracks are bounded (pooled units of one song), so this join is local to them."""
    a = df.select(*keys, F.col(u).alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = df.select(*keys, F.col(u).alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, keys).where(F.col("a") < F.col("b"))


def mutual_neighbours(distances: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Pairs (a, b, d) each among the other's k nearest. distances holds every unordered pair once."""
    both = distances.select(*keys, "a", "b", "d").unionByName(distances.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    near = both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "a").orderBy("d", "b"))).where(F.col("_k") <= k).drop("_k")
    back = near.select(*keys, F.col("a").alias("b"), F.col("b").alias("a"))
    return near.join(back, [*keys, "a", "b"], "left_semi").where(F.col("a") < F.col("b"))


def diagonal_mean(df: DataFrame, keys: list[str], x: str, length: int) -> DataFrame:
    """Mean of x along each diagonal lag = b - a over `length` steps from a on."""
    lag = df.withColumn("lag", F.col("b") - F.col("a"))
    w = Window.partitionBy(*keys, "lag").orderBy("a").rowsBetween(0, length - 1)
    return lag.withColumn("mean", F.avg(x).over(w))
