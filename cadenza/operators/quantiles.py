"""Exact quantiles of a whole column without one task that holds its values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, x: str, quantiles: Sequence[float], parts: int = 64) -> DataFrame:
    """(k, t, n) for the k-th quantile (from 1): its interpolated value t among all n values of x that are not null.

    Equal values are counted first, so a value that a third of all rows have is one row. Distinct values go to `parts`
    ranges; their bounds are approximate, which moves only the balance, as each range's counts are shifted by those of
    the ranges before. Each quantile then needs the two values at its place. No values: no rows.
    """
    values = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("m"))
    bounds = values.agg(F.percentile_approx("x", [k / parts for k in range(1, parts)], 1000).alias("bounds"))
    ranged = values.crossJoin(F.broadcast(bounds)).select("x", "m", F.size(F.filter("bounds", lambda b: b < F.col("x"))).alias("part"))
    totals = ranged.groupBy("part").agg(F.sum("m").alias("total"))
    # at most `parts` rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shift"), F.sum("total").over(Window.partitionBy(F.lit(0))).alias("n"))
    line = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("m").over(line)).join(F.broadcast(shifts), "part").withColumn("upto", F.col("upto") + F.col("shift"))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(q).cast("double").alias("q")) for k, q in enumerate(quantiles, 1)])
    place = lambda w: w.q * (F.col("n") - 1)
    first = F.col("upto") - F.col("m")
    inside = lambda p: (p >= first) & (p < F.col("upto"))
    near = placed.select("x", "m", "upto", "n", F.explode(F.filter(wanted, lambda w: inside(F.floor(place(w))) | inside(F.ceil(place(w))))).alias("w"))
    at = place(F.col("w"))
    low, high = F.when(inside(F.floor(at)), F.col("x")), F.when(inside(F.ceil(at)), F.col("x"))
    ends = near.groupBy(F.col("w.k").alias("k")).agg(F.max(low).alias("low"), F.max(high).alias("high"), F.max(at - F.floor(at)).alias("part"), F.max("n").alias("n"))
    return ends.select("k", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("t"), "n")
