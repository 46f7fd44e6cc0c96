"""Sliding windows, runs, peaks and as-of joins over ordered rows, each partitioned by a track."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame(keys: Sequence[str], order: Sequence[str], lo: int, hi: int):
    """Rows lo to hi around the current one (negative: before)."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(lo, hi)


def moving_average(x: Column, keys: Sequence[str], order: Sequence[str], half: int) -> Column:
    """Centred mean of 2 * half + 1 rows, of fewer at the ends."""
    return F.avg(x).over(frame(keys, order, -half, half))


def sliding_windows(df: DataFrame, x: str, keys: Sequence[str], order: str, win: int, hop: int = 1) -> DataFrame:
    """Mean of each `win` rows, every hop-th; a track shorter than win gives one window over all it has.

    `order` must count rows from 0 without gaps. Adds w (window number) and mean.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    mean = F.avg(x).over(frame(keys, [order], -(win - 1), 0))
    last = F.col(order) - (win - 1)
    whole = (last >= 0) & (F.pmod(last, F.lit(hop)) == 0)
    short = (F.col("_n") < win) & (F.col(order) == F.col("_n") - 1)
    rows = df.withColumns({"_n": n, "mean": mean}).where(whole | short)
    return rows.select(*keys, F.when(short, 0).otherwise(F.floor(last / hop)).cast("long").alias("w"), "mean")


def with_runs(df: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str], name: str = "run") -> DataFrame:
    """Numbers the runs of equal values (nulls are equal) of each track from 1."""
    line = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_v", value)
    changed = F.when(F.row_number().over(line) == 1, 1).otherwise((~F.col("_v").eqNullSafe(F.lag("_v").over(line))).cast("int"))
    return df.withColumn("_c", changed).withColumn(name, F.sum("_c").over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_v", "_c")


def runs(df: DataFrame, mask: Column, keys: Sequence[str], order: str) -> DataFrame:
    """Runs where mask holds: (keys, run, a, b), b behind the last row."""
    marked = with_runs(df.withColumn("_m", F.coalesce(mask, F.lit(False))), F.col("_m"), keys, [order])
    return marked.where("_m").groupBy(*keys, "run").agg(F.min(order).alias("a"), (F.max(order) + 1).alias("b"))


def closed_runs(df: DataFrame, keys: Sequence[str], gap: int, least: int) -> DataFrame:
    """Joins runs (a, b) less than `gap` apart, then drops those shorter than `least`."""
    line = Window.partitionBy(*keys).orderBy("a")
    far = F.coalesce((F.col("a") - F.lag("b").over(line) >= gap).cast("int"), F.lit(1))
    grouped = df.withColumn("_f", far).withColumn("_g", F.sum("_f").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_g").agg(F.min("a").alias("a"), F.max("b").alias("b")).where(F.col("b") - F.col("a") >= least).drop("_g")


def local_peaks(df: DataFrame, x: str, keys: Sequence[str], order: Sequence[str], threshold: Column) -> DataFrame:
    """Rows that are at least the one before and above the one after, and at or above the threshold."""
    line = Window.partitionBy(*keys).orderBy(*order)
    before, after = F.lag(x).over(line), F.lead(x).over(line)
    peak = before.isNotNull() & after.isNotNull() & (F.col(x) >= before) & (F.col(x) > after) & (F.col(x) >= threshold)
    return df.withColumn("_p", peak).where("_p").drop("_p")


def spaced(df: DataFrame, score: str, place: str, keys: Sequence[str], distance: float, most: int | None = None) -> DataFrame:
    """Greedy picks per track: highest score first (ties: smaller place), each at least `distance` from all before.

    The candidates of a track are folded in one array, so use it on peaks, not on samples.
    """
    item = F.struct((-F.col(score)).alias("s"), F.col(place).alias("p"))
    many = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("c"))
    kind = df.schema[place].dataType.simpleString()
    start = F.array().cast(f"array<{kind}>")

    def step(picked: Column, c: Column) -> Column:
        free = ~F.exists(picked, lambda p: F.abs(p - c.p) < distance)
        if most is not None:
            free = free & (F.size(picked) < most)
        return F.when(free, F.concat(picked, F.array(c.p))).otherwise(picked)

    return many.select(*keys, F.explode(F.aggregate("c", start, step)).alias(place))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], forward: bool = False) -> DataFrame:
    """left with `values` of the last right row at or before `at` (forward: the first at or after) of its keys.

    One sorted pass over the union of both, so neither a range join nor a product of rows.
    """
    marked = left.withColumns({"_side": F.lit(1 - 2 * forward), **{f"_{v}": F.lit(None).cast(right.schema[v].dataType) for v in values}})
    other = right.select(*keys, at, F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    line = Window.partitionBy(*keys).orderBy(at, "_side")
    line = line.rowsBetween(0, Window.unboundedFollowing) if forward else line.rowsBetween(Window.unboundedPreceding, 0)
    pick = F.first if forward else F.last
    both = marked.unionByName(other, allowMissingColumns=True)
    filled = both.withColumns({v: pick(F.when(F.col("_side") == 0, F.struct(f"_{v}")), ignorenulls=True).over(line)[f"_{v}"] for v in values})
    return filled.where(F.col("_side") != 0).drop("_side", *[f"_{v}" for v in values])


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, name: str = "rank") -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
