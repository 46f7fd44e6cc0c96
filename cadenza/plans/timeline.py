"""Loudness, windows, runs, peaks and joins in time over the event signals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import from_power_db, loudness, upper_median
from ..operators.levels import gated
from ..operators.quantiles import exact_quantiles
from ..operators.windows import asof, closed_runs, frame, local_peaks, moving_average, runs, sliding_windows, spaced, top, with_runs
from ..sources.tables import BLOCKS, SAMPLES, blocks, samples, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c, n: int = 4):
    """Rounded, with negative zero as zero."""
    return F.round(c, n) + F.lit(0.0)


# 400 ms windows of 100 ms blocks become windows of 4 hourly blocks; momentary level of each
MOMENTARY = f"""{BLOCKS}, sized AS (SELECT *, count(*) OVER (PARTITION BY track) AS n FROM blocks),
w4 AS (SELECT track, b - 3 AS w, avg(energy) OVER (PARTITION BY track ORDER BY b ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS mean, b, n FROM sized),
momentary AS (SELECT track, w, mean, -0.691 + 10 * log10(mean) AS l FROM w4 WHERE w >= 0 OR (n < 4 AND b = n - 1))"""


def momentary(spark: SparkSession, sf_dir: str, win: int = 4) -> DataFrame:
    return sliding_windows(blocks(spark, sf_dir), "energy", ["track"], "b", win).withColumn("l", loudness(F.col("mean")))


@query(f"""WITH {MOMENTARY}, loud AS (SELECT * FROM momentary WHERE l > -70),
g AS (SELECT track, -0.691 + 10 * log10(avg(mean)) - 10 AS gate FROM loud GROUP BY track),
i AS (SELECT track, -0.691 + 10 * log10(avg(mean)) AS l, count(*) AS n FROM loud JOIN g USING (track) WHERE l > gate GROUP BY track)
SELECT track, round(l, 4) AS integrated, n AS n_windows, CAST(rank() OVER (ORDER BY round(l, 4) DESC, track) AS BIGINT) AS place FROM i""")
def loudness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = gated(momentary(spark, sf_dir), -70.0, 10.0)
    per_track = kept.groupBy("track").agg(r(loudness(F.avg("mean"))).alias("integrated"), F.count(F.lit(1)).alias("n_windows"))
    return per_track.withColumn("place", F.rank().over(Window.orderBy(F.desc("integrated"), "track")).cast("long"))


@query(f"""WITH {MOMENTARY}, s AS (SELECT track, avg(energy) OVER (PARTITION BY track ORDER BY b ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS mean, b - 29 AS w FROM blocks),
loud AS (SELECT track, mean, -0.691 + 10 * log10(mean) AS l FROM s WHERE w >= 0), g AS (SELECT track, -0.691 + 10 * log10(avg(mean)) - 20 AS gate FROM loud WHERE l > -70 GROUP BY track)
SELECT track, round(quantile_cont(l, 0.95) - quantile_cont(l, 0.1), 4) + 0.0 AS lra FROM loud JOIN g USING (track) WHERE l > -70 AND l > gate GROUP BY track""")
def lra(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = gated(momentary(spark, sf_dir, 30), -70.0, 20.0)
    p = lambda q: F.percentile("l", F.lit(q))
    spread = F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(p(0.95) - p(0.1))
    return kept.groupBy("track").agg(r(spread).alias("lra"))


@query(f"WITH {MOMENTARY} SELECT track, round(max(least(10, greatest(-70, l))), 4) AS momentary_max, count(*) AS n FROM momentary GROUP BY track")
def momentary_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.least(F.lit(10.0), F.greatest(F.lit(-70.0), F.col("l")))
    return momentary(spark, sf_dir).groupBy("track").agg(r(F.max(shown)).alias("momentary_max"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BLOCKS}, w AS (SELECT track, b - 29 AS i, avg(energy) OVER (PARTITION BY track ORDER BY b ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS mean FROM blocks)
SELECT track, CAST(i // 10 AS BIGINT) AS w, round(-0.691 + 10 * log10(mean), 4) AS short_term FROM w WHERE i >= 0 AND i % 10 = 0""")
def short_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding_windows(blocks(spark, sf_dir), "energy", ["track"], "b", 30, hop=10).select("track", "w", r(loudness(F.col("mean"))).alias("short_term"))


RUNS_SQL = f"""{SAMPLES}, m AS (SELECT track, i, x > 60 AS hot FROM samples), c AS (SELECT *, CASE WHEN hot IS DISTINCT FROM lag(hot) OVER w THEN 1 ELSE 0 END AS ch FROM m WINDOW w AS (PARTITION BY track ORDER BY i)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY track ORDER BY i) AS run FROM c)"""


@query(f"WITH {RUNS_SQL}, z AS (SELECT track, run, count(*) AS n FROM g WHERE hot GROUP BY 1, 2) SELECT track, CAST(sum(n) AS BIGINT) AS clipped, count(*) AS n_runs FROM z WHERE n >= 3 GROUP BY track")
def clipped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(samples(spark, sf_dir), F.col("x") > 60, ["track"], "i").withColumn("n", F.col("b") - F.col("a")).where("n >= 3")
    return found.groupBy("track").agg(F.sum("n").alias("clipped"), F.count(F.lit(1)).alias("n_runs"))


@query(f"WITH {RUNS_SQL} SELECT track, min(i) AS a, max(i) + 1 AS b FROM g WHERE hot GROUP BY track, run")
def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(samples(spark, sf_dir), F.col("x") > 60, ["track"], "i").select("track", "a", "b")


@query(f"""WITH {RUNS_SQL}, z AS (SELECT track, min(i) AS a, max(i) + 1 AS b FROM g WHERE hot GROUP BY track, run),
f AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY track ORDER BY a) < 2 THEN 0 ELSE 1 END AS far FROM z), k AS (SELECT *, sum(far) OVER (PARTITION BY track ORDER BY a) AS grp FROM f)
SELECT track, min(a) AS a, max(b) AS b FROM k GROUP BY track, grp HAVING max(b) - min(a) >= 4""")
def close_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed_runs(runs(samples(spark, sf_dir), F.col("x") > 60, ["track"], "i"), ["track"], gap=2, least=4)


@query("""WITH s AS (SELECT l_orderkey AS track, l_linenumber AS idx, l_returnflag AS kind, l_quantity AS bars, l_extendedprice / 10000 AS loud, l_partkey AS p, l_suppkey AS u FROM lineitem),
c AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w THEN 1 ELSE 0 END AS ch FROM s WINDOW w AS (PARTITION BY track ORDER BY idx, p, u, bars, loud, kind)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY track ORDER BY idx, p, u, bars, loud, kind ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT track, CAST(run AS BIGINT) AS run, min(kind) AS kind, sum(bars) AS bars, round(10 * log10(sum(pow(10, loud / 10) * bars) / sum(bars)), 7) AS loud FROM g GROUP BY track, run""")
def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("bars"), (F.col("l_extendedprice") / 10000).alias("loud"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("u")
    )
    power = F.sum(from_power_db(F.col("loud")) * F.col("bars")) / F.sum("bars")
    return with_runs(s, F.col("kind"), ["track"], ["idx", "p", "u", "bars", "loud", "kind"]).groupBy("track", "run").agg(F.min("kind").alias("kind"), F.sum("bars").alias("bars"), r(10 * F.log10(power), 7).alias("loud"))


@query(f"WITH {SAMPLES} SELECT track, i, round(avg(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 7) AS smooth FROM samples")
def moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("track", "i", r(moving_average(F.col("x"), ["track"], ["i"], 3), 7).alias("smooth"))


@query(f"""WITH {SAMPLES}, d AS (SELECT track, i, greatest(0, x - avg(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)) AS y FROM samples)
SELECT track, i, CASE WHEN max(y) OVER (PARTITION BY track) > 0 THEN round(y / max(y) OVER (PARTITION BY track), 4) ELSE 0 END + 0.0 AS onset FROM d""")
def detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.greatest(F.lit(0.0), F.col("x") - moving_average(F.col("x"), ["track"], ["i"], 8))
    top_y = F.max("y").over(Window.partitionBy("track"))
    return samples(spark, sf_dir).select("track", "i", y.alias("y")).select("track", "i", F.when(top_y > 0, r(F.col("y") / top_y)).otherwise(0.0).alias("onset"))


@query(f"""WITH {SAMPLES}, w AS (SELECT track, i, list_sort(list(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM samples)
SELECT track, i, l[len(l) // 2 + 1] AS upper_median, round(list_median(l), 6) AS median FROM w""")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = F.collect_list("x").over(frame(["track"], ["i"], -2, 2))
    both = samples(spark, sf_dir).select("track", "i", F.sort_array(five).alias("l"))
    n = F.size("l")
    low = F.get("l", F.floor((n - 1) / 2).cast("int"))
    return both.select("track", "i", upper_median(F.col("l")).alias("upper_median"), r((low + upper_median(F.col("l"))) / 2, 6).alias("median"))


@query(f"""WITH {SAMPLES}, p AS (SELECT track, quantile_cont(x, 0.8) * 0.7 AS t FROM samples GROUP BY track),
w AS (SELECT track, i, avg(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS m FROM samples)
SELECT track, coalesce(min(CASE WHEN m >= t THEN i END), 0) AS first_full FROM w JOIN p USING (track) GROUP BY track""")
def first_full_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    level = s.groupBy("track").agg((F.percentile("x", F.lit(0.8)) * 0.7).alias("t"))
    m = s.select("track", "i", F.avg("x").over(frame(["track"], ["i"], -5, 4)).alias("m")).join(level, "track")
    return m.groupBy("track").agg(F.coalesce(F.min(F.when(F.col("m") >= F.col("t"), F.col("i"))), F.lit(0)).cast("long").alias("first_full"))


@query(f"""WITH {SAMPLES}, w AS (SELECT track, i, x > 30 AS on_, sum(CASE WHEN x > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS hold FROM samples)
SELECT track, min(CASE WHEN on_ AND hold >= 7 THEN i END) AS first_vocal FROM w GROUP BY track""")
def first_vocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = F.col("x") > 30
    hold = F.sum(on.cast("int")).over(frame(["track"], ["i"], 0, 9))
    return samples(spark, sf_dir).select("track", "i", on.alias("on"), hold.alias("hold")).groupBy("track").agg(F.min(F.when(F.col("on") & (F.col("hold") >= 7), F.col("i"))).alias("first_vocal"))


@query(f"""WITH {SAMPLES}, w AS (SELECT track, i, avg(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 2 FOLLOWING AND 24 FOLLOWING) AS later,
 avg(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 30 PRECEDING AND 6 PRECEDING) AS before, lead(x, 5) OVER (PARTITION BY track ORDER BY i) AS guard FROM samples)
SELECT track, i, round(later - before, 7) AS jump FROM w WHERE i >= 30 AND later - before >= 6 AND guard > before""")
def drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead, behind = F.avg("x").over(frame(["track"], ["i"], 2, 24)), F.avg("x").over(frame(["track"], ["i"], -30, -6))
    guard = F.lead("x", 5).over(Window.partitionBy("track").orderBy("i"))
    w = samples(spark, sf_dir).select("track", "i", ahead.alias("later"), behind.alias("before"), guard.alias("guard"))
    jump = F.col("later") - F.col("before")
    return w.where((F.col("i") >= 30) & (jump >= 6) & (F.col("guard") > F.col("before"))).select("track", "i", r(jump, 7).alias("jump"))


@query(f"""WITH {SAMPLES} SELECT track, i, min(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS low,
 round(avg(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 7) AS box FROM samples""")
def sliding_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("track", "i", F.min("x").over(frame(["track"], ["i"], 0, 7)).alias("low"), r(F.avg("x").over(frame(["track"], ["i"], -7, 0)), 7).alias("box"))


@query(f"""WITH {SAMPLES}, w AS (SELECT track, i, x, lag(x) OVER v AS p, lead(x) OVER v AS n FROM samples WINDOW v AS (PARTITION BY track ORDER BY i))
SELECT track, i, x FROM w WHERE x >= p AND x > n AND x >= 40""")
def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_peaks(samples(spark, sf_dir), "x", ["track"], ["i"], F.lit(40.0)).select("track", "i", "x")


@query(f"""WITH RECURSIVE {SAMPLES}, w AS (SELECT track, i, x, lag(x) OVER v AS p, lead(x) OVER v AS n FROM samples WINDOW v AS (PARTITION BY track ORDER BY i)),
c AS (SELECT track, i, row_number() OVER (PARTITION BY track ORDER BY x DESC, i) AS k FROM w WHERE x >= p AND x > n AND x >= 40),
g(track, k, picked) AS (SELECT track, 1, [i] FROM c WHERE k = 1 UNION ALL
 SELECT g.track, g.k + 1, CASE WHEN len(list_filter(g.picked, lambda p: abs(p - c.i) < 8)) = 0 THEN list_append(g.picked, c.i) ELSE g.picked END FROM g JOIN c ON c.track = g.track AND c.k = g.k + 1)
SELECT track, unnest(picked) AS i FROM (SELECT track, arg_max(picked, k) AS picked FROM g GROUP BY track)""")
def peak_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = local_peaks(samples(spark, sf_dir), "x", ["track"], ["i"], F.lit(40.0))
    return spaced(found, "x", "i", ["track"], 8)


ASOF_SQL = "WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = table(spark, sf_dir, "events")
    left = ev.where("event_type = 'click'").select("user_id", "ts", "event_id")
    return left, ev.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("v"))


@query(f"{ASOF_SQL} SELECT a.event_id, b.v FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return asof(left, right, ["user_id"], "ts", ["v"]).select("event_id", "v")


@query(f"""{ASOF_SQL}, p AS (SELECT a.event_id, a.ts, b.v, b.ts AS t FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts),
n AS (SELECT a.event_id, b.v, b.ts AS t FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts <= b.ts)
SELECT p.event_id, CASE WHEN n.t IS NULL OR (p.t IS NOT NULL AND p.ts - p.t <= n.t - p.ts) THEN p.v ELSE n.v END AS v FROM p JOIN n USING (event_id)""")
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    right = right.withColumn("t", F.col("ts"))
    both = asof(left, right.select("user_id", "ts", F.struct("t", "v").alias("prev")), ["user_id"], "ts", ["prev"])
    both = asof(both, right.select("user_id", "ts", F.struct("t", "v").alias("next")), ["user_id"], "ts", ["next"], forward=True)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    back, ahead = micros(F.col("ts")) - micros(F.col("prev.t")), micros(F.col("next.t")) - micros(F.col("ts"))
    before = F.col("next.t").isNull() | (F.col("prev.t").isNotNull() & (back <= ahead))
    return both.select("event_id", F.when(before, F.col("prev.v")).otherwise(F.col("next.v")).alias("v"))


@query("""SELECT o_orderkey, count(event_id) AS n, round(coalesce(sum(value), 0), 4) AS total FROM
(SELECT o_orderkey, o_custkey, date_trunc('day', o_orderdate) AS d FROM orders) o LEFT JOIN
(SELECT event_id, user_id, value, extract(day FROM ts) AS dom FROM events) e ON e.user_id = o_custkey AND e.dom >= extract(day FROM d) AND e.dom < extract(day FROM d) + 3 GROUP BY o_orderkey""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join made an equi join: every order stands for each of the days its interval covers."""
    day = F.dayofmonth("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.explode(F.sequence(day, day + 2)).alias("dom"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.dayofmonth("ts").alias("dom"))
    joined = o.join(e, ["user_id", "dom"], "left")
    return joined.groupBy("o_orderkey").agg(F.count("event_id").alias("n"), r(F.coalesce(F.sum("value"), F.lit(0.0))).alias("total"))


@query(f"""WITH {SAMPLES}, g AS (SELECT track, max(i) + 1 AS n FROM samples GROUP BY track), t AS (SELECT track, unnest(range(0, 2 * n - 1)) AS k FROM g)
SELECT t.track, k, round(CASE WHEN k % 2 = 0 THEN a.x ELSE (a.x + b.x) / 2 END, 6) AS y FROM t JOIN samples a ON a.track = t.track AND a.i = k // 2 LEFT JOIN samples b ON b.track = t.track AND b.i = k // 2 + 1""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice as many samples by interpolation between each sample and the next."""
    nxt = F.lead("x").over(Window.partitionBy("track").orderBy("i"))
    steps = F.when(F.col("nxt").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    s = samples(spark, sf_dir).withColumn("nxt", nxt).withColumn("f", F.explode(steps))
    y = F.when(F.col("f") == 0, F.col("x")).otherwise((F.col("x") + F.col("nxt")) / 2)
    return s.select("track", (2 * F.col("i") + F.col("f")).alias("k"), r(y, 6).alias("y"))


@query(f"WITH {SAMPLES} SELECT track, i, event_id FROM samples QUALIFY row_number() OVER (PARTITION BY track ORDER BY i DESC) <= 20")
def tail_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(samples(spark, sf_dir), ["track"], [F.desc("i")], 20).select("track", "i", "event_id")


@query(f"""WITH {SAMPLES}, w AS (SELECT track, i, list_sort(list(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) AS l FROM samples)
SELECT track, i, l[len(l) // 2 + 1] AS med FROM w""")
def median_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("track", "i", F.collect_list("x").over(frame(["track"], ["i"], -11, 0)).alias("l")).select("track", "i", upper_median(F.col("l")).alias("med"))


@query(f"""WITH {SAMPLES}, t AS (SELECT track, i, x, i + k AS j, exp(-0.5 * pow(k / 2.0, 2)) AS w FROM samples, (SELECT unnest(range(-3, 4)) AS k)),
a AS (SELECT track, j, sum(w * x) AS wx, sum(w) AS w FROM t GROUP BY 1, 2) SELECT s.track, s.i, round(wx / w, 4) AS y FROM samples s JOIN a ON a.track = s.track AND a.j = s.i""")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel of seven lags and leads in one window, renormalised at the ends."""
    line = Window.partitionBy("track").orderBy("i")
    near = {k: F.lag("x", k).over(line) if k >= 0 else F.lead("x", -k).over(line) for k in range(-3, 4)}
    weight = {k: F.exp(F.lit(-0.5 * (k / 2.0) ** 2)) for k in near}
    num = sum(F.coalesce(weight[k] * near[k], F.lit(0.0)) for k in near)
    den = sum(F.when(near[k].isNotNull(), weight[k]).otherwise(0.0) for k in near)
    return samples(spark, sf_dir).select("track", "i", r(num / den).alias("y"))


@query(f"""WITH {SAMPLES}, q AS (SELECT track, i, x, i // 24 AS bin, count(*) OVER (PARTITION BY track) AS n FROM samples)
SELECT track, CAST(bin AS BIGINT) AS bin, greatest(0, max(x)) AS hi, least(0, min(x)) AS lo, round(sqrt(avg(x * x)), 4) AS rms FROM q WHERE i < 24 * (n // 24) GROUP BY track, bin""")
def waveform_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.floor(F.count(F.lit(1)).over(Window.partitionBy("track")) / 24) * 24
    s = samples(spark, sf_dir).withColumn("_n", whole).where(F.col("i") < F.col("_n"))
    bins = s.groupBy("track", F.floor(F.col("i") / 24).cast("long").alias("bin"))
    return bins.agg(F.greatest(F.lit(0.0), F.max("x")).alias("hi"), F.least(F.lit(0.0), F.min("x")).alias("lo"), r(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("rms"))


@query(f"WITH {SAMPLES}, m AS (SELECT track, i % 4 AS phase, avg(x) AS m FROM samples GROUP BY 1, 2) SELECT track, CAST(phase AS BIGINT) AS phase, round(m, 7) AS m FROM m QUALIFY row_number() OVER (PARTITION BY track ORDER BY m DESC, phase) = 1")
def phase_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = samples(spark, sf_dir).groupBy("track", F.pmod("i", F.lit(4)).cast("long").alias("phase")).agg(F.avg("x").alias("m"))
    return top(by, ["track"], [F.desc("m"), F.asc("phase")]).select("track", "phase", r(F.col("m"), 7).alias("m"))


@query(f"""WITH {SAMPLES}, a AS (SELECT track, count(*) AS n, kurtosis_pop(x) + 3 AS k, regr_slope(x, i) AS slope FROM samples GROUP BY track)
SELECT track, round(k, 4) AS kurtosis, round(slope, 4) + 0.0 AS slope FROM a WHERE n >= 8""")
def kurtosis_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = samples(spark, sf_dir).groupBy("track").agg(F.count(F.lit(1)).alias("n"), (F.kurtosis("x") + 3).alias("k"), F.regr_slope("x", "i").alias("slope"))
    return a.where("n >= 8").select("track", r(F.col("k")).alias("kurtosis"), r(F.col("slope")).alias("slope"))


@query("""WITH v AS (SELECT value AS x FROM events), c AS (SELECT k, l[k] AS t FROM (SELECT quantile_cont(x, [z / 60.0 for z in range(1, 60)]) AS l FROM v), (SELECT unnest(range(1, 60)) AS k)),
s AS (SELECT k, t, count(*) AS n, sum(x) AS sx, count(*) FILTER (WHERE x <= t) AS n0, sum(x) FILTER (WHERE x <= t) AS s0 FROM v, c GROUP BY 1, 2)
SELECT round(t, 4) AS threshold FROM s WHERE n0 < n ORDER BY (n0 / n) * (1 - n0 / n) * pow(s0 / n0 - (sx - s0) / (n - n0), 2) DESC, k LIMIT 1""")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold of largest between-class variance among 59 exact quantiles of value, the only rows that are broadcast."""
    v = table(spark, sf_dir, "events").select(F.col("value").alias("x"))
    tests = exact_quantiles(v, "x", [k / 60 for k in range(1, 60)])
    cuts = tests.agg(F.array_sort(F.collect_list("t")).alias("t"))
    above = F.size(F.filter("t", lambda c: c < F.col("x")))
    hist = v.crossJoin(F.broadcast(cuts)).groupBy(above.alias("above")).agg(F.count(F.lit(1)).alias("m"), F.sum("x").alias("s"))
    whole = Window.partitionBy(F.lit(0))
    hist = hist.withColumn("total", F.sum("s").over(whole))
    low = tests.join(F.broadcast(hist), F.col("above") < F.col("k")).groupBy("k", "t", "n").agg(F.sum("m").alias("n0"), F.sum("s").alias("s0"), F.max("total").alias("total"))
    w0 = F.col("n0") / F.col("n")
    m0, m1 = F.col("s0") / F.col("n0"), (F.col("total") - F.col("s0")) / (F.col("n") - F.col("n0"))
    return low.where("n0 < n").select("t", (w0 * (1 - w0) * (m0 - m1) * (m0 - m1)).alias("v"), "k").orderBy(F.desc("v"), "k").limit(1).select(r(F.col("t")).alias("threshold"))


@query("""SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"))
    return w.select("user_id", F.col("w.start").alias("start"), "n", "total")


@query("""SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts) - INTERVAL 2 HOUR]) AS start FROM events) GROUP BY 1, 2""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"))
    return w.select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s DESC ROWS UNBOUNDED PRECEDING) AS id FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY user_id, id""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"))
    return w.select("user_id", "start", "n", "total")


@query(f"""WITH {SAMPLES}, n AS (SELECT track, i, x, CAST(floor(x) AS BIGINT) % 12 AS pc FROM samples)
SELECT track, CAST(pc AS BIGINT) AS pc, round(sum(least(x / 50, 1.5)), 4) AS weight, count(*) AS n FROM n GROUP BY 1, 2""")
def pitch_class_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    pc = F.pmod(F.floor("x"), F.lit(12)).cast("long")
    return samples(spark, sf_dir).groupBy("track", pc.alias("pc")).agg(r(F.sum(F.least(F.col("x") / 50, F.lit(1.5)))).alias("weight"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SAMPLES}, p AS (SELECT track, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.95) AS hi FROM samples GROUP BY track)
SELECT track, i, round(CASE WHEN hi > lo THEN least(1, greatest(0, (x - lo) / (hi - lo))) ELSE 0 END, 4) + 0.0 AS y FROM samples JOIN p USING (track)""")
def relnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    p = s.groupBy("track").agg(F.percentile("x", F.lit(0.1)).alias("lo"), F.percentile("x", F.lit(0.95)).alias("hi"))
    y = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))))).otherwise(0.0)
    return s.join(p, "track").select("track", "i", r(y).alias("y"))


@query(f"""WITH {SAMPLES}, m AS (SELECT track, max(x) AS hi FROM samples GROUP BY track)
SELECT track, i, x, CASE WHEN x >= 20 THEN round(69 + 12 * log2(x / 440), 4) END AS note, x >= hi / 2 AS kept FROM samples JOIN m USING (track) WHERE i < 50""")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix limit, voiced predicate (NULL when unvoiced) and a gate relative to the track's highest value."""
    hi = F.max("x").over(Window.partitionBy("track"))
    note = F.when(F.col("x") >= 20, r(69 + 12 * F.log2(F.col("x") / 440)))
    return samples(spark, sf_dir).select("track", "i", "x", note.alias("note"), (F.col("x") >= hi / 2).alias("kept")).where("i < 50")


@query(f"""WITH {SAMPLES}, m AS (SELECT track, max(x) AS hi FROM samples GROUP BY track)
SELECT track, i, x, CASE WHEN x >= 20 THEN round(69 + 12 * log2(x / 440), 4) END AS note, x >= hi / 2 AS kept FROM samples JOIN m USING (track)""")
def sample_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voiced predicate and the relative gate of `gates` for every sample, without its prefix."""
    hi = F.max("x").over(Window.partitionBy("track"))
    note = F.when(F.col("x") >= 20, r(69 + 12 * F.log2(F.col("x") / 440)))
    return samples(spark, sf_dir).select("track", "i", "x", note.alias("note"), (F.col("x") >= hi / 2).alias("kept"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
b(user_id, k, event_id, t, tokens, ok) AS (SELECT user_id, k, event_id, t, CAST(2.0 AS DOUBLE), true FROM e WHERE k = 1 UNION ALL
 SELECT e.user_id, e.k, e.event_id, e.t, CASE WHEN least(3.0, b.tokens + (e.t - b.t) / 36000) >= 1 THEN least(3.0, b.tokens + (e.t - b.t) / 36000) - 1 ELSE least(3.0, b.tokens + (e.t - b.t) / 36000) END,
 least(3.0, b.tokens + (e.t - b.t) / 36000) >= 1 FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)
SELECT event_id, ok, round(tokens, 4) AS tokens FROM b""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission per user: 1 token in 10 hours, at most 3; denied calls take none. Each call needs the one before, so
    the calls run sorted through the tasks, which hold one batch and the state of one user."""
    calls = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, last, tokens = object(), 0, 3.0
        for b in batches:
            ok, left = [], []
            for who, us in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = min(3.0, tokens + (us / 1e6 - last / 1e6) / 36000) if who == user else 3.0
                ok.append(tokens >= 1)
                tokens -= tokens >= 1
                left.append(tokens)
                user, last = who, us
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(ok, pa.bool_()), pa.array(left, pa.float64())], names=["event_id", "ok", "tokens"])

    out = calls.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id").mapInArrow(run, "event_id long, ok boolean, tokens double")
    return out.select("event_id", "ok", r(F.col("tokens")).alias("tokens"))


@query(f"""WITH {SAMPLES}, b AS (SELECT track, i, x, lead(x) OVER (PARTITION BY track ORDER BY i) - x AS step FROM samples), c AS (SELECT track, i, avg(CASE WHEN step > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS up, x FROM b)
SELECT track, i FROM c QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(up, 6) DESC, x DESC, i) = 1""")
def boundary_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rises = F.when(F.lead("x").over(Window.partitionBy("track").orderBy("i")) > F.col("x"), 1.0).otherwise(0.0)
    c = samples(spark, sf_dir).withColumn("up1", rises).withColumn("up", F.round(F.avg("up1").over(frame(["track"], ["i"], -3, 3)), 6))
    return top(c, ["track"], [F.desc("up"), F.desc("x"), F.asc("i")]).select("track", "i")


@query(f"""WITH {SAMPLES}, n AS (SELECT track, max(i) + 1 AS n FROM samples GROUP BY track), k AS (SELECT track, n, least(24, greatest(1, n // 5)) AS m FROM n),
s AS (SELECT track, unnest(range(0, m)) AS w, n, m FROM k), o AS (SELECT track, w, CAST(floor(w * (n - least(n, 5)) / greatest(1, m - 1)) AS BIGINT) AS start FROM s)
SELECT o.track, o.w, o.start, round(avg(x), 4) AS prob FROM o JOIN samples s ON s.track = o.track AND s.i >= o.start AND s.i < o.start + 5 GROUP BY 1, 2, 3""")
def window_mean_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 24 evenly spread windows of 5 samples per track, each joined by the samples it covers."""
    s = samples(spark, sf_dir)
    n = s.groupBy("track").agg((F.max("i") + 1).alias("n")).withColumn("m", F.least(F.lit(24), F.greatest(F.lit(1), F.floor(F.col("n") / 5))))
    w = n.withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    w = w.withColumn("start", F.floor(F.col("w") * (F.col("n") - F.least("n", F.lit(5))) / F.greatest(F.lit(1), F.col("m") - 1)))
    spots = w.select("track", "w", "start", F.explode(F.sequence(F.col("start"), F.col("start") + 4)).alias("i"))
    return spots.join(s, ["track", "i"]).groupBy("track", "w", "start").agg(r(F.avg("x")).alias("prob"))


@query("""WITH j AS (SELECT event_id AS id, user_id, event_type AS status, ts FROM events), m AS (SELECT max(ts) AS now FROM j)
SELECT user_id, CAST(sum(CASE WHEN status IN ('view', 'click') THEN 1 ELSE 0 END) AS BIGINT) AS active, CAST(sum(CASE WHEN status NOT IN ('view', 'click') AND now - ts > INTERVAL 6 HOUR THEN 1 ELSE 0 END) AS BIGINT) AS expired FROM j, m GROUP BY user_id""")
def job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), "ts")
    now = j.agg(F.max("ts").alias("now"))
    active = F.col("status").isin("view", "click")
    old = ~active & (F.col("now") - F.col("ts") > F.expr("interval 6 hours"))
    return j.crossJoin(F.broadcast(now)).groupBy("user_id").agg(F.count_if(active).alias("active"), F.count_if(old).alias("expired"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AND CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 50 AS valid FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long").getField("k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(k.between(0, 50), F.lit(False)).alias("valid"))


@query(f"""WITH {SAMPLES}, t AS (SELECT track, i, event_type AS c, lag(event_type) OVER v AS b, lag(event_type, 2) OVER v AS a, count(*) OVER (PARTITION BY track) AS n FROM samples WINDOW v AS (PARTITION BY track ORDER BY i)),
l AS (SELECT track, b AS a, c AS b FROM t WHERE i = n - 1), m AS (SELECT t.track, t.c, sum(1 + t.i / t.n) AS w FROM t JOIN l ON l.track = t.track AND l.a = t.a AND l.b = t.b GROUP BY 1, 2)
SELECT track, c AS next, round(w / sum(w) OVER (PARTITION BY track), 4) AS p, CAST(row_number() OVER (PARTITION BY track ORDER BY round(w, 6) DESC, c) AS BIGINT) AS place FROM m QUALIFY place <= 3""")
def motif_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What followed earlier occurrences of each track's last two symbols, later ones weighing more."""
    line = Window.partitionBy("track").orderBy("i")
    t = samples(spark, sf_dir).select("track", "i", F.col("event_type").alias("c"), F.lag("event_type").over(line).alias("b"), F.lag("event_type", 2).over(line).alias("a"), F.count(F.lit(1)).over(Window.partitionBy("track")).alias("n"))
    last = t.where("i = n - 1").select("track", F.col("b").alias("a"), F.col("c").alias("b"))
    m = t.join(last, ["track", "a", "b"]).groupBy("track", "c").agg(F.sum(1 + F.col("i") / F.col("n")).alias("w"))
    p = F.col("w") / F.sum("w").over(Window.partitionBy("track"))
    ranked = m.withColumn("p", r(p)).withColumn("w6", F.round("w", 6))
    return top(ranked, ["track"], [F.desc("w6"), F.asc("c")], 3, "place").select("track", F.col("c").alias("next"), "p", F.col("place").cast("long").alias("place"))
