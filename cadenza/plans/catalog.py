"""Ranges, series, edits, prompts and dimensions that stand beside the other families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, lcg, upper_median
from ..operators.windows import frame, moving_average, top
from ..sources.dimensions import BRIEFS, CAMELOT, GENRES, KEYS, PLANS, TONE_BANDS, VERSIONS, values
from ..sources.tables import SAMPLES, passing, samples, table
from ..sources.wave import read_waves, write_parts
from . import scoring
from .relational import SSM, UNITS, ssm, units
from .scoring import BALANCE_SQL, BANDS_SQL, FEATURES, deviations, features
from .timeline import r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Pieces of an order: its line items, one behind the other by line number, as long as their quantity / 25; choruses are
# the returned ones and hooks the accepted ones.
PIECES = """pieces AS (SELECT l_orderkey AS track, l_linenumber AS line, CAST(l_linenumber AS DOUBLE) AS a, l_linenumber + l_quantity / 25 AS b, l_returnflag AS flag, l_linestatus AS cluster FROM lineitem)"""


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track"), n.alias("line"), n.cast("double").alias("a"), (n + F.col("l_quantity") / 25).alias("b"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("cluster")
    )


def _other(p: DataFrame, names: str) -> DataFrame:
    return p.select(*[F.col(c).alias(f"o_{c}") for c in names.split()])


@query(f"WITH {PIECES} SELECT track, line FROM pieces p WHERE EXISTS (SELECT 1 FROM pieces c WHERE c.track = p.track AND c.line <> p.line AND c.flag = 'R' AND c.a <= p.a AND p.b <= c.b)")
def contained_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that lie wholly in a chorus."""
    p = pieces(spark, sf_dir)
    c = _other(p.where("flag = 'R'"), "track line a b")
    return p.join(c, F.expr("o_track = track AND o_line <> line AND o_a <= a AND b <= o_b"), "left_semi").select("track", "line")


@query(f"WITH {PIECES} SELECT track, line FROM pieces p WHERE NOT EXISTS (SELECT 1 FROM pieces c WHERE c.track = p.track AND c.flag = 'R' AND c.a < p.a AND p.a < c.b)")
def free_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings that do not lie strictly inside a chorus."""
    p = pieces(spark, sf_dir)
    c = _other(p.where("flag = 'R'"), "track a b")
    return p.join(c, F.expr("o_track = track AND o_a < a AND a < o_b"), "left_anti").select("track", "line")


@query(f"WITH {PIECES} SELECT track, line FROM pieces p WHERE EXISTS (SELECT 1 FROM pieces c WHERE c.track = p.track AND c.flag = 'A' AND c.a BETWEEN p.a - 0.05 AND p.a + 3)")
def hook_soon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces at the beginning of which a hook begins, or up to three seconds later."""
    p = pieces(spark, sf_dir)
    c = _other(p.where("flag = 'A'"), "track a")
    return p.join(c, F.expr("o_track = track AND o_a BETWEEN a - 0.05 AND a + 3"), "left_semi").select("track", "line")


@query(f"WITH {PIECES}, f AS (SELECT track, min(a) AS first FROM pieces WHERE flag = 'R' GROUP BY track) SELECT p.track, line FROM pieces p JOIN f USING (track) WHERE NOT EXISTS (SELECT 1 FROM pieces c WHERE c.track = p.track AND c.cluster = p.cluster AND c.a < f.first)")
def new_after_chorus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces whose cluster has not been heard before the first chorus."""
    p = pieces(spark, sf_dir)
    first = p.groupBy("track").agg(F.min(F.when(F.col("flag") == "R", F.col("a"))).alias("first")).where("first IS NOT NULL")
    both = p.join(first, "track")
    return both.join(_other(p, "track cluster a"), F.expr("o_track = track AND o_cluster = cluster AND o_a < first"), "left_anti").select("track", "line")


@query(f"""WITH {SAMPLES}, n AS (SELECT track, i, x, count(*) OVER (PARTITION BY track) AS n FROM samples), c AS (SELECT track, i - greatest(0, (n - 60) // 2) AS f, ln(1 + x) AS v FROM n WHERE i >= greatest(0, (n - 60) // 2) AND i < greatest(0, (n - 60) // 2) + 60)
SELECT track, CAST(f AS BIGINT) AS f, round(greatest(0, coalesce(v - lag(v) OVER (PARTITION BY track ORDER BY f), 0)), 6) + 0.0 AS flux FROM c""")
def flux_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rises of the log level over the central 60 samples of each track (all, if there are fewer); the first is 0."""
    start = F.greatest(F.lit(0), F.floor((F.count(F.lit(1)).over(Window.partitionBy("track")) - 60) / 2))
    c = samples(spark, sf_dir).select("track", "i", "x", start.alias("s")).where("i >= s AND i < s + 60").select("track", (F.col("i") - F.col("s")).alias("f"), F.log1p("x").alias("v"))
    step = F.col("v") - F.lag("v").over(Window.partitionBy("track").orderBy("f"))
    return c.select("track", F.col("f").cast("long").alias("f"), r(F.greatest(F.lit(0.0), F.coalesce(step, F.lit(0.0))), 6).alias("flux"))


@query(f"""WITH {SSM}, m AS (SELECT track, a, b, list_sort(list(s) OVER (PARTITION BY track, b - a ORDER BY a ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS l FROM p) SELECT track, a, b, round(l[len(l) // 2 + 1], 6) + 0.0 AS m FROM m""")
def diagonal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of seven neighbours along each diagonal of the similarity matrix, of fewer at the ends."""
    lag = ssm(spark, sf_dir).withColumn("lag", F.col("b") - F.col("a"))
    near = F.collect_list("s").over(frame(["track", "lag"], ["a"], -3, 3))
    return lag.withColumn("l", near).select("track", "a", "b", r(upper_median(F.col("l")), 6).alias("m"))


@query("""WITH s AS (SELECT vec_id, unnest(range(0, len(embedding))) AS k, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 60)) AS db FROM embeddings)
SELECT vec_id, CAST(k AS INTEGER) AS k, round(greatest(0, db - avg(db) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)), 6) + 0.0 AS peak FROM s""")
def residual_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels above the mean of eight bins to each side: only narrow peaks are left."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform("embedding", lambda x: x.cast("double") * 60)).alias("k", "db"))
    base = moving_average(F.col("db"), ["vec_id"], ["k"], 8)
    return s.withColumn("peak", F.col("db") - base).select("vec_id", "k", r(F.greatest(F.lit(0.0), "peak"), 6).alias("peak"))


@query(f"""WITH {UNITS}, q AS (SELECT track, u, unnest(t) AS v, unnest(range(0, 24)) AS q FROM units), m AS (SELECT track, u, q, count(*) OVER b AS nb, avg(v) OVER b AS before, avg(v) OVER f AS after FROM q
 WINDOW b AS (PARTITION BY track, q ORDER BY u ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY track, q ORDER BY u ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
d AS (SELECT track, u, round(sum(pow(before - after, 2)), 6) AS d FROM m WHERE nb > 0 GROUP BY 1, 2) SELECT track, u, d AS change FROM d QUALIFY row_number() OVER (PARTITION BY track ORDER BY d DESC, u) = 1""")
def vector_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit where the mean timbre of four units before differs most from that of the four after; the first of ties."""
    q = units(spark, sf_dir).select("track", "u", F.posexplode("t").alias("q", "v"))
    before, after = (F.avg("v").over(frame(["track", "q"], ["u"], lo, hi)) for lo, hi in ((-4, -1), (0, 3)))
    m = q.withColumns({"before": before, "after": after}).where("before IS NOT NULL")
    d = m.groupBy("track", "u").agg(F.round(F.sum((F.col("before") - F.col("after")) * (F.col("before") - F.col("after"))), 6).alias("change"))
    return top(d, ["track"], [F.desc("change"), F.asc("u")]).select("track", "u", "change")


@query(f"WITH {BALANCE_SQL}, {BANDS_SQL} SELECT vec_id, id AS zone, CAST(arg_max(band, (round(abs(d), 6), -band)) AS INTEGER) AS band FROM dev JOIN tone ON f >= blo AND f < bhi GROUP BY 1, 2")
def band_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each tone band the third-octave that deviates most from the target; the lowest of ties."""
    zones = F.broadcast(spark.createDataFrame([(b, float(lo), float(hi)) for b, lo, hi in TONE_BANDS], "zone string, lo double, hi double"))
    d = deviations(spark, sf_dir).join(zones, F.expr("f >= lo AND f < hi"))
    return d.groupBy("vec_id", "zone").agg(F.max_by("band", F.struct(F.round(F.abs("d"), 6), -F.col("band"))).cast("int").alias("band"))


@query("""WITH e AS (SELECT vec_id, unnest(range(0, 32)) AS k, unnest(list_transform(embedding[1:32], lambda x: pow(CAST(x AS DOUBLE), 2))) AS m, unnest(list_transform(embedding[33:64], lambda x: pow(CAST(x AS DOUBLE), 2))) AS s FROM embeddings)
SELECT vec_id, CAST(floor(5 * k / 32) AS INTEGER) AS band, round(sum(s) / (sum(m) + sum(s)), 6) + 0.0 AS width FROM e GROUP BY 1, 2 HAVING sum(m) + sum(s) > 1e-12""")
def width_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side channel's share of the power in each of five bands; the first half of a vector is the middle."""
    square = lambda x: x.cast("double") * x.cast("double")
    both = F.arrays_zip(F.transform(F.slice("embedding", 1, 32), square).alias("m"), F.transform(F.slice("embedding", 33, 32), square).alias("s"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(both).alias("k", "x")).select("vec_id", F.floor(5 * F.col("k") / 32).cast("int").alias("band"), "x.m", "x.s")
    by = e.groupBy("vec_id", "band").agg(F.sum("m").alias("m"), F.sum("s").alias("s")).where("m + s > 1e-12")
    return by.select("vec_id", "band", r(F.col("s") / (F.col("m") + F.col("s")), 6).alias("width"))


@query(f"SELECT vec_id, round(avg(score), 4) AS mean FROM ({scoring.ORACLES['device_score']}) WHERE device <> 'studio' GROUP BY vec_id")
def device_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.device_score(spark, sf_dir).where("device <> 'studio'").groupBy("vec_id").agg(r(F.avg("score")).alias("mean"))


@query(f"""WITH {FEATURES} SELECT track, round(least(1.0, greatest(0.0, 0.45 * least(1.0, dance * 1.6) + 0.35 * least(1.0, greatest(0.0, (spread * 3 - 1) / 2))
 + 0.2 * greatest(exp(-0.5 * pow(log2(bpm / 115) / 0.35, 2)), 0.8 * exp(-0.5 * pow(log2(bpm / 2 / 115) / 0.35, 2))))), 6) AS danceability FROM feat""")
def danceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the pulse's clarity, of the beats' salience (three times the spread here) and of the tempo."""
    fit = lambda bpm: F.exp(-0.5 * F.pow(F.log2(bpm / 115) / 0.35, F.lit(2)))
    s = 0.45 * clamp(F.col("dance") * 1.6) + 0.35 * clamp((F.col("spread") * 3 - 1) / 2) + 0.2 * F.greatest(fit(F.col("bpm")), 0.8 * fit(F.col("bpm") / 2))
    return features(spark, sf_dir).select("track", r(clamp(s), 6).alias("danceability"))


@query(f"WITH {SAMPLES} SELECT track, round(avg(x) FILTER (WHERE i % 4 = 0) / avg(x), 6) AS salience FROM samples GROUP BY track HAVING avg(x) > 0")
def beat_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean level at the beats (every fourth sample) over the mean of all."""
    by = samples(spark, sf_dir).groupBy("track").agg(F.avg(F.when(F.col("i") % 4 == 0, F.col("x"))).alias("at"), F.avg("x").alias("mean")).where("mean > 0")
    return by.select("track", r(F.col("at") / F.col("mean"), 6).alias("salience"))


@query(f"""WITH {SAMPLES}, b AS (SELECT track, count(*) AS n, regr_slope(epoch_us(ts) / 3.6e9, i) AS s, (max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9 / (count(*) - 1) AS even FROM samples GROUP BY track HAVING count(*) > 1)
SELECT track, round(CASE WHEN n >= 8 AND s > 0 AND abs(even / s - 1) < 0.08 THEN 60 / s ELSE 60 / even END, 5) AS bpm FROM b WHERE even > 0""")
def beat_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken as beats: the rate of the least-squares slope where there are eight or more and it is within 8 % of
    the rate from first to last, else that rate. Hours stand for seconds."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    own = samples(spark, sf_dir).withColumn("t", t).groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("t", "i").alias("s"), (F.max("t") - F.min("t")).alias("span"))
    b = own.where("n > 1 AND span > 0").withColumn("even", F.col("span") / (F.col("n") - 1))
    good = (F.col("n") >= 8) & (F.col("s") > 0) & (F.abs(F.col("even") / F.col("s") - 1) < 0.08)
    return b.select("track", r(60 / F.when(good, F.col("s")).otherwise(F.col("even")), 5).alias("bpm"))


def _bars_sql(kind: str) -> str:
    return f"CASE {kind} WHEN 'chorus' THEN cb WHEN 'double' THEN 2 * cb WHEN 'verse' THEN vb WHEN 'half' THEN greatest(8, vb // 2) WHEN 'short' THEN greatest(8, vb - 4) ELSE CAST({kind} AS INTEGER) END"


_PLAN_ROWS = [(p, k, name, kind) for p, parts in PLANS.items() for k, (name, kind) in enumerate(parts)]
_PLAN_SQL = values(_PLAN_ROWS, ["plan", "idx", "name", "kind"], "pl") + ", " + values([(k, g[0], g[5], g[6]) for k, g in enumerate(GENRES)], ["gk", "genre", "vb", "cb"], "ge")


@query(f"""WITH {FEATURES}, {_PLAN_SQL}, x AS (SELECT track, genre, plan, idx, name, {_bars_sql('kind')} AS bars, 240.0 / CASE WHEN bpm < 90 AND genre IN ('rap', 'drill') THEN bpm * 2 ELSE bpm END AS bar FROM feat JOIN ge ON gk = track % 8 JOIN pl ON plan <> 'edm' OR genre = 'edm')
SELECT track, plan, CAST(idx AS INTEGER) AS idx, name, CAST(bars AS INTEGER) AS bars, round((sum(bars) OVER (PARTITION BY track, plan ORDER BY idx) - bars) * bar, 4) AS start FROM x""")
def blueprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines of the plans for each track's genre (of the tracks' numbers, in turn): bars and start of every part."""
    g = F.broadcast(spark.createDataFrame([(k, x[0], x[5], x[6]) for k, x in enumerate(GENRES)], "gk int, genre string, vb int, cb int"))
    p = F.broadcast(spark.createDataFrame(_PLAN_ROWS, "plan string, idx int, name string, kind string"))
    f = features(spark, sf_dir).select("track", "bpm", (F.col("track") % 8).cast("int").alias("gk")).join(g, "gk")
    x = f.join(p, (F.col("plan") != "edm") | (F.col("genre") == "edm"))
    kind, vb, cb = F.col("kind"), F.col("vb"), F.col("cb")
    bars = F.when(kind == "chorus", cb).when(kind == "double", 2 * cb).when(kind == "verse", vb).when(kind == "half", F.greatest(F.lit(8), F.floor(vb / 2))).when(kind == "short", F.greatest(F.lit(8), vb - 4)).otherwise(kind.try_cast("int"))
    fast = F.when((F.col("bpm") < 90) & F.col("genre").isin("rap", "drill"), F.col("bpm") * 2).otherwise(F.col("bpm"))
    x = x.withColumns({"bars": bars.cast("int"), "bar": 240.0 / fast})
    start = (F.sum("bars").over(Window.partitionBy("track", "plan").orderBy("idx")) - F.col("bars")) * F.col("bar")
    return x.select("track", "plan", "idx", "name", "bars", r(start).alias("start"))


@query("""WITH u AS (SELECT n_nationkey AS k, upper(n_name) AS name FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 99, 'NEW') SELECT CAST(k AS INTEGER) AS k, name, true AS fresh FROM u UNION ALL SELECT n_nationkey, n_name, false FROM nation WHERE n_nationkey NOT IN (SELECT k FROM u)""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by key with those of the update in their place, new keys added."""
    n = table(spark, sf_dir, "nation")
    update = n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("k"), F.upper("n_name").alias("name")).unionByName(spark.createDataFrame([(99, "NEW")], "k int, name string"))
    rest = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).join(update, "k", "left_anti")
    return update.withColumn("fresh", F.lit(True)).unionByName(rest.withColumn("fresh", F.lit(False)))


@query("""SELECT l_orderkey AS track, l_linenumber AS line, CASE WHEN l_linenumber % 2 = 0 AND l_orderkey % 5 <> 0 THEN 'edited' ELSE l_returnflag END AS kind, CASE WHEN l_linenumber % 2 = 0 AND l_orderkey % 5 <> 0 THEN true ELSE false END AS edited FROM lineitem""")
def undo_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected kinds overlaid by edits (every second line), of which those of every fifth track are undone."""
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("found"))
    edits = found.where("line % 2 = 0").select("track", "line", F.lit("edited").alias("edit")).distinct()
    undone = found.where("track % 5 = 0").select("track").distinct()
    kept = edits.join(undone, "track", "left_anti")
    return found.join(kept, ["track", "line"], "left").select("track", "line", F.coalesce("edit", "found").alias("kind"), F.col("edit").isNotNull().alias("edited"))


_STATUS = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'running' ELSE 'queued' END"


@query(f"""SELECT event_id, to_json({{'id': event_id, 'kind': event_type, 'status': {_STATUS}, 'progress': CAST(floor(value) AS BIGINT), 'result': CASE WHEN event_type = 'purchase' THEN {{'user': user_id}} END}})::VARCHAR AS job FROM events WHERE event_id % 7 <> 0""")
def job_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as JSON for the outside, the result only of those that are done; every seventh was deleted by its key."""
    e = table(spark, sf_dir, "events")
    gone = e.where("event_id % 7 = 0").select("event_id")
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "done").when(kind == "view", "running").otherwise("queued")
    job = F.struct(F.col("event_id").alias("id"), kind.alias("kind"), status.alias("status"), F.floor("value").alias("progress"), F.when(kind == "purchase", F.struct(F.col("user_id").alias("user"))).alias("result"))
    return e.join(gone, "event_id", "left_anti").select("event_id", F.to_json(job, {"ignoreNullFields": "false"}).alias("job"))


@query(f"""WITH {FEATURES}, {values([(k, g[1]) for k, g in enumerate(GENRES)], ["gk", "family"], "ge")} SELECT track, concat_ws(', ', family, CASE WHEN track % 3 = 0 THEN 'live' END, CASE WHEN track % 4 > 0 THEN bpm || ' BPM' END, CASE WHEN track % 2 = 0 THEN 'in Am' END, 'clear and loud, ready for release') AS prompt,
 round(greatest(0.1, least(0.95, 1.0 - dance)), 2) AS strength FROM feat JOIN ge ON gk = track % 8""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style prompts with the parts that are known, and the cover strength of an intensity."""
    g = F.broadcast(spark.createDataFrame([(k, x[1]) for k, x in enumerate(GENRES)], "gk int, family string"))
    t = F.col("track")
    f = features(spark, sf_dir).withColumn("gk", (t % 8).cast("int")).join(g, "gk")
    parts = [F.col("family"), F.when(t % 3 == 0, "live"), F.when(t % 4 > 0, F.concat(F.col("bpm").cast("string"), F.lit(" BPM"))), F.when(t % 2 == 0, "in Am"), F.lit("clear and loud, ready for release")]
    return f.select("track", F.concat_ws(", ", *parts).alias("prompt"), r(F.greatest(F.lit(0.1), F.least(F.lit(0.95), 1.0 - F.col("dance"))), 2).alias("strength"))


_BRIEF_SQL = values([(k, s, b.replace("'", "''")) for k, (s, b) in enumerate(BRIEFS)], ["k", "style", "brief"], "br")


@query(f"""WITH {_BRIEF_SQL} SELECT c_custkey, count(*) AS n, string_agg(CAST(o AS VARCHAR) || '. ' || brief, chr(10) ORDER BY o) AS briefs FROM (SELECT c_custkey, brief, row_number() OVER (PARTITION BY c_custkey ORDER BY k) AS o FROM customer JOIN br ON (c_custkey + k) % 3 = 0) GROUP BY 1""")
def numbered_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen styles' briefs, numbered from 1 in the dimension's order."""
    b = F.broadcast(spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(BRIEFS)], "k int, style string, brief string"))
    chosen = table(spark, sf_dir, "customer").select("c_custkey").join(b, (F.col("c_custkey") + F.col("k")) % 3 == 0)
    listed = chosen.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("k", "brief"))).alias("x"))
    return listed.select("c_custkey", F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s.brief)), "\n").alias("briefs"))


@query(f"""WITH {values([(k, i, float(a), float(b), float(s), float(v)) for k, (i, a, b, s, v) in enumerate(VERSIONS)], ['k', 'id', 'lo', 'hi', 'step', 'init'], 'v')}
SELECT p_partkey, id, CAST(round((hi - lo) / step) AS BIGINT) + 1 AS n_steps, CAST(round((init - lo) / step) AS BIGINT) AS place, round(least(hi, lo + p_size % (CAST(round((hi - lo) / step) AS BIGINT) + 1) * step), 4) AS chosen FROM part JOIN v ON k = p_partkey % {len(VERSIONS)}""")
def version_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's version: how many values its parameter has, the place of the initial one, and the one that the size names."""
    v = F.broadcast(spark.createDataFrame([(k, i, float(a), float(b), float(s), float(x)) for k, (i, a, b, s, x) in enumerate(VERSIONS)], "k int, id string, lo double, hi double, step double, init double"))
    steps = lambda c: F.round(c / F.col("step")).cast("long")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % len(VERSIONS)).cast("int").alias("k")).join(v, "k").withColumn("n_steps", steps(F.col("hi") - F.col("lo")) + 1)
    chosen = F.least(F.col("hi"), F.col("lo") + F.col("p_size") % F.col("n_steps") * F.col("step"))
    return p.select("p_partkey", "id", "n_steps", steps(F.col("init") - F.col("lo")).alias("place"), r(chosen).alias("chosen"))


_KEY_ROWS = [(t, m, f"{n} {m}", n + ("m" if m == "minor" else ""), CAMELOT[m][t]) for m in ("major", "minor") for t, n in enumerate(KEYS)]


@query(f"WITH {values(_KEY_ROWS, ['tonic', 'mode', 'name', 'short', 'camelot'], 'ks')} SELECT event_id, name, short, camelot FROM events JOIN ks ON tonic = CAST(floor(value) AS BIGINT) % 12 AND mode = CASE WHEN event_id % 2 = 0 THEN 'major' ELSE 'minor' END")
def key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and wheel labels of keys, by tonic and mode."""
    k = F.broadcast(spark.createDataFrame(_KEY_ROWS, "tonic int, mode string, name string, short string, camelot string"))
    e = table(spark, sf_dir, "events").select("event_id", F.pmod(F.floor("value"), F.lit(12)).cast("int").alias("tonic"), F.when(F.col("event_id") % 2 == 0, "major").otherwise("minor").alias("mode"))
    return e.join(k, ["tonic", "mode"]).select("event_id", "name", "short", "camelot")


@query("SELECT vec_id, CAST(c AS INTEGER) AS c, round(list_sum([embedding[n + 1]::DOUBLE * cos(pi() / 24 * (n + 0.5) * c) for n in range(0, 24)]), 5) + 0.0 AS v FROM embeddings, (SELECT unnest(range(1, 13)) AS c)")
def cepstrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine coefficients 1 to 12 of the 24 bands."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 24).alias("t"), F.explode(F.array(*map(F.lit, range(1, 13)))).alias("c"))
    v = F.aggregate(F.transform("t", lambda x, n: x.cast("double") * F.cos(F.lit(3.141592653589793 / 24) * (n + 0.5) * F.col("c"))), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", "c", r(v, 5).alias("v"))


@query("""WITH RECURSIVE g(i, s) AS (SELECT 1, CAST(22222 AS HUGEINT) * 1664525 % 4294967296 + 1013904223 UNION ALL SELECT i + 1, (s % 4294967296 * 1664525 + 1013904223) % 4294967296 FROM g WHERE i < (SELECT 2 * max(event_id) + 2 FROM events)),
n AS (SELECT i, CAST(s % 4294967296 AS BIGINT) AS s FROM g), t AS (SELECT (a.i - 1) // 2 AS i, (a.s - b.s) / 4294967296 AS tpdf FROM n a JOIN n b ON b.i = a.i + 1 WHERE a.i % 2 = 1)
SELECT event_id, round(tpdf, 9) + 0.0 AS tpdf, CAST(floor(round(least(1, value / 500) * 32767 + tpdf, 6) + 0.5) AS BIGINT) AS pcm FROM events JOIN t ON i = event_id""")
def dither_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value as a sample of 16 bits with triangular noise, from a congruential generator whose n-th number is a
    closed form of n (here the event's number): every sample is made on its own, without the ones before."""
    first, second = (lcg(2 * F.col("event_id") + k) for k in (1, 2))
    e = table(spark, sf_dir, "events").select("event_id", "value", ((first - second) / F.lit(2.0**32)).alias("tpdf"))
    pcm = F.floor(F.round(F.least(F.lit(1.0), F.col("value") / 500) * 32767 + F.col("tpdf"), 6) + 0.5)
    return e.select("event_id", r(F.col("tpdf"), 9).alias("tpdf"), pcm.alias("pcm"))


#: Bytes of a part of a user's events: 50 samples.
PART = 144


@query(f"""WITH RECURSIVE {SAMPLES}, g(i, s) AS (SELECT 1, CAST(22222 AS HUGEINT) * 1664525 % 4294967296 + 1013904223 UNION ALL SELECT i + 1, (s % 4294967296 * 1664525 + 1013904223) % 4294967296 FROM g WHERE i < (SELECT 2 * max(i) + 2 FROM samples)),
n AS (SELECT i, CAST(s % 4294967296 AS BIGINT) AS s FROM g), t AS (SELECT (a.i - 1) // 2 AS i, (a.s - b.s) / 4294967296 AS d FROM n a JOIN n b ON b.i = a.i + 1 WHERE a.i % 2 = 1),
v AS (SELECT track, samples.i, greatest(-32768, least(32767, CAST(floor((least(1, x / 500) + d / 32768) * 32767 + 0.5) AS BIGINT))) AS v FROM samples JOIN t ON t.i = samples.i)
SELECT CAST(track AS VARCHAR) AS track, CAST(i // 50 AS BIGINT) AS part, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM v GROUP BY 1, 2""")
def speech_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as WAVE files of PART bytes at most, dithered to 16 bits, written and read again by ranges: samples
    and their sum by file."""
    path = passing(spark, "parts")
    x = samples(spark, sf_dir).select("track", "i", F.least(F.lit(1.0), F.col("x") / 500).alias("x"))
    write_parts(x, path, most_bytes=PART)
    found, _ = read_waves(spark, path)
    name = F.regexp_extract("path", r"([^/]*)\.wav$", 1)
    track, part = F.regexp_extract(name, r"^(.*)-\d+$", 1), F.regexp_extract(name, r"-(\d+)$", 1).cast("long")
    return found.groupBy(track.alias("track"), part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l") * 32768).cast("long")).alias("total"))
