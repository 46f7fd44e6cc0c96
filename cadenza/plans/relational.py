"""Joins, aggregates, set operations and vector similarity over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import dot, rotated
from ..operators.similarity import diagonal_mean, doubles, mutual_neighbours, pairs, unit
from ..operators.windows import frame, top, with_runs
from ..sources.tables import table
from .timeline import r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Key profiles of the published studies (Krumhansl and Kessler; Temperley), from the tonic up.
KK_MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
KK_MINOR = [6.33, 2.68, 3.52, 5.38, 2.6, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
T_MAJOR = [5.0, 2.0, 3.5, 2.0, 4.5, 4.0, 2.0, 4.5, 2.0, 3.5, 1.5, 4.0]
T_MINOR = [5.0, 2.0, 3.5, 4.5, 2.0, 4.0, 2.0, 4.5, 3.5, 2.0, 1.5, 4.0]

# Vectors are units of tracks of 25: timbre in components 1-24, chroma (its absolute value) in 25-36
UNITS = """units AS (SELECT vec_id // 25 AS track, vec_id % 25 AS u, label, list_transform(embedding[1:24], lambda x: CAST(x AS DOUBLE)) AS t,
 list_transform(embedding[25:36], lambda x: abs(CAST(x AS DOUBLE))) AS c FROM embeddings)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = doubles(F.col("embedding"))
    return e.select(
        F.floor(F.col("vec_id") / 25).alias("track"), F.pmod("vec_id", F.lit(25)).alias("u"), "label",
        F.slice(v, 1, 24).alias("t"), F.transform(F.slice(v, 25, 12), lambda x: F.abs(x)).alias("c"),
    )


SSM = f"""{UNITS}, p AS (SELECT a.track, a.u AS a, b.u AS b, 0.55 * list_cosine_similarity(a.c, b.c) + 0.45 * list_cosine_similarity(a.t, b.t) AS s FROM units a JOIN units b ON a.track = b.track AND a.u < b.u)"""


def ssm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of all pairs of a track's units: 0.55 of the chroma cosine and 0.45 of the timbre cosine."""
    n = units(spark, sf_dir).select("track", "u", unit(F.col("c")).alias("c"), unit(F.col("t")).alias("t"))
    s = 0.55 * dot(F.col("c_a"), F.col("c_b")) + 0.45 * dot(F.col("t_a"), F.col("t_b"))
    return pairs(n, ["track"], "u", ["c", "t"]).select("track", "a", "b", s.alias("s"))


@query(f"WITH {SSM} SELECT track, a, b, round(s, 6) + 0.0 AS s FROM p")
def ssm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ssm(spark, sf_dir).select("track", "a", "b", r(F.col("s"), 6).alias("s"))


def unit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = F.aggregate(F.zip_with("t_a", "t_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return pairs(units(spark, sf_dir), ["track"], "u", ["t"]).select("track", "a", "b", F.round(F.sqrt(square), 9).alias("d"))


DISTANCES = f"{UNITS}, d AS (SELECT a.track, a.u AS a, b.u AS b, round(list_distance(a.t, b.t), 9) AS d FROM units a JOIN units b ON a.track = b.track AND a.u < b.u)"


@query(f"WITH {DISTANCES} SELECT track, a, b, round(d, 6) AS d FROM d")
def distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_distances(spark, sf_dir).select("track", "a", "b", r(F.col("d"), 6).alias("d"))


@query(f"""WITH {DISTANCES}, e AS (SELECT track, a, b, d FROM d WHERE b - a >= 3), f AS (SELECT * FROM e UNION ALL SELECT track, b, a, d FROM e),
n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY track, a ORDER BY d, b) <= 5) SELECT x.track, x.a, x.b FROM n x JOIN n y ON x.track = y.track AND x.a = y.b AND x.b = y.a WHERE x.a < x.b""")
def mutual_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = unit_distances(spark, sf_dir).where(F.col("b") - F.col("a") >= 3)
    return mutual_neighbours(far, ["track"], 5).select("track", "a", "b")


@query(f"""WITH {SSM}, g AS (SELECT track, b - a AS lag, a, avg(s) OVER (PARTITION BY track, b - a ORDER BY a ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m FROM p WHERE b - a >= 6)
SELECT track, lag, round(max(m), 6) + 0.0 AS best FROM g GROUP BY track, lag""")
def lag_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = diagonal_mean(ssm(spark, sf_dir).where(F.col("b") - F.col("a") >= 6), ["track"], "s", 4)
    return m.groupBy("track", "lag").agg(r(F.max("mean"), 6).alias("best"))


@query(f"""WITH {SSM}, q AS (SELECT track, greatest(0.62, quantile_cont(s, 0.88)) AS th FROM p GROUP BY track), f AS (SELECT track, a, b, s FROM p UNION ALL SELECT track, b, a, s FROM p),
l AS (SELECT *, lag(s) OVER (PARTITION BY track, a ORDER BY b) AS x, lead(s) OVER (PARTITION BY track, a ORDER BY b) AS y FROM f)
SELECT track, a AS u, count(*) AS n, round(avg(s), 6) AS mean FROM l JOIN q USING (track) WHERE s >= th * 0.5 AND s >= x AND s > y GROUP BY 1, 2""")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ssm(spark, sf_dir)
    th = p.groupBy("track").agg(F.greatest(F.lit(0.62), F.percentile("s", F.lit(0.88))).alias("th"))
    both = p.unionByName(p.select("track", F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    line = Window.partitionBy("track", "a").orderBy("b")
    near = both.withColumns({"x": F.lag("s").over(line), "y": F.lead("s").over(line)}).join(th, "track")
    good = near.where((F.col("s") >= F.col("th") * 0.5) & (F.col("s") >= F.col("x")) & (F.col("s") > F.col("y")))
    return good.groupBy("track", F.col("a").alias("u")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("s"), 6).alias("mean"))


@query(f"""WITH {UNITS}, x AS (SELECT a.track, a.u AS a, b.u AS b, unnest(a.t) AS v, unnest(b.t) AS w FROM units a JOIN units b ON a.track = b.track AND a.u < b.u)
SELECT track, a, b, round(corr(v, w), 6) + 0.0 AS r FROM x GROUP BY 1, 2, 3""")
def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(units(spark, sf_dir), ["track"], "u", ["t"])
    x = p.select("track", "a", "b", F.explode(F.arrays_zip("t_a", "t_b")).alias("z"))
    return x.groupBy("track", "a", "b").agg(r(F.coalesce(F.corr("z.t_a", "z.t_b"), F.lit(0.0)), 6).alias("r"))


@query(f"""WITH {UNITS}, e AS (SELECT track, u, unnest(t) AS v, unnest(range(0, 24)) AS band FROM units), l AS (SELECT *, greatest(0, v - lag(v) OVER (PARTITION BY track, band ORDER BY u)) AS up FROM e)
SELECT track, u, round(sum(up), 6) AS flux FROM l WHERE u > 0 GROUP BY 1, 2""")
def onset_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-wave rectified change of all bands against the unit before."""
    before = F.lag("t").over(Window.partitionBy("track").orderBy("u"))
    rise = F.aggregate(F.zip_with("t", "p", lambda x, y: F.greatest(F.lit(0.0), x - y)), F.lit(0.0), lambda s, v: s + v)
    return units(spark, sf_dir).select("track", "u", "t", before.alias("p")).where("p is not null").select("track", "u", r(rise, 6).alias("flux"))


@query(f"""WITH {UNITS}, e AS (SELECT track, u, unnest(t) AS v, unnest(range(0, 24)) AS band FROM units),
z AS (SELECT track, u, band, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-12) AS z FROM e WINDOW w AS (PARTITION BY track, band)),
n AS (SELECT track, u, sqrt(sum(z * z)) + 1e-12 AS n, max(z) AS hi FROM z GROUP BY 1, 2) SELECT track, u, round(hi / n, 5) + 0.0 AS top FROM n""")
def zscore_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("track", "band")
    e = units(spark, sf_dir).select("track", "u", F.posexplode("t").alias("band", "v"))
    z = e.select("track", "u", ((F.col("v") - F.avg("v").over(w)) / (F.stddev_pop("v").over(w) + 1e-12)).alias("z"))
    return z.groupBy("track", "u").agg(r(F.max("z") / (F.sqrt(F.sum(F.col("z") * F.col("z"))) + 1e-12), 5).alias("top"))


def _profile_sql() -> str:
    rows = ", ".join(f"('{mode}', {k}, {a[k]}, {b[k]})" for mode, a, b in (("major", KK_MAJOR, T_MAJOR), ("minor", KK_MINOR, T_MINOR)) for k in range(12))
    return f"prof AS (SELECT * FROM (VALUES {rows}) AS v(mode, k, kk, tt))"


@query(f"""WITH {UNITS}, {_profile_sql()}, ch AS (SELECT track, pc, sum(v) AS v FROM (SELECT track, unnest(c) AS v, unnest(range(0, 12)) AS pc FROM units) GROUP BY 1, 2),
s AS (SELECT track, tonic, mode, 0.5 * corr(v, kk) + 0.5 * corr(v, tt) AS r FROM ch, (SELECT unnest(range(0, 12)) AS tonic), prof WHERE prof.k = (pc - tonic + 12) % 12 GROUP BY 1, 2, 3)
SELECT track, tonic, mode, round(r, 5) + 0.0 AS r, CAST(row_number() OVER (PARTITION BY track ORDER BY round(r, 9) DESC, mode, tonic) AS INTEGER) AS place FROM s QUALIFY place <= 5""")
def key_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five of 24 keys by the mean correlation of a track's chroma with two rotated profiles."""
    ch = units(spark, sf_dir).select("track", F.posexplode("c").alias("pc", "v")).groupBy("track", "pc").agg(F.sum("v").alias("v"))
    modes = spark.createDataFrame([("major",), ("minor",)], "mode string")
    keys = spark.range(12).select(F.col("id").alias("tonic")).crossJoin(modes)
    pick = lambda a, b: F.when(F.col("mode") == "major", rotated(a, F.col("tonic"))).otherwise(rotated(b, F.col("tonic")))
    keys = keys.select("tonic", "mode", pick(KK_MAJOR, KK_MINOR).alias("kk"), pick(T_MAJOR, T_MINOR).alias("tt"))
    tests = ch.crossJoin(F.broadcast(keys)).groupBy("track", "tonic", "mode").agg(
        (0.5 * F.corr("v", F.get("kk", F.col("pc"))) + 0.5 * F.corr("v", F.get("tt", F.col("pc")))).alias("r")
    )
    tests = tests.withColumn("r9", F.round("r", 9))
    return top(tests, ["track"], [F.desc("r9"), F.asc("mode"), F.asc("tonic")], 5, "place").select("track", "tonic", "mode", r(F.col("r"), 5).alias("r"), "place")


@query("""WITH l AS (SELECT vec_id // 25 AS track, vec_id % 25 AS u, label % 3 AS kind FROM embeddings), c AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w THEN 1 ELSE 0 END AS ch FROM l WINDOW w AS (PARTITION BY track ORDER BY u)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY track ORDER BY u) AS run FROM c), z AS (SELECT track, run, min(kind) AS kind, min(u) AS a, count(*) AS n FROM g GROUP BY 1, 2),
s AS (SELECT track, kind, min(a) AS first FROM z GROUP BY 1, 2), o AS (SELECT track, kind, dense_rank() OVER (PARTITION BY track ORDER BY first) AS k FROM s)
SELECT z.track, CAST(z.run AS BIGINT) AS run, chr(CAST(64 + k AS INTEGER)) AS letter, z.a, z.n, z.n < 2 AS fragment,
 CASE WHEN z.run = 1 THEN 'intro' WHEN z.run = max(z.run) OVER (PARTITION BY z.track) THEN 'outro' WHEN lag(z.kind) OVER (PARTITION BY z.track ORDER BY z.run) = lead(z.kind) OVER (PARTITION BY z.track ORDER BY z.run) THEN 'bridge' ELSE 'verse' END AS name FROM z JOIN o USING (track, kind)""")
def section_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a label, lettered by first appearance, named from their neighbours, with a mark on fragments."""
    kind = units(spark, sf_dir).select("track", "u", (F.col("label") % 3).alias("kind"))
    z = with_runs(kind, F.col("kind"), ["track"], ["u"]).groupBy("track", "run").agg(F.min("kind").alias("kind"), F.min("u").alias("a"), F.count(F.lit(1)).alias("n"))
    first = F.min("a").over(Window.partitionBy("track", "kind"))
    line = Window.partitionBy("track").orderBy("run")
    letter = F.char(64 + F.dense_rank().over(Window.partitionBy("track").orderBy("first")))
    name = (
        F.when(F.col("run") == 1, "intro").when(F.col("run") == F.max("run").over(Window.partitionBy("track")), "outro")
        .when(F.lag("kind").over(line) == F.lead("kind").over(line), "bridge").otherwise("verse")
    )
    return z.withColumn("first", first).select("track", "run", letter.alias("letter"), "a", "n", (F.col("n") < 2).alias("fragment"), name.alias("name"))


@query("""WITH c AS (SELECT vec_id // 25 AS track, label, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY 1, 2)
SELECT track, label, n FROM c QUALIFY row_number() OVER (PARTITION BY track ORDER BY n DESC, first) = 1""")
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 25).alias("track"), "label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    return top(c, ["track"], [F.desc("n"), F.asc("first")]).select("track", "label", "n")


@query(f"""WITH {UNITS}, e AS (SELECT track, u, unnest(list_transform(t, lambda x: x * x)) AS p, unnest(range(0, 24)) AS bin FROM units), a AS (SELECT track, bin, avg(p) AS p FROM e GROUP BY 1, 2),
b AS (SELECT track, CASE WHEN bin < 2 THEN 'sub' WHEN bin < 6 THEN 'bass' WHEN bin < 12 THEN 'mid' ELSE 'air' END AS band, p FROM a)
SELECT track, band, round(100 * sum(p) / sum(sum(p)) OVER (PARTITION BY track), 5) AS share FROM b GROUP BY 1, 2""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-term spectrum by bin, joined to bands by range (a fixed dimension) and shared out in percent."""
    bands = spark.createDataFrame([("sub", 0, 2), ("bass", 2, 6), ("mid", 6, 12), ("air", 12, 24)], "band string, lo int, hi int")
    bins = bands.select("band", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("bin"))
    e = units(spark, sf_dir).select("track", F.posexplode(F.transform("t", lambda x: x * x)).alias("bin", "p"))
    b = e.groupBy("track", "bin").agg(F.avg("p").alias("p")).join(F.broadcast(bins), "bin").groupBy("track", "band").agg(F.sum("p").alias("p"))
    return b.select("track", "band", r(100 * F.col("p") / F.sum("p").over(Window.partitionBy("track")), 5).alias("share"))


@query(f"""WITH {UNITS}, e AS (SELECT track, unnest(list_transform(t, lambda x: x * x)) AS p, unnest(range(1, 25)) AS bin FROM units), a AS (SELECT track, bin, 10 * log10(greatest(avg(p), 1e-12)) AS y FROM e GROUP BY 1, 2)
SELECT track, round(regr_slope(y, log2(bin)), 5) + 0.0 AS tilt, round(sum(pow(10, y / 10) * bin) / sum(pow(10, y / 10)), 5) AS centroid, max(CASE WHEN y > -21 THEN bin END) AS edge FROM a GROUP BY track""")
def regression_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = units(spark, sf_dir).select("track", F.posexplode(F.transform("t", lambda x: x * x)).alias("k", "p")).withColumn("bin", (F.col("k") + 1).cast("long"))
    a = e.groupBy("track", "bin").agg((10 * F.log10(F.greatest(F.avg("p"), F.lit(1e-12)))).alias("y"))
    power = F.pow(F.lit(10.0), F.col("y") / 10)
    return a.groupBy("track").agg(
        r(F.regr_slope("y", F.log2("bin")), 5).alias("tilt"), r(F.sum(power * F.col("bin")) / F.sum(power), 5).alias("centroid"), F.max(F.when(F.col("y") > -21, F.col("bin"))).alias("edge")
    )


@query(f"""WITH {UNITS}, e AS (SELECT track, u, unnest(t) AS v, unnest(range(0, 24)) AS band FROM units), a AS (SELECT track, band, u // 5 AS col, avg(v) AS v FROM e GROUP BY 1, 2, 3)
SELECT track, CAST(band AS INTEGER) AS band, col, round(v, 6) + 0.0 AS v FROM a""")
def timbre_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = units(spark, sf_dir).select("track", F.floor(F.col("u") / 5).alias("col"), F.posexplode("t").alias("band", "v"))
    return e.groupBy("track", "band", "col").agg(r(F.avg("v"), 6).alias("v"))


@query(f"""WITH {UNITS}, w AS (SELECT track, u, sqrt(list_inner_product(t, t)) AS a, c FROM units), m AS (SELECT *, max(a) OVER (PARTITION BY track) AS hi FROM w),
e AS (SELECT track, unnest(c) * a AS v, unnest(range(0, 12)) AS pc FROM m WHERE a >= hi * 0.6) SELECT track, CAST(pc AS INTEGER) AS pc, round(sum(v), 5) AS v FROM e GROUP BY 1, 2""")
def weighted_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chroma summed with the level of each unit as weight, quiet units left out."""
    a = F.sqrt(dot(F.col("t"), F.col("t")))
    m = units(spark, sf_dir).select("track", "c", a.alias("a")).withColumn("hi", F.max("a").over(Window.partitionBy("track"))).where("a >= hi * 0.6")
    e = m.select("track", "a", F.posexplode("c").alias("pc", "v"))
    return e.groupBy("track", "pc").agg(r(F.sum(F.col("v") * F.col("a")), 5).alias("v"))


@query("""SELECT l_orderkey AS track, round(coalesce(corr(l_quantity, l_extendedprice), 0), 5) + 0.0 AS centred,
 round(CASE WHEN sum(l_quantity * l_quantity) < 1e-12 OR sum(l_extendedprice * l_extendedprice) < 1e-12 THEN 1 ELSE sum(l_quantity * l_extendedprice) / sqrt(sum(l_quantity * l_quantity) * sum(l_extendedprice * l_extendedprice)) END, 5) AS uncentred,
 round(10 * log10(sum(pow((l_quantity + l_tax) / 2, 2)) / sum((l_quantity * l_quantity + l_tax * l_tax) / 2)), 5) AS mono_db FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_quantity) > 2""")
def stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, t = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")
    xx, yy = F.sum(x * x), F.sum(y * y)
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track")).agg(
        r(F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0)), 5).alias("centred"),
        r(F.when((xx < 1e-12) | (yy < 1e-12), 1.0).otherwise(F.try_divide(F.sum(x * y), F.sqrt(xx * yy))), 5).alias("uncentred"),
        r(10 * F.log10(F.try_divide(F.sum(F.pow((x + t) / 2, F.lit(2))), F.sum((x * x + t * t) / 2))), 5).alias("mono_db"),
        F.countDistinct(x).alias("n"),
    )
    return g.where("n > 2").drop("n")


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS p, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(year(o_orderdate)) AS g FROM orders GROUP BY ROLLUP (o_orderpriority, year(o_orderdate))""")
def rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return o.rollup("p", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping("year").cast("long").alias("g"))


@query("""WITH x AS (SELECT d.lang, l.toxic AS truth, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS guess FROM documents d JOIN labels l USING (doc_id))
SELECT coalesce(lang, 'all') AS lang, count(*) AS n, CAST(sum(CASE WHEN truth = 1 AND guess = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN truth = 0 AND guess = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
 round((coalesce(avg(CASE WHEN truth = 1 THEN guess END), 0) + coalesce(avg(CASE WHEN truth = 0 THEN 1 - guess END), 0)) / 2, 6) AS balanced FROM x GROUP BY ROLLUP (lang)""")
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("guess"))
    x = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("truth")), "doc_id")
    hit = lambda t, g: F.count_if((F.col("truth") == t) & (F.col("guess") == g))
    rate = lambda t, g: F.coalesce(F.avg(F.when(F.col("truth") == t, g)), F.lit(0.0))
    out = x.rollup("lang").agg(F.count(F.lit(1)).alias("n"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), r((rate(1, F.col("guess")) + rate(0, 1 - F.col("guess"))) / 2, 6).alias("balanced"))
    return out.withColumn("lang", F.coalesce("lang", F.lit("all")))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100)
SELECT 'both' AS op, user_id FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'less', user_id FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'any', user_id FROM (FROM a UNION FROM b)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    a = ev.where("event_type = 'click'").select("user_id").distinct()
    b = ev.where("event_type = 'purchase' and value > 100").select("user_id").distinct()
    named = lambda df, op: df.select(F.lit(op).alias("op"), "user_id")
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "less")).unionByName(named(a.union(b).distinct(), "any"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders), e AS (SELECT user_id, max(value) AS v FROM events GROUP BY 1)
SELECT o_orderkey, EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey AND event_type = 'purchase') AS bought, NOT EXISTS (SELECT 1 FROM s p WHERE p.o_custkey = s.o_custkey AND p.o_orderdate < s.o_orderdate) AS first FROM s""")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXISTS as a left join to distinct keys, NOT EXISTS before a time as a window minimum."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey")).distinct().withColumn("hit", F.lit(True))
    first = F.col("o_orderdate") == F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    return o.join(bought, "o_custkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("bought"), first.alias("first"))


@query("""WITH g AS (SELECT * FROM (VALUES ('1-URGENT', 3), ('2-HIGH', 2)) AS v(p, w)) SELECT o_orderkey, coalesce(w, 1) AS w FROM orders LEFT JOIN g ON p = o_orderpriority""")
def dim_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.createDataFrame([("1-URGENT", 3), ("2-HIGH", 2)], "o_orderpriority string, w int")
    return table(spark, sf_dir, "orders").join(F.broadcast(g), "o_orderpriority", "left").select("o_orderkey", F.coalesce("w", F.lit(1)).alias("w"))


SECTIONS = "s AS (SELECT l_orderkey AS track, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS idx, l_quantity AS bars, l_extendedprice AS energy, l_returnflag AS kind, l_linestatus AS solo, l_discount AS gain FROM lineitem)"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the sections of a song: track, idx from 1, bars, energy, kind, solo, gain."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track"), F.row_number().over(line).cast("long").alias("idx"), F.col("l_quantity").alias("bars"),
        F.col("l_extendedprice").alias("energy"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("solo"), F.col("l_discount").alias("gain"),
    )


@query(f"WITH {SECTIONS} SELECT track, idx, coalesce(sum(bars) OVER (PARTITION BY track ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(bars) OVER (PARTITION BY track ORDER BY idx) AS stop FROM s")
def blueprint_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = frame(["track"], ["idx"], Window.unboundedPreceding, 0)
    stop = F.sum("bars").over(w)
    return sections(spark, sf_dir).select("track", "idx", (stop - F.col("bars")).alias("start"), stop.alias("stop"))


@query(f"WITH {SECTIONS} SELECT track, idx, CASE WHEN kind = 'R' OR (bool_or(solo = 'F') OVER (PARTITION BY track) AND solo <> 'F') THEN 0 ELSE gain END AS gain FROM s")
def mixer_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    any_solo = F.bool_or(F.col("solo") == "F").over(Window.partitionBy("track"))
    quiet = (F.col("kind") == "R") | (any_solo & (F.col("solo") != "F"))
    return sections(spark, sf_dir).select("track", "idx", F.when(quiet, 0.0).otherwise(F.col("gain")).alias("gain"))


@query(f"WITH {SECTIONS} SELECT track, avg(energy) FILTER (WHERE kind = 'A') IS NULL AS none, round(avg(energy) FILTER (WHERE kind = 'A') - avg(energy) FILTER (WHERE kind = 'N'), 6) + 0.0 AS lift, round(coalesce(avg(energy) FILTER (WHERE kind = 'A'), avg(energy)), 6) AS chorus FROM s GROUP BY track")
def conditional_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.avg(F.when(F.col("kind") == k, F.col("energy")))
    return sections(spark, sf_dir).groupBy("track").agg(of("A").isNull().alias("none"), r(of("A") - of("N"), 6).alias("lift"), r(F.coalesce(of("A"), F.avg("energy")), 6).alias("chorus"))


@query(f"""WITH {SECTIONS}, u AS (SELECT track, idx, CASE WHEN idx = 2 THEN 'chorus' ELSE kind END AS kind, energy, idx = 2 AS edited FROM s)
SELECT track, count(*) FILTER (WHERE edited) AS n_edited, min(idx) FILTER (WHERE kind = 'chorus') AS hook, round(avg(energy) FILTER (WHERE kind = 'chorus') - avg(energy) FILTER (WHERE kind = 'N'), 3) + 0.0 AS lift FROM u GROUP BY track""")
def update_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single-row edit laid over the detected sections, with the measures that depend on it made anew."""
    s = sections(spark, sf_dir)
    edits = s.where("idx = 2").select("track", "idx", F.lit("chorus").alias("new_kind"))
    u = s.join(edits, ["track", "idx"], "left").withColumns({"kind": F.coalesce("new_kind", "kind"), "edited": F.col("new_kind").isNotNull()})
    of = lambda k: F.avg(F.when(F.col("kind") == k, F.col("energy")))
    return u.groupBy("track").agg(F.count_if(F.col("edited")).alias("n_edited"), F.min(F.when(F.col("kind") == "chorus", F.col("idx"))).alias("hook"), r(of("chorus") - of("N"), 3).alias("lift"))


@query(f"""WITH {SECTIONS}, t AS (SELECT *, sum(bars) OVER (PARTITION BY track ORDER BY idx) AS stop FROM s), h AS (SELECT track, max(stop) / 2 AS at FROM t GROUP BY track)
SELECT h.track, coalesce(min(idx), -1) AS section FROM h LEFT JOIN t ON t.track = h.track AND h.at >= t.stop - t.bars AND h.at < t.stop GROUP BY h.track""")
def hook_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first section that contains the middle of the track; -1 if none."""
    t = sections(spark, sf_dir).withColumn("stop", F.sum("bars").over(frame(["track"], ["idx"], Window.unboundedPreceding, 0)))
    h = t.withColumn("at", F.max("stop").over(Window.partitionBy("track")) / 2)
    inside = (F.col("at") >= F.col("stop") - F.col("bars")) & (F.col("at") < F.col("stop"))
    return h.groupBy("track").agg(F.coalesce(F.min(F.when(inside, F.col("idx"))), F.lit(-1)).cast("long").alias("section"))


@query(f"WITH {SECTIONS} SELECT track, idx, round(energy * CASE WHEN idx % 2 = 0 THEN 1 ELSE 0.92 END, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(energy * CASE WHEN idx % 2 = 0 THEN 1 ELSE 0.92 END, 4) DESC, idx) = 1")
def hook_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(F.col("energy") * F.when(F.col("idx") % 2 == 0, 1.0).otherwise(0.92), 4)
    return top(sections(spark, sf_dir).select("track", "idx", score.alias("score")), ["track"], [F.desc("score"), F.asc("idx")]).select("track", "idx", "score")


@query("""SELECT o.o_orderkey, o.o_custkey, c.c_name, n.n_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_totalprice > 200000""")
def lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return o.join(c, "o_custkey").join(F.broadcast(n), "c_nationkey").select("o_orderkey", "o_custkey", "c_name", "n_name")
