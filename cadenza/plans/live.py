"""Streams run to the end over what is there, and batch forms of small service operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strict import Rule, parsed, violations
from ..operators.windows import top
from ..sources.tables import contour, passing, samples, table
from ..streaming import live
from . import timeline
from .relational import SECTIONS, sections
from .timeline import r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder; it goes when the driver ends."""
    return passing(spark, "stream")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


@query()
def live_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch points of the events arriving in six portions by time; notes committed once they are settled. A portion is as
    many files as there are tasks, and the stream goes on with each as one batch from where it stopped."""
    path = scratch(spark)
    p = contour(spark, sf_dir)
    last = samples(spark, sf_dir).agg(F.max("i")).first()[0]  # an event's points are the 20 from its number on
    each = ((last or 0) * 20 + 19) / 100 / 6 + 0.001
    p.withColumn("portion", F.floor(F.col("t") / each)).write.partitionBy("portion").parquet(f"{path}/all")
    portions = spark.read.schema(f"{_ddl(p)}, portion long").parquet(f"{path}/all")
    for k in range(6):
        portions.where(F.col("portion") == k).drop("portion").write.mode("append").parquet(f"{path}/in")
        out = live.finished(live.live_notes(live.stream_of(spark, f"{path}/in", p.schema, 1 << 30)), path)
    return out


@query("""SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of the event stream that the watermark has closed."""
    path = scratch(spark)
    ev = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    ev.write.parquet(f"{path}/in")
    out = live.finished(live.windowed_levels(live.stream_of(spark, f"{path}/in", ev.schema, 1000)), path)
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", r(F.col("total")).alias("total"))


@query(timeline.ORACLES["token_bucket"])
def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_id").alias("id"))
    ev.write.parquet(f"{path}/in")
    out = live.finished(live.admitted(live.stream_of(spark, f"{path}/in", ev.schema, 1000), 1 / 36000, 3.0), path)
    return out.select(F.col("id").alias("event_id"), "ok", r(F.col("tokens")).alias("tokens"))


@query("""WITH b AS (SELECT event_id, event_type AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, substr(t, 1, 5) AS t, k IS NULL AS missing, CASE WHEN k IS NULL THEN 422 WHEN k > 80 THEN 413 ELSE 200 END AS status FROM b""")
def json_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request checks by schema: missing and out-of-range fields become status codes."""
    k = F.from_json("props", "k long").getField("k")
    b = table(spark, sf_dir, "events").select("event_id", F.substring("event_type", 1, 5).alias("t"), k.alias("k"))
    return b.select("event_id", "t", F.col("k").isNull().alias("missing"), F.when(F.col("k").isNull(), 422).when(F.col("k") > 80, 413).otherwise(200).alias("status"))


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(value) AS BIGINT), event_type DESC, event_id) AS BIGINT) AS place FROM events""")
def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite order by tick, then status downwards, then id."""
    w = Window.partitionBy("user_id").orderBy(F.floor("value"), F.desc("event_type"), "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query(f"""WITH {SECTIONS}, c AS (SELECT track, idx, n, sum(bars) OVER (PARTITION BY track, n ORDER BY idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS b2, bars, energy FROM s, (SELECT unnest([1, 2]) AS n)),
d AS (SELECT track, idx, n, CASE WHEN n = 1 THEN bars ELSE b2 END AS len, energy FROM c) SELECT track, idx, n, len FROM d WHERE len BETWEEN 11 AND 60 QUALIFY row_number() OVER (PARTITION BY track ORDER BY abs(len - 30), energy DESC, idx, n) = 1""")
def clip_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip of one or two sections nearest to 30 bars, the more energetic first."""
    w = Window.partitionBy("track").orderBy("idx").rowsBetween(0, 1)
    s = sections(spark, sf_dir).withColumn("b2", F.sum("bars").over(w))
    c = s.select("track", "idx", "energy", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.col("bars").alias("len")), F.struct(F.lit(2).alias("n"), F.col("b2").alias("len")))).alias("c")).select("track", "idx", "energy", "c.n", "c.len")
    best = top(c.where("len between 11 and 60").withColumn("off", F.abs(F.col("len") - 30)), ["track"], [F.asc("off"), F.desc("energy"), F.asc("idx"), F.asc("n")])
    return best.select("track", "idx", "n", "len")


@query(f"""WITH {SECTIONS}, b AS (SELECT track, idx, sum(bars) OVER (PARTITION BY track ORDER BY idx) AS t FROM s) SELECT track, idx, CASE WHEN t % 8 <= 4 THEN t - t % 8 ELSE t - t % 8 + 8 END AS snapped FROM b""")
def snap_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section ends moved to the nearest multiple of eight bars; the earlier one wins a tie."""
    t = F.sum("bars").over(Window.partitionBy("track").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    b = sections(spark, sf_dir).select("track", "idx", t.alias("t"))
    low = F.col("t") - F.col("t") % 8
    return b.select("track", "idx", F.when(F.col("t") % 8 <= 4, low).otherwise(low + 8).alias("snapped"))


@query("""SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 'secure' WHEN url LIKE 'http:%' THEN 'plain' ELSE 'other' END AS kind, array_to_string(list_filter(list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: trim(x, ' ')), lambda x: x <> ''), ',') AS args FROM pages""")
def label_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status by CASE and a list split, trimmed and rid of empty items."""
    args = F.filter(F.transform(F.split(F.regexp_extract("url", "[?]([^#]*)", 1), "&"), lambda x: F.trim(x)), lambda x: x != "")
    kind = F.when(F.col("url").startswith("https:"), "secure").when(F.col("url").startswith("http:"), "plain").otherwise("other")
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), F.array_join(args, ",").alias("args"))


@query("""SELECT doc_id, CAST(i AS BIGINT) AS i, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: x <> '') AS l FROM documents))""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all songs written as CSV and read again with a fixed schema."""
    path = f"{scratch(spark)}/csv"
    lines = F.filter(F.split("text", "\r?\n"), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("p", "text"))
    d.select("doc_id", (F.col("p") + 1).cast("long").alias("i"), "text").write.option("escape", '"').csv(path)
    return spark.read.schema("doc_id long, i long, text string").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


#: What a call may carry: a count of 0 to 80, which must be there.
CALL = [Rule("k", "int", True, 0, 80)]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties as models give them back: bare, in a code fence, between words, with another field, or cut."""
    p = F.col("props")
    forms = [p, F.concat(F.lit("```json\n"), p, F.lit("\n```")), F.concat(F.lit("Here: "), p, F.lit(" as asked")), F.replace(p, F.lit("{"), F.lit('{"extra": 1, ')), F.substring(p, F.lit(1), F.length(p) - 1)]
    form = F.coalesce(*[F.when(F.col("event_id") % len(forms) == k, f) for k, f in enumerate(forms)])
    return table(spark, sf_dir, "events").select("event_id", form.alias("answer"))


@query("""WITH a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Here: ' || props || ' as asked' WHEN 3 THEN replace(props, '{', '{"extra": 1, ') ELSE substr(props, 1, length(props) - 1) END AS t FROM events),
f AS (SELECT event_id, regexp_extract(CASE WHEN regexp_matches(t, '(?s)```(?:json)?\\s*(.*?)```') THEN regexp_extract(t, '(?s)```(?:json)?\\s*(.*?)```', 1) ELSE t END, '(?s)\\{.*\\}', 0) AS j FROM a),
p AS (SELECT event_id, CASE WHEN j <> '' AND json_valid(j) THEN j END AS j FROM f), v AS (SELECT event_id, j, json_extract(j, '$.k') AS k FROM p)
SELECT event_id, j IS NOT NULL AS readable, array_to_string(CASE WHEN j IS NULL THEN ['$: missing'] ELSE list_concat(CASE WHEN k IS NULL OR json_type(k) = 'NULL' THEN ['$.k: missing'] WHEN json_type(k) NOT IN ('UBIGINT', 'BIGINT') THEN ['$.k: kind']
 WHEN CAST(k AS BIGINT) < 0 THEN ['$.k: low'] WHEN CAST(k AS BIGINT) > 80 THEN ['$.k: high'] ELSE [] END, list_transform(list_sort(list_filter(json_keys(j), lambda n: n <> 'k')), lambda n: '$.' || n || ': unknown')) END, ', ') AS violations FROM v""")
def strict_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each answer holds an object, and what in it breaks the rules of a call."""
    v = answers(spark, sf_dir).withColumn("v", parsed(F.col("answer")))
    return v.select("event_id", F.col("v").isNotNull().alias("readable"), F.array_join(violations(F.col("v"), CALL), ", ").alias("violations"))
