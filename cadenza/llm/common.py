"""Pieces that several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyarrow import RecordBatch
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType
from pyspark.sql.window import Window

#: A word of the contracts' texts after lower-casing A-Z (Java, RE2 and Python read it alike).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session, which has one machine,
    may do without the setting; on a cluster its absence is an error, as executors could not read each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


#: Paths of the tables written inside each open scratch().
_open: list[list[str]] = []


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and whole after an executor is lost.

    The table goes with dropped(), with the end of the scratch() it was made in, or else as the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    for paths in _open:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table made by written() that nothing reads any more."""
    fs, path = _path(df.sparkSession, df._table_path)
    fs.delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes all tables written() inside it at its end, but for those put in the yielded list."""
    made: list[str] = []
    keep: list[DataFrame] = []
    _open.append(made)
    try:
        yield keep
    finally:
        _open.remove(made)
        for path in set(made) - {df._table_path for df in keep}:
            fs, at = _path(spark, path)
            fs.delete(at, True)


def mapped(df: DataFrame, run: Callable[[str, Iterator[RecordBatch]], Iterator[RecordBatch]], **kinds: DataType) -> DataFrame:
    """df with columns of these kinds behind its own, whatever their names and types. run gets the name of the text column
    and batches, in which all columns have plain names, and yields them with the new columns behind."""
    names = [f"c{k}" for k in range(len(df.columns))]
    text = names[df.columns.index("text")]
    plain = df.toDF(*names)
    schema = StructType([*plain.schema.fields, *(StructField(name, kind) for name, kind in kinds.items())])
    return plain.mapInArrow(lambda batches: run(text, batches), schema).toDF(*df.columns, *kinds)


def same_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns of `like` only, whatever their names."""
    return df.select(*[df["`" + c.replace("`", "``") + "`"] for c in like.columns])


#: Times that a row is repeated at once.
REPEATS = 1 << 16


def repeated(df: DataFrame, n: str, name: str) -> DataFrame:
    """Every row of df as often as its column n says, numbered from 0 in a column `name`; n goes. Many repeats of one row
    are dealt to tasks by stretches of REPEATS."""
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / REPEATS)))
    parts = df.where(F.col(n) > 0).withColumn("_stretch", stretch)
    parts = parts.repartition(F.xxhash64(*[F.col(c) for c in df.columns if c != n], "_stretch"))
    numbers = F.sequence(F.col("_stretch") * REPEATS, F.least(F.col(n), (F.col("_stretch") + 1) * REPEATS) - 1)
    return parts.withColumn(name, F.explode(numbers)).drop(n, "_stretch")


def copies(df: DataFrame, name: str) -> DataFrame:
    """df with a number `name`, from 0, among equal rows: these are counted before they are shuffled, then repeated."""
    return repeated(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")), "_n", name)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and wordless texts have none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def ranked(df: DataFrame, strata: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds rank (from 0, gapless in each stratum, by bucket then order) and `{name}_total`, the stratum's rows.

    A plain row_number would send a whole stratum to one task. Here rows are ranked inside (stratum, bucket)
    and shifted by the rows of the buckets before, so no task holds more than one bucket of a hot stratum.
    """
    b, off, total = f"_{name}_bucket", f"_{name}_off", f"{name}_total"
    df = df.withColumn(b, bucket)
    keys = [*strata, b]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    part = Window.partitionBy(*strata)
    before = part.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(off),
        F.sum("_n").over(part).alias(total),
    )
    local = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys])
    out = local.join(offsets, same)
    return out.withColumn(name, F.col(name) + F.col(off)).drop(b, off, *[f"_o_{k}" for k in keys])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge list (src, dst); component is the smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each a groupBy-min and a join, written
    to the shared folder. Nulls and loops are left out; an empty edge list gives no rows. The loop ends without a
    limit of rounds: no round ever raises a node's smallest neighbour, one that changes nothing ends it, and the
    paper shows that O(log(n)^2) rounds do for n nodes. The smallest neighbours are written, so that the joins with
    them have exchanges of their own and a node of a huge component can be split over tasks.
    """
    both = lambda e: e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    e = written(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    state = ()
    while True:
        near = both(e)
        low = written(near.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")))
        star = near.where(F.col("dst") > F.col("src")).join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        star = written(star.where(F.col("src") != F.col("dst")).distinct())
        least = written(star.groupBy("src").agg(F.min("dst").alias("m")))
        small = star.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        small = small.union(least.select("src", F.col("m").alias("dst"))).where(F.col("src") != F.col("dst")).distinct()
        nxt = written(small)
        now = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        for table in (e, low, star, least):
            dropped(table)
        e = nxt
        if now == state:
            break
        state = now
    roots = e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)


def numbered(df: DataFrame, strata: Sequence[str], order: Sequence[str], name: str = "number") -> DataFrame:
    """Adds name (from 0, gapless in each stratum, ascending by order, nulls first) and `{name}_total`, the stratum's rows.

    Rows are sorted over all partitions by ranges of (strata, order), which are drawn from the rows themselves, and
    written; each keeps its place in its partition, and only the rows of each (partition, stratum) are counted and
    added up. So a stratum of any share is spread over tasks as long as order tells its rows apart.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*strata, *order)]
    line = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    line = written(line).withColumn("_part", F.shiftright("_at", 33))
    runs = line.groupBy(*strata, "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [*strata, "_part"]
    shift = runs.select(*[F.col(k).alias(f"_o_{k}") for k in keys], (before - F.col("_from")).alias("_shift"), F.sum("_n").over(whole).alias(f"{name}_total"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys])
    return line.join(shift, same).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift", *[f"_o_{k}" for k in keys])
