"""N-gram Jaccard self-join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written
from .textops import factors, gram_hashes, mixed, slices, word_hashes


def choose_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose bands find a pair at the threshold with that probability.

    A pair of similarity s shares a band of r rows with probability s**r, so b bands miss it with (1 - s**r)**b.
    More rows mean fewer false candidates; most_hashes bounds bands * rows.
    """
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if best is None or bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def distinct_grams(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, and the rows' offsets among them."""
    words, _, _, rows = word_hashes(column)
    grams, row = gram_hashes(words, rows, n)
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(column) + 1))


def set_keys(grams: np.ndarray, rows: np.ndarray) -> list[bytes | None]:
    """A 16-byte key of each row's set; null for no grams."""
    raw = memoryview(np.ascontiguousarray(grams).view(np.uint8))
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if a < b else None for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]


def band_keys(grams: np.ndarray, rows: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """Keys of the bands of each row that has grams (rows x bands)."""
    full = np.flatnonzero(np.diff(rows) > 0)
    out = np.zeros((len(full), bands), np.uint64)
    if not len(full):
        return out
    f = factors(2 * bands * per_band + per_band + 1)
    first = rows[:-1][full]
    for band in range(bands):
        key = np.full(len(full), f[band], np.uint64)
        for k in range(per_band):
            a, b = f[2 * (band * per_band + k) : 2 * (band * per_band + k) + 2]
            key = mixed(key ^ np.minimum.reduceat((grams ^ b) * a, first))
        out[:, band] = key
    return out


def _sketches(docs: DataFrame, n: int, bands: int, per_band: int, slice_bytes: int = 1 << 20) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                grams, rows = distinct_grams(part.column("text"), n)
                keys = band_keys(grams, rows, bands, per_band)
                offsets = np.concatenate([[0], np.cumsum(np.diff(rows) > 0) * bands]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(set_keys(grams, rows), pa.binary()), pa.array(np.diff(rows), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))],
                    names=["doc_id", "text_key", "set_key", "n_grams", "bands"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return own.mapInArrow(run, "doc_id long, text_key long, set_key binary, n_grams long, bands array<long>")


def _sets(docs: DataFrame, n: int, slice_bytes: int = 1 << 20) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                grams, rows = distinct_grams(part.column("text"), n)
                lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(grams, rows), pa.binary()), lists], names=["set_key", "grams"])

    return docs.select("text").mapInArrow(run, "set_key binary, grams array<long>")


def overlaps(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sets `left` with the sets `right` (indices into lists), by blocks of a 0/1 matrix."""
    sizes = np.array([len(x) for x in lists])
    row = np.repeat(np.arange(len(lists)), sizes)
    _, column, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    total = int(shared.sum())
    for start in range(0, total, columns):
        a, b = np.searchsorted(column, [start, start + columns])
        x = np.zeros((len(lists), min(columns, total - start)), np.float32)
        x[row[a:b], column[a:b] - start] = 1
        out += x[left] @ x[right].T
    return out.astype(np.int64)


def _block_links(threshold: Fraction):
    p, q = threshold.numerator, threshold.denominator

    def run(key: tuple, table: pa.Table) -> pa.Table:
        hub, a, i, b, j = (k.as_py() for k in key)
        keys = table.column("set_key").to_pylist()
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        table = table.take(pa.array(order))
        keys = [keys[k] for k in order]
        grams = table.column("grams").combine_chunks()
        grams = [grams[k].values.to_numpy() for k in range(len(keys))]
        size_class, chunk = table.column("size_class").to_numpy(), table.column("chunk").to_numpy()
        copies = table.column("n_copies").to_numpy()
        left, right = np.flatnonzero((size_class == a) & (chunk == i)), np.flatnonzero((size_class == b) & (chunk == j))
        size = np.array([len(g) for g in grams])
        same = overlaps(grams, left, right)
        link = same * (p + q) >= p * (size[left][:, None] + size[right][None, :])
        link &= left[:, None] != right[None, :]
        # a pair that meets at several hubs counts at the smallest
        hubs = [[h for h in x if h < hub] for x in table.column("hubs").to_pylist()]
        if any(hubs):
            number = {h: k for k, h in enumerate(sorted({h for x in hubs for h in x}))}
            at = np.zeros((len(keys), len(number)), np.float32)
            for k, x in enumerate(hubs):
                at[k, [number[h] for h in x]] = 1
            link &= (at[left] @ at[right].T) == 0
        texts, links = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        np.add.at(texts, left, link.sum(1))
        np.add.at(links, left, link @ copies[right])
        if (a, i) != (b, j):
            np.add.at(texts, right, link.sum(0))
            np.add.at(links, right, copies[left] @ link)
        root = np.arange(len(keys))
        one, other = left[np.nonzero(link)[0]], right[np.nonzero(link)[1]]
        while len(one):
            low = root.copy()
            np.minimum.at(low, one, root[other])
            np.minimum.at(low, other, root[one])
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = np.flatnonzero(texts > 0)
        return pa.table({
            "set_key": pa.array([keys[k] for k in some], pa.binary()), "n_texts": pa.array(texts[some]), "n_links": pa.array(links[some]), "root": pa.array([keys[root[k]] for k in some], pa.binary()),
        })

    return run


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, chunk: int = 128, chunk_grams: int = 1 << 18) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_text_links, n_copies, class_key, text_key.

    The word n-gram set of a whole text (words lower-cased; a text of fewer words is one gram) is compared with
    all others: two texts are linked if the Jaccard similarity of their full sets is at least the threshold. A
    class is a connected component of links, named by its smallest doc_id. n_links counts the other documents
    linked to a document, n_text_links those linked texts that differ (in their sets), n_copies the documents
    with the same set, itself included; copies of it count in n_links.

    Documents with one set are one node, so exact copies cost a count. MinHash signatures are cut in bands
    (choose_bands) and shuffled on the bands' hashes; each bucket's smallest node is its hub, and nodes meet in
    the group of each hub they have, where all pairs are verified on full sets (64-bit hashes of the n-grams).
    Only node keys and sizes go to the hubs at first. A group that is more than one chunk (of at most `chunk`
    nodes and chunk_grams grams) is cut by size classes, so wide that linked sets lie in one or in neighbouring
    ones, and these into chunks by hash; then gram lists move to the pairs of chunks that can hold a link, and to
    no others. So no task holds more than two chunks and no pair of texts becomes a row. A pair at the threshold is
    missed with probability 1 - recall, a closer one less often; what is reported is exact. class_key names a
    class even where no doc_id does (null for a text without grams), text_key is xxhash64 of the text.

    Null, empty and wordless texts have no grams: no links, one copy, a class of their own. Null doc_ids are
    compared like others (their class may be null). Repeated rows are copies. Empty tables give no rows.
    """
    bands, per_band = choose_bands(threshold, recall)
    sketch = written(_sketches(docs, n, bands, per_band))
    full = sketch.where(F.col("set_key").isNotNull())
    wide = max(math.log(1 / threshold) * (1 + 1e-9), 1e-6) if threshold > 0 else math.inf
    size_class = F.floor(F.ln("n_grams") / wide).cast("int") if wide < math.inf else F.lit(0)
    nodes = full.groupBy("set_key").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_doc"), F.min("bands").alias("bands"), F.min("n_grams").alias("n_grams"))
    nodes = written(nodes.withColumn("size_class", size_class))
    keyed = nodes.select("set_key", "n_grams", "size_class", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("set_key").alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("band", "hub")
    edges = written(keyed.join(buckets, "band").select("set_key", "n_grams", "size_class", "hub").distinct())

    parts = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("g") / chunk_grams)).cast("int")
    classes = edges.groupBy("hub", "size_class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("g"))
    of_class = F.map_from_entries(F.collect_list(F.struct("size_class", F.struct(parts.alias("parts"), "n"))))
    # written, so that the join below has its own exchange and a hot hub can be split over tasks
    plan = written(classes.groupBy("hub").agg(of_class.alias("classes"), ((F.sum("n") <= chunk) & (F.sum("g") <= chunk_grams)).alias("one")))
    own, here = F.col("classes")[F.col("size_class")], F.col("size_class")
    spread = edges.join(plan, "hub").withColumn("chunk", F.pmod(F.xxhash64("set_key"), own["parts"]).cast("int"))
    pair = lambda a, i, b, j: F.struct(a.alias("a"), i.alias("i"), b.alias("b"), j.alias("j"))
    chunks = lambda c: F.sequence(F.lit(0), F.try_element_at("classes", c)["parts"] - 1)
    none = F.array().cast("array<struct<a:int,i:int,b:int,j:int>>")
    same = F.when(own["n"] > 1, F.transform(chunks(here), lambda o: pair(here, F.least("chunk", o), here, F.greatest("chunk", o)))).otherwise(none)
    up = F.coalesce(F.transform(chunks(here + 1), lambda j: pair(here, F.col("chunk"), here + 1, j)), none)
    down = F.coalesce(F.transform(chunks(here - 1), lambda i: pair(here - 1, i, here, F.col("chunk"))), none)
    zero = F.lit(0)
    at = F.explode(F.when(F.col("one"), F.array(pair(zero, zero, zero, zero))).otherwise(F.concat(same, up, down)))
    whole = lambda c: F.when(F.col("one"), 0).otherwise(F.col(c)).alias(c)
    tasks = spread.withColumn("at", at).select("set_key", "hub", "at.*", whole("size_class"), whole("chunk"))

    hubs = edges.groupBy("set_key").agg(F.collect_set("hub").alias("hubs"))  # at most one for each band
    wanted = nodes.join(hubs, "set_key").select("set_key", "hubs", "n_copies", "first_doc")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = wanted.select("first_doc").distinct()
    sets = _sets(texts.join(ids, texts.doc_id.eqNullSafe(ids.first_doc), "left_semi"), n)
    sets = sets.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.first("grams").alias("grams"))
    members = wanted.join(sets, "set_key").select("set_key", "hubs", "n_copies", "grams")
    verify = _block_links(Fraction(threshold).limit_denominator(10_000))
    links = tasks.join(members, "set_key").groupBy("hub", "a", "i", "b", "j").applyInArrow(verify, "set_key binary, n_texts long, n_links long, root binary")
    links = written(links)

    counted = links.groupBy("set_key").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_links").alias("n_links"))
    component = connected_components(links.select(F.col("set_key").alias("src"), F.col("root").alias("dst")))
    placed = nodes.select("set_key", "n_copies", "first_doc").join(component, F.col("set_key") == F.col("node"), "left").join(counted, "set_key", "left")
    placed = placed.withColumn("component", F.coalesce("component", "set_key"))
    # written, so that the join below has its own exchange and a huge class can be split over tasks
    names = written(placed.groupBy("component").agg(F.min("first_doc").alias("class_id")))
    named = placed.join(names, "component").select("set_key", "class_id", F.col("component").alias("class_key"), "n_copies", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = sketch.select("doc_id", "text_key", "set_key").join(named, "set_key", "left")
    none = F.col("set_key").isNull()
    return rows.select(
        "doc_id",
        F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(none, 0).otherwise(F.col("n_links") + F.col("n_copies") - 1).alias("n_links"),
        F.when(none, 0).otherwise(F.col("n_texts")).alias("n_text_links"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        "class_key", "text_key",
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """docs without near duplicates: of each class of jaccard_classes the row with the smallest doc_id stays.

    Nulls come last, ties go by text_key and of equal rows one stays. Texts without words are in no class and all
    stay. docs' columns come back unchanged.
    """
    classes = written(jaccard_classes(docs, **settings).where(F.col("class_key").isNotNull()).select("class_key", "doc_id", "text_key"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    first = written(classes.groupBy("class_key").agg(F.min(place).alias("first")))
    rest = classes.join(first, "class_key").where(~place.eqNullSafe(F.col("first")))
    own = uuid.uuid4().hex  # docs may have columns of any name
    i, k = f"id_{own}", f"key_{own}"
    rest = rest.select(F.col("doc_id").alias(i), F.col("text_key").alias(k)).distinct()
    key = F.xxhash64("text")
    kept = docs.join(rest, docs.doc_id.cast("long").eqNullSafe(F.col(i)) & (key == F.col(k)), "left_anti")
    again = classes.groupBy("doc_id", "text_key").count().where("count > 1")
    if again.isEmpty():
        return kept
    # equal rows of one doc_id: only these are gathered by their text
    again = again.select(F.col("doc_id").alias(i), F.col("text_key").alias(k))
    same = kept.doc_id.cast("long").eqNullSafe(F.col(i)) & (key == F.col(k))
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
