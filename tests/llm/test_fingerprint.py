"""Sketches and edits against plain Python, and estimates against exact shares."""

import random
from collections import Counter
from hashlib import sha256

import xxhash
from pyspark.sql import functions as F

from cadenza.llm import fingerprint as P
from cadenza.llm.queries import QUERIES

from .helpers import WORD

SCHEMA = "doc_id long, text string, h int, copies int, `a``b` int"


def shingle_hashes(text):
    words = WORD.findall((text or "").lower())
    out = set()
    for i in range(max(len(words) - 4, min(len(words), 1))):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h - (1 << 64) if h >= 1 << 63 else h)
    return out


def sketch(text, size=P.HASHES):
    return sorted(shingle_hashes(text))[:size]


def java_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def expected(rows, size=P.HASHES):
    line = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, java_hash(r[1])))
    out = Counter()
    for k, (i, text) in enumerate(line):
        behind = line[(k + 1) % len(line)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + behind[:n]
        out[i, text, edited, tuple(sketch(text, size)), tuple(sketch(edited, size)), tuple(sketch(behind, size))] += 1
    return out


def rows_of(n, seed=2):
    rnd = random.Random(seed)
    words = ["ab", "Cd", "éÜ", "x1", "你", "12", "the"]
    texts = [None, "", "one", "...", "😀😀 ab é"] + [" ".join(rnd.choices(words, k=rnd.randint(1, 400))) for _ in range(12)]
    return [(rnd.choice([k, k, None, 3]), rnd.choice(texts)) for k in range(n)]


def test_fingerprints(spark):
    rows = rows_of(60)
    rows += rows[:7] + [(None, None)] * 30 + [(1000, "abcd efgh ijkl")] * 5
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    got = Counter((r[0], r[1], r[2], tuple(r[3]), tuple(r[4]), tuple(r[5])) for r in P.fingerprints(df.repartition(3)).collect())
    assert got == expected(rows)


def test_few_rows(spark):
    assert P.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    (row,) = P.fingerprints(spark.createDataFrame([(5, "abcdefgh", 1, 2, 3)], SCHEMA)).collect()
    assert row.edited == "abcdefab" and row.next_sketch == row.sketch


def test_estimates(spark):
    """On sets of known overlap, each estimate is within four of its standard errors."""
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(6000)]
    pairs = [(" ".join(base), " ".join(base[: int(6000 * s)] + [f"v{k}" for k in range(6000 - int(6000 * s))])) for s in (0.0, 0.3, 0.6, 0.9, 1.0)]
    pairs += [("", ""), ("", "a b c"), ("a b", "A, b"), (pairs[0][0], " ".join(base[:2000]))]
    df = spark.createDataFrame(pairs, "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"))
    got = df.select(P.likeness(F.col("a"), F.col("b")), P.containment(F.col("b"), F.col("a")), P.distinct_shingles(F.col("a"))).collect()
    for (a, b), (near, inside, n) in zip(pairs, got, strict=True):
        x, y = shingle_hashes(a), shingle_hashes(b)
        j = len(x & y) / len(x | y) if x | y else 1.0
        c = len(x & y) / len(y) if y else 1.0
        off = 4 * (j * (1 - j) / P.HASHES) ** 0.5
        assert abs(near - j) <= off + 1e-9
        assert abs(n - len(x)) <= 4 * len(x) / P.HASHES**0.5
        assert abs(inside - c) <= 0.35 if len(x | y) > P.HASHES else inside == c


def test_parts_merge_to_the_whole(spark):
    words = [str(k) for k in range(1000)]
    parts = [("d", " ".join(words[at : at + 104])) for at in range(0, 1000, 100)] + [("e", None), (None, "a b c d e"), (None, "a b c d e f")]
    df = spark.createDataFrame(parts, "part string, text string").withColumn("sketch", P.sketch(F.col("text")))
    got = {r.part: r.sketch for r in P.merge_sketches(df, ["part"]).collect()}
    assert got == {"d": sketch(" ".join(words)), "e": [], None: sketch("a b c d e f")}
    both = spark.createDataFrame([(" ".join(words[:504]), " ".join(words[500:]))], "a string, b string")
    assert both.select(P.merged(P.sketch(F.col("a")), P.sketch(F.col("b")))).first()[0] == sketch(" ".join(words))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for (i, text, edited, own, other, behind), _ in expected([tuple(r) for r in docs]).items():
        near = lambda a, b: len(set(sorted({*a, *b})[: P.HASHES]) & {*a} & {*b}) / len(sorted({*a, *b})[: P.HASHES]) if a or b else 1.0
        hexed = lambda s: " ".join(f"{h % (1 << 64):X}" for h in s)
        want[i] = (len(text), sha256(edited.encode()).hexdigest(), hexed(own), hexed(other), near(own, other), near(own, behind))
    got = QUERIES["op12_fingerprints"](spark, sf).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got} == want and len(got) == len(want)
