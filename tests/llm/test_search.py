"""Top-k, Jaccard join and license scan against brute force."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cadenza.llm import queries as Q
from cadenza.llm.jaccard import choose_bands, jaccard_classes
from cadenza.llm.license import NOTICES, PHRASES, scan_licenses
from cadenza.llm.topk import top_k

from .helpers import oracle_rows, spark_rows, words

SF = "/root/testdata/sf0.01"


def test_top_k_against_sql(spark):
    assert spark_rows(Q.op2_top_k(spark, SF)) == oracle_rows(Q.OP2_SQL, SF)


def test_top_k_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(5)]) for i in range(-200, 400)]
    rows += [(1000 + i, [0.5] * 5) for i in range(300)]  # one frequent vector
    bad = [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 5), (None, [1.0] * 5), (2300, [float("inf")] * 5)]
    short = [(2400, [3.0]), (2500, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad + short + rows[:50]], "vec_id long, embedding array<float>, label string, rank int")
    for lists, block, k in ((4, 100, 10), (1, 200, 3), (2, 1 << 20, 2000)):
        got = defaultdict(list)
        for r in sorted(top_k(df, F.col("vec_id") % 100 == 0, k=k, scale=8, lists=lists, block_bytes=block).collect(), key=lambda r: (r.query_id, r.rank)):
            assert r.rank == len(got[r.query_id]) + 1
            got[r.query_id].append((r.vec_id, r.score))
        whole = {i: [math.floor(8 * x) for x in v] + [0] * (5 - len(v)) for i, v in rows + short}
        for q in [i for i in whole if i % 100 == 0]:
            want = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:k]
            assert got[q] == [(i, -s) for s, i in want]
        assert set(got) == {i for i in whole if i % 100 == 0}
    one = df.where("vec_id = 0").dropDuplicates(["vec_id"])
    assert top_k(one, F.lit(True)).count() == 0 and top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_completes_few_pairs(spark):
    """Phase 3 works on the rows whose entries passed the uniform threshold, not on all pairs."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    counts = []
    top_k(vectors, F.col("vec_id") % 100 == 0, counts=counts)
    n = counts[0]
    assert n["rows"] == 2000 and n["queries"] == 20 and 200 <= n["completed"] <= n["entries"] < 0.15 * n["rows"] * n["queries"]


def test_top_k_equal_vectors(spark):
    """Copies of one vector are searched by their k + 1 smallest ids, which hold every possible result."""
    rows = [(i, [1.0, 2.0]) for i in range(0, 3000)] + [(5000, [1.0, 1.9]), (5100, [0.1, 0.2])]
    counts = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in top_k(df, F.col("vec_id").isin(0, 2900, 5100), k=4, scale=10, counts=counts).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == {0: [(i, 500) for i in (1, 2, 3, 4)], 2900: [(i, 500) for i in (0, 1, 2, 3)], 5100: [(i, 50) for i in (0, 1, 2, 3)]}
    assert counts[0]["rows"] == 5 + 2


def test_bands_reach_recall():
    for t in (0.5, 0.8, 0.95):
        b, r = choose_bands(t, 0.999)
        assert 1 - (1 - t**r) ** b >= 0.999
    assert choose_bands(1.0, 0.99)[0] == 1


def brute_classes(docs, n=5, t=0.8):
    sets = {}
    for k, (d, text) in enumerate(docs):
        w = words(text)
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else None
    by_gram = defaultdict(set)
    for k, s in sets.items():
        for g in s or ():
            by_gram[g].add(k)
    links = defaultdict(set)
    for k, s in sets.items():
        for o in set().union(*(by_gram[g] for g in s)) if s else ():
            if o != k and 10 * len(s & sets[o]) >= round(10 * t) * len(s | sets[o]):
                links[k].add(o)
    seen, name = {}, {}
    for k in sets:
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                for o in links[todo.pop()] - group:
                    group.add(o)
                    todo.append(o)
            low = min((docs[o][0] for o in group if docs[o][0] is not None), default=None)
            for o in group:
                seen[o], name[o] = True, low
    return sorted(((docs[k][0], name[k], len(links[k]), len({sets[o] for o in links[k]} - {sets[k]})) for k in sets), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in df.collect()), key=str)


def test_jaccard_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(Q.op3_jaccard_join(spark, SF)) == brute_classes(docs)


def test_jaccard_odd_rows_and_large_groups(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    docs = []
    for i in range(160):  # near copies of one text, of many degrees
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((i, " ".join(w)))
    for i in range(60):  # longer and longer ones, from class to class of sizes
        docs.append((200 + i, " ".join(base + rng.choices(vocabulary, k=2 * i))))
        docs.append((300 + i, docs[-1][1] + " " + rng.choice(vocabulary)))
    docs += [(500 + i, docs[3][1]) for i in range(40)] + [(600 + i, " ".join(rng.choices(vocabulary, k=80))) for i in range(60)]
    docs += [(700, None), (701, ""), (702, "!!"), (703, None), (704, "one two"), (705, "One, TWO!"), (None, docs[3][1]), (None, "lonely text of its own here"), (706, "x " * 30000), (706, "x " * 30000)]
    df = spark.createDataFrame([(*r, "s", 1) for r in docs], "doc_id long, text string, source string, hub int")
    for chunk, grams in ((16, 1 << 18), (128, 1 << 18), (1000, 1000)):
        assert rows_of(jaccard_classes(df, chunk=chunk, chunk_grams=grams, recall=0.99999)) == brute_classes(docs)
    assert jaccard_classes(df.limit(0)).count() == 0
    assert rows_of(jaccard_classes(df.where("doc_id between 700 and 703"))) == [(i, i, 0, 0) for i in range(700, 704)]


def brute_licenses(docs):
    out = {}
    for d, text in docs:
        w = words(text)
        at = [(k, label) for label, phrase in PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        out[d] = (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at})))
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_license_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in Q.op5_license_scan(spark, sf).collect()}
    want = brute_licenses(docs)
    assert {d: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for d, r in got.items()} == want
    assert any(r.n_base for r in got.values())
    for r in got.values():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_license_query_against_sql(spark):
    assert spark_rows(Q.op5_license_scan(spark, SF)) == oracle_rows(Q.OP5_SQL, SF)


def test_license_odd_rows_and_verified_spans(spark):
    gpl = NOTICES[1][1].split()
    mit = next(t for label, t in NOTICES if label == "mit" and len(t.split()) > 150).split()
    docs = [
        (1, "x y " + " ".join(gpl[:10] + ["oops"] + gpl[10:20] + gpl[22:]) + " z"),  # a word put in, two left out
        (2, "MIT License, mit LICENSE CC BY cc by"), (3, None), (4, ""), (5, "mit"), (6, "The Apache\nLicense"), (7, "gnu general public"),
        (8, "mit license " * 5000), (None, "cc by"), (9, "permission is hereby granted"), (6, "The Apache\nLicense"),
        (10, "redistribution and use in source and " + "la " * 60 + "binary forms with or without modification are permitted provided that"),
        (11, "a b c " + " ".join(mit[:80] + mit[81:]) + " d"), (None, "mit license here"), (None, None), (7, "public license, gnu general"), (12, "gnu general"), (12, "public license"),
    ]
    df = spark.createDataFrame([(*r, "en", "l", 2) for r in docs], "doc_id long, text string, lang string, label string, place int")
    per_doc, spans = scan_licenses(df)
    rows = per_doc.collect()
    mine = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str)
    assert mine == sorted(((d, *brute_licenses([(d, t)])[d]) for d, t in docs), key=str)
    got = {r.doc_id: r for r in rows if r.doc_id not in (None, 7, 12)}
    assert got[1].labels == "gpl" and got[1].score > 0.75 and "mit" in got[11].labels.split(",") and got[11].score > 0.95
    assert {r.labels for r in rows if r.doc_id in (7, 12)} == {""} and got[9].labels == "" and got[10].labels == ""
    all_spans = spans.collect()
    long = [s for s in all_spans if s.doc_id == 1 and s.label == "gpl" and not s.exact]
    assert (2, 2 + len(gpl) - 1) in {(s.first_word, s.end_word) for s in long}
    assert (3, 3 + len(mit) - 1) in {(s.first_word, s.end_word) for s in all_spans if s.doc_id == 11}
    assert scan_licenses(df.limit(0))[0].count() == 0
