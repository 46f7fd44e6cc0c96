"""The FM-index against plain searches, the operator against brute force and DuckDB."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import queries as Q
from cadenza.llm.decontaminate import decontaminate
from cadenza.llm.fmindex import FMIndex, suffix_array

from .helpers import oracle_rows, spark_rows, words

DOCS = "doc_id long, text string, lang string, n_hit string, spans int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(x):
    assert list(suffix_array(np.array(x, np.int64))) == sorted(range(len(x)), key=lambda i: x[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=6), st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=4), min_size=1, max_size=6))
def test_search_and_locate(texts, patterns):
    rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    index = FMIndex(np.array([w for t in texts for w in t], np.uint64), rows, sample=3)
    sizes = np.array([len(p) for p in patterns])
    lo, hi = index.search(np.array([w for p in patterns for w in p], np.uint64), np.cumsum(sizes) - sizes, sizes)
    for p, a, b in zip(patterns, lo, hi):
        text, place = index.locate(np.arange(a, b))
        want = sorted((k, i) for k, t in enumerate(texts) for i in range(len(t) - len(p) + 1) if t[i : i + len(p)] == p)
        assert sorted(zip(text.tolist(), place.tolist())) == want


def brute(docs, items, width):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        for k in range(max(1, len(w) - width + 1)):
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= got
        out.append((d, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=str)


def test_odd_rows_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "É", "x1", "été", "c"]
    items = [(1, "a b c a"), (2, "B,c... a\nx1 été é"), (3, None), (4, ""), (None, "a b"), (5, "..."), (1, "x1 x1 x1"), (6, "a b c a")]
    docs = [(i, rng.choice(["", "! "]) + rng.choice([" ", ", "]).join(rng.choices(vocabulary, k=rng.randrange(0, 30)))) for i in range(150)]
    docs += [(None, "a b c a"), (7, None), (7, None), (8, ""), (9, "a b c a"), (9, "a b c a"), (10, "Z a b c a " * 3000)]
    d = spark.createDataFrame([(*r, "en", "x", 1) for r in docs], DOCS)
    b = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, lang string")
    for width in (3, 10):
        got = decontaminate(d, b, width, shard_bytes=500).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r.item_ids))) for r in got), key=str) == brute(docs, items, width)
        for r in got:
            assert (r.text is None) == (r.clean_text is None)
            if r.text is not None:
                left, at = "", 0
                for s in r.spans:
                    left, at = left + r.text[at : s.start], s.end
                assert r.clean_text == left + r.text[at:] and sum(len(words(r.text[s.start : s.end])) for s in r.spans) == r.n_hit
    assert decontaminate(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontaminate(d, b.limit(0)).collect()} == {0}
    whole = sorted((tuple(r) for r in decontaminate(d, b, 3).collect()), key=str)
    assert sorted((tuple(r) for r in decontaminate(d, b, 3, part_bytes=20).collect()), key=str) == whole


def test_item_words_shared_by_many_items(spark):
    """A word that is a whole item, many times over, in many documents: each counts once before its items are listed."""
    items = spark.createDataFrame([(i, "yes") for i in range(500)] + [(900, "no yes")], "item_id long, text string")
    docs = spark.createDataFrame([(d, "yes " * 2000 + ("no yes" if d % 2 else "")) for d in range(20)], "doc_id long, text string")
    for part_bytes in (4 << 20, 300):
        for r in decontaminate(docs, items, part_bytes=part_bytes).collect():
            assert r.item_ids == [*range(500), *([900] if r.doc_id % 2 else [])] and r.n_hit == r.n_words == 2000 + 2 * (r.doc_id % 2) and r.clean_text.strip() == ""


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert spark_rows(Q.op4_decontamination(spark, sf)) == oracle_rows(Q.OP4_SQL, sf)
