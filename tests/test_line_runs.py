"""Runs of similar lines inside a document."""

import random

import duckdb
import pytest

from cadenza import plans
from cadenza.operators import repeats
from cadenza.operators.repeats import runs_inside, similar_bags, similar_runs


def test_line_runs_of_changed_lines(spark, tmp_path):
    verse = ["the sun is up and we go out", "we walk along the empty street", "nobody knows the name of this"]
    changed = ["the sun is up and we go home", "we walk along the empty road", "nobody knows the name of that"]
    lines = {1: [*verse, "", "a line alone", *changed], 2: ["la la la"] * 5, 3: [verse[0], "one two", verse[0], "three four"], 4: None}
    rows = [(k, None if v is None else "\n".join(v)) for k, v in lines.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in plans.QUERIES["line_runs"](spark, str(tmp_path)).select("doc_id", "i", "j", "n", "k").collect())
    assert got == [(1, 0, 4, 3, 3), (2, 0, 2, 3, 2), (2, 0, 3, 2, 2)]


def plain_runs(nodes, like):
    same = lambda a, b: a == b or (a, b) in like or (b, a) in like
    out, n = [], len(nodes)
    for d in range(1, n):
        i = 0
        while i + d < n:
            m = 0
            while i + m + d < n and same(nodes[i + m], nodes[i + m + d]):
                m += 1
            if m >= 2:
                out.append((i, d, m))
            i += max(m, 1)
    return sorted(out)


def test_runs_against_every_pair(spark):
    """Random texts of few lines, some of them alike, some without words."""
    draw = random.Random(5)
    texts, likes = {}, {}
    for t in range(12):
        k = draw.choice([2, 3, 5])
        texts[t] = [draw.randrange(k) for _ in range(draw.randrange(1, 40))]
        likes[t] = {(a, b) for a in range(k) for b in range(a) if draw.random() < 0.4}
    nodes = spark.createDataFrame([(t, i, x) for t, xs in texts.items() for i, x in enumerate(xs)], "doc_id long, i long, node long")
    alike = spark.createDataFrame([(t, *p) for t, ps in likes.items() for a, b in ps for p in ((a, b), (b, a))], "doc_id long, a long, b long")
    got = {}
    for r in similar_runs(nodes, alike).collect():
        got.setdefault(r.doc_id, []).append((r.i, r.d, r.n))
    for t, xs in texts.items():
        assert sorted(got.get(t, [])) == plain_runs(xs, likes[t])


def test_missing_lines_part_runs(spark):
    nodes = spark.createDataFrame([(1, i, i % 5) for i in (0, 1, 3, 5, 6, 8)], "doc_id long, i long, node long")
    alike = spark.createDataFrame([], "doc_id long, a long, b long")
    assert [tuple(r) for r in similar_runs(nodes, alike).collect()] == [(1, 0, 5, 2)]
    assert similar_runs(nodes.limit(0), alike).count() == 0


def test_a_refrain_of_thousands(spark):
    """4,000 lines of a verse of four: 8 million pairs of lines, 999 runs."""
    nodes = spark.createDataFrame([(1, i, i % 4) for i in range(4000)], "doc_id long, i long, node long")
    alike = spark.createDataFrame([], "doc_id long, a long, b long")
    got = sorted((r.d, r.i, r.n) for r in similar_runs(nodes, alike).collect())
    assert got == [(4 * k, 0, 4000 - 4 * k) for k in range(1, 1000)]


def test_no_table_is_broadcast(spark):
    """Small files of repeated numbers are large in the driver's memory."""
    lines = [(t, i, [f"w{i % 3}", f"v{t % 5}", "la"]) for t in range(5) for i in range(20)]
    nodes, alike = similar_bags(spark.createDataFrame(lines, "doc_id long, i long, w array<string>"))
    for df in (nodes, alike, similar_runs(nodes, alike)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def texts(seed, n):
    """Lines of few words, often the same, some repeated, with accents, or without any word."""
    draw = random.Random(seed)
    pool = [" ".join(draw.choice(["la", "la", "Été", "don't", "sun", "moon,", "walk"]) for _ in range(draw.choice([1, 2, 4, 8]))) for _ in range(12)] + ["...", "--"]
    return {k: [draw.choice(pool[: draw.choice([3, 14])]) for _ in range(draw.randrange(1, 40))] for k in range(n)}


def test_short_texts_move_once(spark, tmp_path):
    """Their lines are gathered, not joined: by joins, shuffles took 20 times the text."""
    spark.createDataFrame([(k, "\n".join(v)) for k, v in texts(3, 20).items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.QUERIES["line_runs"](spark, str(tmp_path))
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_runs_inside_a_text_as_by_joins(spark):
    clean = {k: [x.lower().replace("é", "e") for x in v] for k, v in texts(4, 30).items()}
    rows = [(k, i, [w.strip(",") for w in x.split() if w.strip(",.-")]) for k, v in clean.items() for i, x in enumerate(v)]
    want = sorted(tuple(r) for r in similar_runs(*similar_bags(spark.createDataFrame(rows, "doc_id long, i long, w array<string>"))).select("doc_id", "i", "d", "n").collect())
    assert sorted((k, *map(int, r)) for k, v in clean.items() for r in runs_inside(v)) == want and len(want) > 100
    assert len(runs_inside([])) == len(runs_inside([None, "", "a"])) == 0


@pytest.mark.parametrize("limit", [{}, {"MOST_LINES": 20}, {"MOST_SIGNS": 0}])
def test_long_and_short_texts_against_the_sql(spark, tmp_path, monkeypatch, limit):
    for name, value in limit.items():
        monkeypatch.setattr(repeats, name, value)
    spark.createDataFrame([(k or None, "\n".join(v)) for k, v in texts(5, 20).items()] + [(90, None), (91, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = plans.QUERIES["line_runs"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.ORACLES['line_runs']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want
