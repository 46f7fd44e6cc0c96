"""The manifest against a Merkle tree built node by node."""

import random
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cadenza.llm.manifest import folded, manifest, siblings
from cadenza.llm.queries import ORACLES, QUERIES
from .helpers import oracle_rows, spark_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, leaf int, `a``b` int"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """The root and every node's siblings, level by level."""
    at, paths = list(range(len(nodes))), [""] * len(nodes)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // fanout * fanout
            paths[k] += "".join(nodes[run:i] + nodes[i + 1 : run + fanout])
        nodes, at = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)], [i // fanout for i in at]
    return nodes[0], paths


def expected(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0], leaf_of([row[0], row[3], row[2], row[4], row[1]])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[name] = tree([leaf for _, leaf in groups[name]], fanout)
    root, upper = tree([subs[n][0] for n in names], fanout)
    return Counter((i, n, leaf, subs[n][0], root, digest(own + up)) for n, up in zip(names, upper, strict=True) for (i, leaf), own in zip(groups[n], subs[n][1], strict=True))


def rows_of(n, seed=1):
    rnd = random.Random(seed)
    texts = [None, "", "ABC abc", "Ünïcode ÄÖ", "x" * 5000, "12:a-"]
    rows = []
    for k in range(n):
        source = rnd.choice(["hot"] * 4 + ["b", "é", "B", "", None])
        rows.append((rnd.choice([k, k, k, 7, None]), rnd.choice(texts), rnd.choice(["en", None]), source, rnd.choice([3, None]), "p", 1, 2))
    return rows + rows[:5]


@pytest.mark.parametrize(("n", "fanout", "levels"), [(60, 16, 2), (60, 2, 1), (60, 3, 2), (1, 16, 2)])
def test_manifest(spark, n, fanout, levels):
    rows = rows_of(n)
    out = manifest(spark.createDataFrame(rows, SCHEMA), ["doc_id", "source", "lang", "n_chars", "text"], carry={"id2": F.col("doc_id")}, fanout=fanout, levels=levels)
    out = out.select("id", "group", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256), folded(F.col("leaf"), F.col("path")).alias("back"), "id2").collect()
    assert Counter(tuple(r)[:6] for r in out) == expected(rows, fanout)
    assert all(r.back == r.root and r.id2 == r.id for r in out)


def test_no_rows_and_one_source(spark):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    assert manifest(spark.createDataFrame([], SCHEMA), fields).collect() == []
    (row,) = manifest(spark.createDataFrame([(1, "a", "en", "s", 1, "p", 1, 2)], SCHEMA), fields).collect()
    assert row.leaf == row.subroot == row.root and row.path == []


def test_whole_source_of_equal_rows(spark):
    rows = [(None, None, None, None, None, "p", 1, 2)] * 700
    out = manifest(spark.createDataFrame(rows, SCHEMA), ["doc_id", "source", "lang", "n_chars", "text"])
    got = Counter(tuple(r) for r in out.select("id", "group", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256)).collect())
    assert got == expected(rows, 16)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = spark_rows(QUERIES["op11_merkle_manifest"](spark, sf))
    assert got == oracle_rows(ORACLES["op11_merkle_manifest"], sf)
    at = got[0].index("verified")
    assert {r[at] for r in got[1]} == {True, False}
