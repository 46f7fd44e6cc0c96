"""Every query with an oracle gives DuckDB's rows; the others give rows."""

from collections import Counter
from glob import glob

import duckdb
import pytest

import __spark_entry__ as entry
from cadenza import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{glob(f'{SF}/{t}.parquet')[0]}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*names).collect())
    if name not in plans.ORACLES:
        assert got
        return
    cur = duck.execute(plans.ORACLES[name])
    at = sorted(range(len(cur.description)), key=lambda i: cur.description[i][0])
    assert [cur.description[i][0] for i in at] == names
    assert got == Counter(tuple(r[i] for i in at) for r in cur.fetchall())


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
