"""Scalars of values at the ends of their ranges, beside the SQL."""

import math

import duckdb

from cadenza import plans


def test_scalars_of_nothing_and_less(spark, tmp_path):
    values = [0.0, -0.0, -1.0, -61.0, 1e-13, 0.5, 130.5, 560.21, None]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows = plans.QUERIES["scalar_math"](spark, str(tmp_path)).orderBy("event_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({plans.ORACLES['scalar_math']}) ORDER BY event_id").fetchall()
    got = [tuple(x) for x in rows.collect()]
    plain = lambda rows: [["nan" if x != x else x for x in row] for row in rows]
    assert plain(got) == plain(want)
    assert got[0][2] == -math.inf and math.isnan(got[2][2]) and got[8][2] is None
