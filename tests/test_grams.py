"""Repeated n-grams of texts whose ids come several times or are missing, beside the SQL."""

import duckdb

from cadenza import plans


def test_grams_of_shared_and_missing_ids(spark, tmp_path):
    rows = [(1, "a b c d a b c d a b c"), (1, "x a b c"), (2, "a b c"), (2, "q a b c"), (None, "k l m k l m"), (3, None), (4, ""), (5, "la " * 40), (6, "one two three"), (7, "s t u\n\ns t u v s t u v")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, gram, n FROM ({plans.ORACLES['ngrams']})").fetchall()
    got = [tuple(x) for x in plans.QUERIES["ngrams"](spark, str(tmp_path)).select("doc_id", "gram", "n").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and (None, "k l m", 2) in got

