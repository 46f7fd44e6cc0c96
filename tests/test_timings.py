"""Timings files: fields, rejected rows, repeated lines."""

import duckdb
import pytest

from cadenza import plans
from cadenza.operators import repeats
from cadenza.sources.timings import labelled, parsed, read_timings


def test_fields_and_problems(spark):
    rows = ["start,end,text", '1.5,2,"a, ""b"" c"', "2,3,plain", "4,5", "7,6,back", "x,1,no", "", "1,NaN,no", "8,9,"]
    df = parsed(spark.createDataFrame([("s", v) for v in rows], "song string, row string"))
    got = [(r.start, r.end, r.text, r.problem) for r in df.collect()]
    assert got[1:3] == [(1.5, 2.0, 'a, "b" c', None), (2.0, 3.0, "plain", None)]
    assert [g[3] for g in got] == ["times", None, None, "fields", "times", "times", "times", None] and got[-1][2] == ""


def test_files_and_repeats(spark, tmp_path):
    verse = ["we walk along the empty street", "nobody knows the name of this"]
    other = ["we walk along the empty road", "nobody knows the name of that"]
    lines = [*verse, "a line alone", *other, "the end"]
    text = "start,end,text\n" + "".join(f'{k},{k + 1},"{v}"\n' for k, v in enumerate(lines))
    (tmp_path / "my song+1.csv").write_text(text)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "notes.txt").write_text(text)
    rows = read_timings(spark, str(tmp_path))
    assert {r.song for r in rows.select("song").distinct().collect()} == {"my song+1"}
    got = labelled(rows.where("problem IS NULL")).orderBy("i").collect()
    assert [r.rep for r in got] == [True, True, False, True, True, False] and [r.text for r in got] == lines


def test_no_lines(spark):
    assert labelled(spark.createDataFrame([], "song string, start double, end double, text string")).count() == 0


VERSE = ["we walk along the empty street", "nobody knows the name of this"]
SONG = [*VERSE, "a line alone", "we walk along the empty road", "nobody knows the name of that", "the end"]


def test_short_songs_move_once(spark, tmp_path):
    """Their lines are gathered, not joined: by joins, shuffles took 29 times the text."""
    spark.createDataFrame([(k, "\n".join(SONG)) for k in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.QUERIES["timed_lines"](spark, str(tmp_path))
    assert found.where("rep").count() == 20 and found.count() == 30
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("limit", [{}, {"MOST_LINES": 6}, {"MOST_SIGNS": 0}])
def test_long_songs_and_songs_without_a_name(spark, monkeypatch, tmp_path, limit):
    for name, value in limit.items():
        monkeypatch.setattr(repeats, name, value)
    songs = {"a": SONG, "b": [*SONG, *VERSE], "c": ["alone"], None: SONG}
    rows = [(s, float(i), float(i + 1), v) for s, x in songs.items() for i, v in enumerate(x)]
    got = {}
    for r in labelled(spark.createDataFrame(rows[::-1], "song string, start double, end double, text string")).orderBy("i").collect():
        got.setdefault(r.song, []).append((r.i, r.text, r.rep))
    marks = lambda s: [r[2] for r in got[s]]
    assert {s: [r[1] for r in x] for s, x in got.items()} == songs and all([r[0] for r in x] == list(range(len(x))) for x in got.values())
    assert marks("a") == [True, True, False, True, True, False] and marks("b") == [True, True, False, True, True, False, True, True]
    assert marks("c") == [False] and marks(None) == [False] * 6

    spark.createDataFrame([(k or None, "\n".join(x)) for k, x in enumerate([SONG, SONG, [*SONG, "", *VERSE], ["x"]])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = plans.QUERIES["timed_lines"](spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in found.columns)
    want = con.execute(f"SELECT {columns} FROM ({plans.ORACLES['timed_lines']})").fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and want
