"""Strict checks of nested requests."""

from pyspark.sql import functions as F

from cadenza.functions.strict import Rule, json_text, parsed, violations

VARIANT = [Rule(n, "string", True) for n in ("title", "style", "text", "notes")]
ANSWER = [Rule("variants", "array", True, fields=VARIANT)]
REQUEST = [
    Rule("lyrics", "string", True, 10, 8000), Rule("title", "string", high=200), Rule("language", "string", choices=("fr", "en")),
    Rule("bpm", "int", low=40, high=260), Rule("styles", "array", True, 1, 5), Rule("by", "object", fields=[Rule("id", "number", True)]), Rule("on", "boolean"),
]


def found(spark, texts, rules):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r[0] for r in df.select("k", violations(parsed(F.col("t")), rules).alias("v")).orderBy("k").select("v").collect()]


def test_requests(spark):
    good = '{"lyrics": "ten signs or more", "styles": ["a"], "language": "fr", "bpm": 120, "by": {"id": 1.5}, "on": true, "title": null}'
    bad = '{"lyrics": "short", "bpm": 300, "styles": [], "language": "de", "by": {"name": 1}, "on": "yes", "zeta": 1, "alpha": 2}'
    odd = ['{"lyrics": 5, "bpm": "120", "styles": {}, "by": []}', "{}", "[1]", "", None, '{"lyrics": "ten signs or more", "styles": [1], "bpm": 39}', "{broken"]
    got = found(spark, [good, bad, *odd], REQUEST)
    assert got[0] == []
    assert got[1] == ["$.lyrics: low", "$.language: choice", "$.bpm: high", "$.styles: low", "$.by.id: missing", "$.by.name: unknown", "$.on: kind", "$.alpha: unknown", "$.zeta: unknown"]
    assert got[2] == ["$.lyrics: kind", "$.bpm: kind", "$.styles: kind", "$.by: kind"]
    assert got[3] == ["$.lyrics: missing", "$.styles: missing"] and got[4] == got[5] == got[6] == got[8] == ["$: missing"]
    assert got[7] == ["$.bpm: low"]


def test_answers_with_items(spark):
    item = '{"title": "a", "style": "b", "text": "c", "notes": "d"}'
    texts = [f'Sure.\n```json\n{{"variants": [{item}]}}\n```\nDone', f'{{"variants": [{item}, {{"title": 1, "style": "s", "text": "t"}}, 7]}}', '{"variants": []}', '{"variants": null}']
    assert found(spark, texts, ANSWER) == [[], ["$.variants[1].title: kind", "$.variants[1].notes: missing", "$.variants[2]: kind"], [], ["$.variants: missing"]]


def test_json_text(spark):
    texts = ["x {a} y {b} z", "```\n{1}\n``` {2}", "```json {3}```", "no", "}{", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(json_text(F.col("t"))).collect()
    assert [r[0] for r in got] == ["{a} y {b}", "{1}", "{3}", None, None, None]
