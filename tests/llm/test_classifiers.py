"""Language ID and toxicity: held-out accuracy, odd rows, folding and exceptions."""

import math
import re
import struct
import time
import zlib
from collections import defaultdict

import xxhash
import zstandard
from pyspark.sql import functions as F

from cadenza.llm import queries as Q
from cadenza.llm.language import Compressors, fit_dictionaries, identify
from cadenza.llm.toxicity import EXCEPTIONS, TABLE, Scorer, fit_lexicon, folded, score_toxicity

SF = "/root/testdata/sf0.01"
H = "/root/testdata/sf0.1"


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op6_language(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_language_odd_rows(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, source int"
    learn = [(i, "the cat and the dog went over the hill to the sea " * 3, "en", "", 1) for i in range(20)]
    learn += [(100 + i, "le chat et le chien sont sur la colline et la mer " * 3, "fr", "", 1) for i in range(20)] + [(200, None, "fr", "", 1), (201, "text", None, "", 1), (None, "a dog", "en", "", 1)]
    model = fit_dictionaries(spark.createDataFrame(learn, schema), n_samples=10, sample_chars=60)
    assert set(model) == {"en", "fr"} and all(len(v) <= 10 * 61 for v in model.values())
    odd = [(1, None, "", "", 1), (2, "", "", "", 1), (3, "123 !! 4", "", "", 1), (4, "THE DOG AND THE CAT", "", "", 1), (5, "le chien et le chat", "", "", 1), (5, "le chien et le chat", "", "", 1), (None, "zqx " * 50000, "", "", 1)]
    got = identify(spark.createDataFrame(odd, schema), model).collect()
    assert [(r.lang_pred, r.lang_rejected) for r in got[:6]] == [("und", True)] * 3 + [("en", False), ("fr", False), ("fr", False)]
    assert got[6].lang_pred in model and {r.lang_score for r in got[:3]} == {0.0}
    assert got[6].lang_rejected == (got[6].lang_score <= 0.005)
    assert fit_dictionaries(spark.createDataFrame([], schema)) == {}
    assert {r.lang_pred for r in identify(spark.createDataFrame(odd, schema), {}).collect()} == {"und"}
    assert identify(spark.createDataFrame([], schema), model).count() == 0
    assert Compressors({"en": b"one language only"}, 100, 6)("word") == ("en", 1.0)
    short = fit_dictionaries(spark.createDataFrame([(1, "ab", "xx"), (2, "zz", "yy"), (3, "12", "none")], "doc_id long, text string, lang string"))
    assert set(short) == {"xx", "yy"} and all(len(v) >= 8 for v in short.values())
    many = fit_dictionaries(spark.createDataFrame([(i, f"text number of language {i}", f"l{i:03}") for i in range(150)], "doc_id long, text string, lang string"))
    assert len(many) == 150


def plain_language(rows):
    """The classifier in plain Python: (lang, margin) by doc_id of rows (doc_id, text, lang), n_samples 400 of 256 characters."""
    clean = lambda t: re.sub(r"[\W\d_]+", " ", t.lower()).strip()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    by_lang = defaultdict(list)
    for d, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(d).encode()) % 5:
            h = signed(xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(struct.pack("<q", d), xxhash.xxh64_intdigest(struct.pack("<i", 5), 42))))
            at = h % max(1, len(text) - 256)
            by_lang[lang].append((h, d, text[at : at + 256]))
    coders = []
    for lang, drawn in sorted(by_lang.items()):
        raw = " ".join(clean(p) for _, _, p in sorted(drawn)[:400] if clean(p)).encode()
        p = zstandard.ZstdCompressionParameters.from_level(6, dict_size=len(raw), source_size=1000, write_content_size=False, write_checksum=False, write_dict_id=False)
        coders.append((lang, zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)))
    out = {}
    for d, text, _ in rows:
        t = clean(text or "")
        if not any(c.isalpha() for c in t):
            out[d] = ("und", 0.0)
            continue
        cost = sorted((sum(len(z.compress(t[i : i + 1000].encode())) for i in range(0, len(t), 1000)), lang) for lang, z in coders)
        out[d] = (cost[0][1], round(1 - cost[0][0] / cost[1][0], 9))
    return out


def test_language_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in Q.op6_language(spark, SF).collect()} == plain_language(rows)


def test_language_of_null_and_repeated_ids_is_learned(spark):
    """A language whose 20,000 rows have no id, and one whose rows share an id, give dictionaries as the others do."""
    ids = spark.range(60000).select("id", (F.col("id") % 3).alias("k"))
    doc_id, lang = F.when(F.col("k") == 0, F.lit(None)).when(F.col("k") == 1, F.lit(7)).otherwise(F.col("id")), F.concat(F.lit("l"), F.col("k"))
    model = fit_dictionaries(ids.select(doc_id.cast("long").alias("doc_id"), F.concat(F.lit("text of number "), F.hex(F.xxhash64("id"))).alias("text"), lang.alias("lang")), n_samples=200)
    assert set(model) == {"l0", "l1", "l2"} and all(len(v) > 200 * 10 for v in model.values())


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the dog you idiot", 2, (3,))], "doc_id long, text string, `a``b` int, c struct<`a b`: int>")
    model = {"en": b"the dog and the cat", "fr": b"le chien et le chat"}
    assert identify(docs, model).columns == ["doc_id", "text", "a`b", "c", "lang_pred", "lang_score", "lang_rejected"]
    row = score_toxicity(identify(docs, model), {" idiot ": 3.0}).first()
    assert row.lang_pred == "en" and row.tox_hits == 1 and row["a`b"] == 2 and row.c["a b"] == 3


def test_exceptions_of_a_long_text_take_linear_time():
    score = Scorer({" iditot ": 1.0, folded("idiot"): 2.0, folded("fool"): 1.0}, EXCEPTIONS)
    begin = time.time()
    assert score("idiot proof fool " * 100_000)[1] == 100_000 and time.time() - begin < 2


def test_null_ids_have_a_fold(spark, tmp_path):
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole.unionByName(spark.createDataFrame([(None, "the text of no id", "en", "s", 1)], whole.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r.held_out for r in Q.op6_language(spark, str(tmp_path)).where("doc_id is null").collect()] == [True]
    assert [r.held_out for r in Q.op7_toxicity(spark, str(tmp_path)).where("doc_id is null").collect()] == [False]


def test_toxicity_held_out(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{H}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{H}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{H}/labels.parquet")
    lexicon = fit_lexicon(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).join(labels.select("doc_id"), "doc_id")
    got = [(r.tox_score >= 0.3, toxic[r.doc_id] == 1) for r in score_toxicity(held, lexicon).collect()]
    # learned from 329 toxic rows; on the larger tables of the check tool none of 543 is missed
    assert sum(p for p, t in got if t) >= 0.9 * sum(t for _, t in got)
    assert sum(p for p, t in got if not t) <= 0.005 * sum(not t for _, t in got)


def plain_toxicity(rows, toxic):
    """The lexicon and scores in plain Python: score by doc_id of rows (doc_id, text); toxic by labelled doc_id."""
    fold = lambda t: re.sub(r"[\W\d_]+", " ", t.lower().translate(TABLE)).split()
    bound = lambda b, n: (b / n + 1.645**2 / 2 / n - 1.645 * math.sqrt(b / n * (1 - b / n) / n + 1.645**2 / 4 / n / n)) / (1 + 1.645**2 / n)
    evident = lambda a, n: a >= 3 and a >= 0.95 * n and bound(a, n) >= 0.55
    label = {}
    for d, text in rows:
        if d in toxic and text is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            label[text] = max(label.get(text, 0), toxic[d])
    count = defaultdict(lambda: [0, 0])
    for text, t in label.items():
        ws = set(fold(text))
        for term in {(w, True) for w in ws} | {(w[:n], False) for w in ws for n in (4, 5, 6) if len(w) > n}:
            count[term][1 - t] += 1
    bad = sum(label.values())
    good = len(label) - bad
    weight = {k: math.log((b + 0.5) / (bad + 1)) - math.log((g + 0.5) / (good + 1)) for k, (b, g) in count.items() if evident(b, b + g)}
    heaviest = lambda w: max([weight[k] for k in [(w, True), *((w[:n], False) for n in (4, 5, 6) if len(w) > n)] if k in weight], default=0.0)
    pairs = defaultdict(lambda: [0, 0])
    for text, t in label.items():
        ws = fold(text)
        for p in {p for p in zip(ws, ws[1:]) if heaviest(p[0]) or heaviest(p[1])}:
            pairs[p][1 - t] += 1
    excused = {p for p, (b, g) in pairs.items() if evident(g, b + g)} | {tuple(fold(e)) for e in EXCEPTIONS}
    out = {}
    for d, text in rows:
        ws = fold(text or "")
        free = {k for k, p in enumerate(zip(ws, ws[1:])) if p in excused}
        s = sum(heaviest(w) for k, w in enumerate(ws) if k not in free and k - 1 not in free)
        out[d] = s / (s + math.sqrt(len(ws)) / 2) if ws else 0.0
    return out, len(weight)


def test_toxicity_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    want, n = plain_toxicity(rows, toxic)
    got = {r.doc_id: r.score for r in Q.op7_toxicity(spark, SF).collect()}
    assert n > 20 and got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)


def test_learned_exceptions(spark):
    """A word of toxic texts is harmless beside a word with which only clean texts have it."""
    rows = [(i, f"you vile thing {i}", 1) for i in range(200)] + [(500 + i, f"clean vile weather {i} today", 0) for i in range(8)] + [(1000 + i, f"plain words {i}", 0) for i in range(300)]
    lexicon = fit_lexicon(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert lexicon[folded("vile")] > 0 and lexicon[folded("vile weather")] == -1.0 and folded("vile thing") not in lexicon
    score = Scorer(lexicon, ())
    assert score("a vile storm")[1] == 1 and score("vile weather again")[1] == 0 and score("vile weather and a vile man")[1] == 1


def test_toxicity_query_columns(spark):
    got = Q.op7_toxicity(spark, SF).collect()
    assert len({r.doc_id for r in got}) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_folding_and_exceptions():
    assert folded("ID10T") == folded("idiot") == folded("іdіоt") == folded("1d|0t") and folded(" a\n\n B! ") == " a b "
    score = Scorer({folded("idiot"): 5.0, " mor": 4.0, folded("trash"): 3.0}, ("trash can", "idiot proof"))
    assert score("you 1di0t")[:2] == score("You IDIOT!")[:2] and score("you 1di0t")[1] == 1
    assert score("a trash can here")[0] == 0 and score("a trash here")[0] > 0.3 and score("trash can of trash")[1] == 1
    assert score("morons more")[1] == 2 and score("idiotic")[1] == 0
    assert score("idiot " + "word " * 20000)[0] < 0.3 < score("idiot word")[0]
    assert score(None) == score("") == (0.0, 0, 0) and score("?!") == (0.0, 0, 0)


def test_toxicity_odd_rows(spark):
    schema = "doc_id long, text string, toxic string, tox_score int"
    rows = [(i, f"clean words number {i} here", "", 1) for i in range(60)] + [(100 + i, f"clean words and a vile{i} word", "", 1) for i in range(12)] + [(500, None, "", 1), (None, "vile1", "", 1)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(12)] + [(100, 0), (500, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    lexicon = fit_lexicon(docs, labels)
    assert " viie" in lexicon and " clean " not in lexicon
    got = {r.doc_id: r.tox_score for r in score_toxicity(docs, lexicon).collect()}
    assert got[100] > 0.3 and got[0] == got[500] == 0.0 and got[None] > 0.3
    assert fit_lexicon(docs, labels.where("toxic = 0")) == {} and fit_lexicon(docs.limit(0), labels) == {}
    assert {r.tox_score for r in score_toxicity(docs, {}).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), lexicon).count() == 0


def test_toxicity_held_out_by_language(spark):
    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(docs[r.doc_id], toxic[r.doc_id] == 1, r.predicted == 1) for r in Q.op7_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    for lang in ("en", "de", "fr", "es"):
        of = [p for g, t, p in held if g == lang and t]
        assert len(of) > 10 and sum(of) >= 0.8 * len(of), (lang, sum(of), len(of))
    clean = [p for _, t, p in held if not t]
    assert sum(clean) <= 0.005 * len(clean), (sum(clean), len(clean))


def test_toxicity_counts_own_texts(spark):
    """A term of few texts enters however large the rest is; copies of one text are no evidence."""
    rows = [(i, f"plain words number {i} here", 0) for i in range(2000)] + [(5000 + i, f"vile thing {i}", 1) for i in range(1000)]
    rows += [(8000 + i, f"asqueroso texto {i}", 1) for i in range(5)] + [(9000 + i, "copied lines", 1) for i in range(50)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lexicon = fit_lexicon(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert folded("asqueroso") in lexicon and folded("vile") in lexicon
    assert folded("copied") not in lexicon and folded("plain") not in lexicon
