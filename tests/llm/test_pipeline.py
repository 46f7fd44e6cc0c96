"""The pipeline, stage by stage, against brute-force decisions over the stage's own input."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from cadenza.llm.common import crc_mod
from cadenza.llm.language import Compressors, fit_dictionaries
from cadenza.llm.toxicity import EXCEPTIONS, Scorer, fit_lexicon

from .helpers import words
from .test_decontaminate import brute
from .test_packing import check, ids_of
from .test_search import brute_classes

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns
            out = out.cache()
            after = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet").where(crc_mod(F.col("doc_id"), 4) != 2)
            score = Scorer(fit_lexicon(docs, labels), EXCEPTIONS)
            assert set(after) == {d for d, r in before.items() if score(r.text)[0] < 0.3} and len(after) < len(before)
        elif name == "language":
            classify = Compressors(fit_dictionaries(docs.where(crc_mod(F.col("doc_id"), 5) != 0)), 1000, 6)
            lang = {d: classify(r.text) for d, r in before.items()}
            assert set(after) == {d for d, (k, m) in lang.items() if k != "und" and m > 0.005}
            assert len(after) >= 0.98 * len(before)
        elif name == "near_duplicates":
            named = brute_classes([(d, r.text) for d, r in before.items()])
            assert set(after) == {d for d, c, *_ in named if d == c} and len(after) < len(before)
        elif name == "decontamination":
            hits = {d: (n, h) for d, n, h, _ in brute([(d, r.text) for d, r in before.items()], items, 10)}
            assert set(after) == {d for d, (n, h) in hits.items() if not h or 2 * h < n}
            for d, r in after.items():
                assert len(words(r.text)) == hits[d][0] - hits[d][1] if hits[d][1] else r == before[d]
            assert any(h for _, h in hits.values())
            assert not any(h for *_, h, _ in brute([(d, r.text) for d, r in after.items() if hits[d][1]], items, 10))
        else:
            check([tuple(r) for r in out.collect()], {d: ids_of(r.text) for d, r in before.items()}, 2048)
        docs = out


def test_run_and_odd_rows(spark, tmp_path):
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    # words of real texts in an order of their own, long enough for their language to show
    one, two = (" ".join(sorted(r.text.split()[:80])) for r in whole.where("lang = 'en' and length(text) > 600").orderBy("doc_id").limit(2).collect())
    odd = [(9001, None, "en", "s", 0), (9002, "", None, None, 0), (9003, whole.first().text, None, "s", 1), (None, one, "en", None, None), (9004, two, "en", "s", 8), (9004, two, "en", "s", 8)]
    docs = whole.unionByName(spark.createDataFrame(odd, whole.schema)).withColumns({"class_key": F.lit("x"), "n_hit": F.lit(1), "_id": F.lit(1), "_key": F.lit("k"), "a`b": F.lit(2), "s.t": F.struct(F.lit(3).alias("a b"))})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in got]
    assert 9001 not in ids and 9002 not in ids and 9003 not in ids and None in ids and ids.count(9004) == 1
    assert {r["offset"] for r in got if r.doc_id == 9004} and len(got) > 50
    for t, schema in (("documents", docs.schema), ("labels", None), ("benchmark", None)):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
