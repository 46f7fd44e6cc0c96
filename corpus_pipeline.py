"""Corpus pipeline: toxicity, language ID, near duplicates, benchmark decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet to the shared folder and reads again as the next one's docs. All but the last return docs' columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import crc_mod, dropped, read, same_columns, scratch, written
from cadenza.llm.decontaminate import decontaminate
from cadenza.llm.jaccard import keep_one
from cadenza.llm.language import fit_dictionaries, identify
from cadenza.llm.packing import pack
from cadenza.llm.toxicity import fit_lexicon, score_toxicity

TOXIC_FROM = 0.3
#: A document of which this share of words stands in benchmark windows goes; from others the windows are cut.
CONTAMINATED_FROM = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of TOXIC_FROM or more go. Learned from the labelled rows outside the held-out fold."""
    lexicon = fit_lexicon(docs, read(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 4) != 2))
    return same_columns(score_toxicity(docs, lexicon).where(F.col("tox_score") < TOXIC_FROM), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or with narrow margins go; a missing lang is filled with the prediction."""
    dictionaries = fit_dictionaries(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    kept = identify(docs, dictionaries).where(~F.col("lang_rejected"))
    return same_columns(kept.withColumn("lang", F.coalesce("lang", "lang_pred")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of word 5-gram Jaccard similarity 0.8 or more stays, that of the smallest doc_id."""
    return keep_one(docs, n=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of texts; documents that consist of them by half or more go."""
    found = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < CONTAMINATED_FROM * F.col("n_words")))
    hit = F.col("n_hit") > 0
    cut = {"text": F.when(hit, F.col("clean_text")).otherwise(F.col("text")), "n_chars": F.when(hit, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))}
    return same_columns(kept.withColumns(cut), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of at most 2048 ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Compression, MinHash and packing can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's tables go when its output is written, and that when the next one's is."""
    docs, last = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scratch(spark) as kept:
            docs = written(stage(spark, docs, sf_dir))
            kept.append(docs)
        if last is not None:
            dropped(last)
        last = docs
    return docs
