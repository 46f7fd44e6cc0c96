"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding look-alike characters."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from .common import dropped, mapped, written
from .textops import slices

SLICE_BYTES = 1 << 20
# Characters that look like a Latin letter or stand for one, and that letter. Digits and l share
# the letter i, as 1, l and i are taken for each other.
_FOLDS = [
    ("01345789@$", "oieastbgas"),
    ("l|", "ii"),
    ("абвгдезикмнорстухѕіјԁһ", "abbrdeenkmhopctyxsijdh"),
    ("αβγειικνορτυχ", "abyeiikvoptux"),
]
_WIDE = "".join(chr(0xFF41 + k) for k in range(26))
_WIDE_PLAIN = "abcdefghijkimnopqrstuvwxyz"
FOLD_FROM = "".join(a for a, _ in _FOLDS) + _WIDE
FOLD_TO = "".join(b for _, b in _FOLDS) + _WIDE_PLAIN
TABLE = str.maketrans(FOLD_FROM, FOLD_TO)
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Harmless phrases with words that lexicons tend to hold; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "idiot proof", "stupid simple")


def folded(text: str) -> str:
    """Case, look-alikes and substituted digits folded; words apart by one blank, with a blank at both ends."""
    return f" {NOT_LETTERS.sub(' ', text.lower().translate(TABLE)).strip()} "


def folded_words(text: Column) -> Column:
    """The distinct folded words of a text column."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), FOLD_FROM, FOLD_TO)
    return F.array_distinct(F.filter(F.split(low, r"[^\p{L}]+"), lambda w: w != ""))


def _beginnings(words: Column, n: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.lit(" "), F.substring(w, 1, n)))


def _lower_bound(b: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share b / n."""
    p = b / n
    return (p + z * z / 2 / n - z * F.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def _suspects(texts: DataFrame, lexicon: dict[str, float], prefixes: Sequence[int]) -> DataFrame:
    """_toxic and pair for the distinct pairs of neighbouring words of each text of which the lexicon holds one."""
    model = texts.sparkSession.sparkContext.broadcast(set(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = model.value
        hit = lambda w: f" {w} " in terms or any(len(w) > n and f" {w[:n]}" in terms for n in prefixes)
        for batch in batches:
            toxic, pairs = [], []
            for t, text in zip(batch.column("_toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = folded(text).split()
                bad = [hit(w) for w in words]
                found = {f" {words[k]} {words[k + 1]} " for k in range(len(words) - 1) if bad[k] or bad[k + 1]}
                pairs += found
                toxic += [t] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(pairs, pa.string())], names=["_toxic", "term"])

    return texts.select(F.col("_toxic").cast("int").alias("_toxic"), "text").mapInArrow(run, "_toxic int, term string")


def fit_lexicon(docs: DataFrame, labels: DataFrame, max_labelled: int = 60_000, min_docs: int = 3, min_precision: float = 0.95, min_bound: float = 0.55, z: float = 1.645, prefixes: Sequence[int] = (4, 5, 6), seed: int = 3) -> dict[str, float]:
    """Weights of terms from docs (doc_id, text) and labels (doc_id, toxic): the bounded sample of the classifier.

    About max_labelled labelled rows are drawn by seeded hash (all, if there are fewer) and broadcast. A term is
    a folded word (` word `) or the beginning of longer words (` wor`). Its own counts decide, over distinct texts,
    so the size of the corpus and of its languages plays no part: it enters the lexicon if it stands in at least
    min_docs toxic texts, min_precision of its texts are toxic, and the lower confidence bound of that share (z
    standard errors) is min_bound or more. Its weight is the log of its odds. By the same three bounds, the other
    way round, a pair of words of which the lexicon holds one is an exception phrase, with a negative weight. Null
    doc_id, toxic or text takes no part; of repeated labels and texts the highest label counts. No toxic rows: an
    empty lexicon.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n = own.count()
    scale = 1 << 20
    drawn = own.where(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(scale)) < max(1, min(scale, math.ceil(scale * max_labelled / max(n, 1)))))
    drawn = drawn.groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    texts = written(texts.groupBy("text").agg(F.max("_toxic").alias("_toxic")))
    words = folded_words(F.col("text"))
    whole = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    # the empty term stands in every text: its counts are the totals
    terms = F.array_distinct(F.concat(F.array(F.lit("")), whole, *(_beginnings(words, k) for k in prefixes)))

    def counted(found: DataFrame) -> DataFrame:
        toxic = F.when(F.col("_toxic") == 1, 1).otherwise(0)
        return found.groupBy("term").agg(F.sum(toxic).alias("b"), F.sum(1 - toxic).alias("g")).withColumn("both", F.col("b") + F.col("g"))

    def evident(side: str) -> Column:
        k = F.col(side)
        return (k >= min_docs) & (k >= min_precision * F.col("both")) & (_lower_bound(k, F.col("both"), z) >= min_bound)

    counts = counted(texts.select("_toxic", F.explode(terms).alias("term")))
    kept = {r.term: (r.b, r.g) for r in counts.where((F.col("term") == "") | evident("b")).collect()}
    bad, good = kept.pop("", (0, 0))
    lexicon = {t: math.log((b + 0.5) / (bad + 1)) - math.log((g + 0.5) / (good + 1)) for t, (b, g) in sorted(kept.items())}
    harmless = counted(_suspects(texts, lexicon, prefixes)).where(evident("g")).collect() if lexicon else []
    dropped(texts)
    return lexicon | {r.term: -1.0 for r in sorted(harmless)}


class Scorer:
    def __init__(self, lexicon: dict[str, float], exceptions: Sequence[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            term = folded(phrase)
            self.automaton.add_word(term, (len(term), -1.0))
        self.empty = len(self.automaton) == 0
        if not self.empty:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> tuple[float, int, int]:
        """Score in 0..1, hits and words. Each word counts once, with its heaviest term, if no exception covers it."""
        line = folded(text or "")
        n_words = line.count(" ") - 1 if line.strip() else 0
        if not n_words or self.empty:
            return 0.0, 0, n_words
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(line):
            start = end - size + 1
            if weight < 0:
                excused.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        excused.sort()
        reach, i = -1, 0
        for k in sorted(best) if excused else ():
            while i < len(excused) and excused[i][0] <= k:
                reach = max(reach, excused[i][1])
                i += 1
            if k < reach:
                del best[k]
        total = sum(best.values())
        return total / (total + math.sqrt(n_words) / 2), len(best), n_words


def score_toxicity(docs: DataFrame, lexicon: dict[str, float], exceptions: Sequence[str] = EXCEPTIONS) -> DataFrame:
    """docs with tox_score (0 to 1), tox_hits and tox_words added (own columns of these names are replaced).

    The whole text is folded and scanned once. With S the weight of its words found and n its words, the score
    is S / (S + sqrt(n) / 2), so one chance word in a long text weighs little. Null, empty and wordless texts
    score 0; repeated rows score alike; an empty table gives no rows.
    """
    docs = docs.drop("tox_score", "tox_hits", "tox_words")
    model = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model.value, exceptions)
        for b in (part for batch in batches for part in slices(batch, text, SLICE_BYTES)):
            found = [score(t) for t in b.column(text).to_pylist()]
            added = [pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, "tox_score", "tox_hits", "tox_words"])

    return mapped(docs, run, tox_score=DoubleType(), tox_hits=LongType(), tox_words=LongType())
