"""Language identification by compression with one zstandard dictionary per language."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from .common import mapped
from .textops import slices

SLICE_BYTES = 1 << 20
#: White space, digits and signs all become one blank; case is folded.
NOT_LETTERS = re.compile(r"[\W\d_]+")
UNDETERMINED = "und"


def plain(text: str) -> str:
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def fit_dictionaries(labelled: DataFrame, n_samples: int = 400, sample_chars: int = 256, seed: int = 5) -> dict[str, bytes]:
    """Raw-content dictionary per language from (doc_id, text, lang): the bounded sample of the classifier.

    For every language n_samples rows are drawn by seeded hash and a stretch of sample_chars code points at a
    hashed place of each is taken, so a dictionary has at most n_samples * sample_chars characters whatever the
    corpus. Null text or lang takes no part; a language without letters in its sample gets no dictionary. Each value of
    lang costs that much on the driver and in every task, and one compression of every text: lang names languages, some
    hundreds at most, and is no free text.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return {}
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))  # the text too, or rows of one id, or of none, would be drawn together
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - sample_chars)) + 1
    # of a frequent language only some eight times the sample, chosen by the hash, goes on to be ranked
    scale = 1 << 30
    share = labelled.sparkSession.createDataFrame([(r.lang, min(scale, math.ceil(scale * 8 * n_samples / r.n))) for r in counts], "lang string, share long")
    drawn = rows.withColumn("h", h).join(F.broadcast(share), "lang").where(F.pmod(F.shiftright("h", 20), F.lit(scale)) < F.col("share"))
    drawn = drawn.select("lang", "doc_id", "h", F.substring("text", start.cast("int"), F.lit(sample_chars)).alias("part"))
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "part")
    sample = drawn.withColumn("k", F.row_number().over(first)).where(F.col("k") <= n_samples).select("lang", "k", "part").collect()
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in sample:
        parts.setdefault(r.lang, []).append((r.k, plain(r.part)))
    joined = {lang: " ".join(p for _, p in sorted(ps) if p).encode() for lang, ps in parts.items()}
    # zstandard wants eight bytes or more
    return {lang: raw if len(raw) >= 8 else (raw + b" ") * 8 for lang, raw in sorted(joined.items()) if raw}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], chunk: int, level: int):
        import zstandard

        self.chunk = chunk
        self.by_language = []
        for lang, raw in sorted(dictionaries.items()):
            params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(raw), source_size=chunk, write_content_size=False, write_checksum=False, write_dict_id=False)
            shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.by_language.append((lang, zstandard.ZstdCompressor(dict_data=shared, compression_params=params)))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and margin in 0..1: the smallest total size of the text's chunks wins."""
        clean = plain(text or "")
        if not any(map(str.isalpha, clean)) or not self.by_language:
            return UNDETERMINED, 0.0
        chunks = [clean[i : i + self.chunk].encode() for i in range(0, len(clean), self.chunk)]
        sizes = sorted((sum(len(c.compress(x)) for x in chunks), lang) for lang, c in self.by_language)
        return sizes[0][1], 1.0 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.005, chunk: int = 1000, level: int = 6) -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected added (own columns of these names are replaced).

    The whole text, case-folded and without signs and digits, is compressed in chunks of `chunk` characters
    with each language's dictionary; the language of the smallest sum is chosen (ties: first in order) and the
    score is how much smaller it is than the second (0 to 1). `und` with score 0 stands for null, empty and
    letterless texts, and if nothing was learned. Rejected are those, and texts of any length whose margin is
    min_margin or less. Sizes are whole bytes, so the least difference that passes grows with the text: a short
    text is rejected if two languages tie, one that takes 10 kB needs over 50 bytes. Repeated rows are judged
    alike; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Compressors(model.value, chunk, level)
        for b in (part for batch in batches for part in slices(batch, text, SLICE_BYTES)):
            found = [classify(t) for t in b.column(text).to_pylist()]
            rejected = [lang == UNDETERMINED or margin <= min_margin for lang, margin in found]
            added = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    return mapped(docs, run, lang_pred=StringType(), lang_score=DoubleType(), lang_rejected=BooleanType())
