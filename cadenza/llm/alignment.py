"""Alignment of two tokenizers' tokens by the bytes they cover, and how often their tokens are linked in the corpus."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .textops import slices

#: Labels of a byte: 0 none, 1 a token of A ends here, 2 one of B, 3 both.
BOTH = re.compile(rb"[^\x03]*\x03")
#: Texts with a run of so many letters, other signs or blanks go to the slower tokenizer, whose work stays n log n in a run.
RUN = 5000
LONG_RUN = re.compile(rf"(?<!\w)\w{{{RUN}}}|(?<![^\w\s])[^\w\s]{{{RUN}}}|(?<!\s)\s{{{RUN}}}")
BATCH = "batch long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups: string>>, pairs array<long>, counts array<long>, links binary"
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable signs of Latin-1 stand for themselves, the
    other bytes, in order, for the signs from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """ids and token bytes of a byte-level BPE file (tokenizers' JSON). Strings of special tokens are plain text.

    Where every merge makes the entry with the next larger id, the order of ids is the order of merges, and tiktoken gives
    the same ids from the same entries some four times faster; else, and for texts with LONG_RUN, the file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._read, self._own = (lambda: Tokenizer.from_file(path)), None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        signs, vocab = byte_of_sign(), spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        entries = {i: bytes(signs[c] for c in token) for token, i in vocab.items() if token not in special}
        self.bytes = [entries.get(i, b"") for i in range(max(vocab.values()) + 1)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        self.fast = self._fast(entries) if made == sorted(set(made)) else None

    @staticmethod
    def _fast(entries: dict[int, bytes]):
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in entries.items()}, special_tokens={})

    @property
    def own(self):
        if self._own is None:
            self._own = self._read()
            self._own.encode_special_tokens = True
        return self._own

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or (len(text) >= RUN and LONG_RUN.search(text)):
            return self.own.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokens:
    """ids and token bytes of a sentencepiece model; it puts a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def __call__(self, text: str) -> list[int]:
        return self.own.encode(text)


@lru_cache(2)
def loaded(a_path: str, b_path: str) -> tuple[ByteTokens, PieceTokens, np.ndarray, np.ndarray]:
    a, b = ByteTokens(a_path), PieceTokens(b_path)
    return a, b, np.array([len(x) for x in a.bytes], np.int64), np.array([len(x) for x in b.bytes], np.int64)


def tokens_of(text: str | None, a: ByteTokens, b: PieceTokens) -> tuple[np.ndarray, np.ndarray]:
    """Both tokenizers' ids of a text whose bytes both give back whole; else none."""
    if text:
        ids_a, ids_b = a(" " + text), b(text)
        raw = (" " + text).encode()
        if b"".join(map(a.bytes.__getitem__, ids_a)) == raw == b"".join(map(b.bytes.__getitem__, ids_b)):
            return np.array(ids_a, np.int32), np.array(ids_b, np.int32)
    return np.empty(0, np.int32), np.empty(0, np.int32)


def labelled(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The label of every byte of the texts that both lists of tokens spell."""
    ends_a, ends_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    out = np.zeros(int(ends_a[-1]) if len(ends_a) else 0, np.uint8)
    out[ends_a - 1] = 1
    out[ends_b - 1] += 2
    return out


def groups_of(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The end of every span of bytes up to a label `both`, and how many tokens of A and of B end in it."""
    ends = np.cumsum(np.fromiter(map(len, BOTH.findall(labels.tobytes())), np.int64))
    first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    count = lambda bit: np.add.reduceat((labels & bit) // bit, first, dtype=np.int64) if len(ends) else ends
    return ends, count(1), count(2)


def spelled(ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of `a1,a2|b1;a3|b2` of all groups, and how many bytes each group has; last: no semicolon after it."""
    up_a, up_b = np.cumsum(n_a), np.cumsum(n_b)
    at_a = np.arange(len(ids_a)) + np.repeat(up_b - n_b, n_a)
    at_b = np.arange(len(ids_b)) + np.repeat(up_a, n_b)
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    ids[at_a], ids[at_b] = ids_a, ids_b
    sign = np.full(len(ids), ord(","), np.uint8)
    ends = at_b[up_b - 1]
    sign[at_a[up_a - 1]], sign[ends] = ord("|"), ord(";")
    most = len(str(int(ids.max()))) if len(ids) else 1
    digits = np.searchsorted(10 ** np.arange(1, most), ids, side="right") + 1
    size = digits + 1
    size[ends[last]] -= 1
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(most):
        has = digits > k
        out[start[has] + k] = ids[has] // 10 ** (digits[has] - 1 - k) % 10 + ord("0")
    signed = size > digits
    out[(start + digits)[signed]] = sign[signed]
    return out, np.add.reduceat(size, np.concatenate([[0], ends[:-1] + 1])) if len(ends) else size


def batches_of(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = 1 << 19) -> DataFrame:
    """A row for each run of documents with up to slice_bytes of text: their alignments, and the links of all of them as
    distinct pairs (A's id * 2^32 + B's id) with counts and, link by link, the number of its pair (unsigned, of 16 bits where they do, else of 32)."""

    def row(part: pa.RecordBatch, batch: int) -> pa.RecordBatch:
        a, b, size_a, size_b = loaded(a_path, b_path)
        tokens = [tokens_of(t, a, b) for t in part.column("text").to_pylist()]
        n_a, n_b = (np.array([len(x[k]) for x in tokens], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.concatenate([x[k] for x in tokens]).astype(np.int64) for k in (0, 1))
        del tokens
        labels = labelled(ids_a, ids_b, size_a, size_b)
        before = np.concatenate([[0], np.cumsum(size_a[ids_a])])
        stops = before[np.cumsum(n_a)]  # where each document's bytes end
        ends, in_a, in_b = groups_of(labels)
        up = np.searchsorted(ends, stops, side="right")
        n_groups = np.diff(up, prepend=0)
        last = np.zeros(len(ends), bool)
        last[up[n_groups > 0] - 1] = True
        text, sizes = spelled(ids_a, ids_b, in_a, in_b, last)
        offsets = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], up])]
        groups = pa.Array.from_buffers(pa.string(), len(n_a), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)])
        place = np.flatnonzero(labels)
        is_a, is_b = labels[place] & 1, labels[place] >> 1
        pair = (ids_a[np.cumsum(is_a) - is_a] << 32) | ids_b[np.cumsum(is_b) - is_b] if len(place) else np.empty(0, np.int64)
        n_links = np.diff(np.searchsorted(place, stops), prepend=0)
        pairs, links, counts = np.unique(pair, return_inverse=True, return_counts=True)
        own = [part.column("doc_id"), *(pa.array(n, pa.int64()) for n in (n_a, n_b, n_groups, n_links)), groups]
        struct = pa.StructArray.from_arrays(own, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [pa.array([batch], pa.int64()), listed(struct), listed(pa.array(pairs, pa.int64())), listed(pa.array(counts, pa.int64())), pa.array([links.astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes()], pa.binary())],
            names=["batch", "docs", "pairs", "counts", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                yield row(part, number)
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BATCH)


def score_links(batches: DataFrame) -> DataFrame:
    """Per document its alignment, n_best and count_sum, from a written table of batches_of().

    Pairs are counted over all batches; a batch then asks for the counts of its own distinct pairs, so that neither the
    table of all pairs nor all links of the corpus are ever in one place. Only each B id's highest count (no more rows than
    B has ids) is broadcast.
    """
    each = batches.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts")
    counts = written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    best = counts.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = batches.select(F.col("batch").alias("b"), F.explode("pairs").alias("pair")).join(best, "pair").select("b", "pair", "n", "best")

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        docs = own.column("docs").combine_chunks().flatten()
        links = np.frombuffer(own.column("links")[0].as_buffer(), "<u2" if found.num_rows <= 1 << 16 else "<u4")
        order = np.argsort(found.column("pair").to_numpy()) if found.num_rows else np.empty(0, np.int64)
        n, best = (found.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[order][links] for c in ("n", "best"))
        stops = np.concatenate([[0], np.cumsum(docs.field("n_links").to_numpy())])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[stops])
        return pa.table([*docs.flatten(), pa.array(total(best)), pa.array(total(n))], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"])

    return batches.select("batch", "docs", "links").groupBy("batch").cogroup(asked.groupBy("b")).applyInArrow(score, SCORED)


def align(docs: DataFrame, a_path: str, b_path: str, describe: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of every row of docs (doc_id, text).

    groups: `a1,a2|b1;a3|b2,b3`, the ids of A and of B between two successive bytes where a token of each ends; describe
    turns this string into the one that is kept. A link is a pair of an A and a B token that share bytes. count_sum adds up
    how many links of the corpus have the ids of each of the document's links; n_best counts those whose ids have, of all
    pairs with that B id, the highest such count, ties included.

    Null and empty texts and those whose tokens do not give back a space and the text have no tokens: zeros and an empty
    string. Texts are tokenised whole, some 512 kB together; repeated rows and null ids are rows of their own and count as
    often as they come. No rows give no rows.
    """
    batches = batches_of(docs, a_path, b_path)
    kept = F.transform("docs", lambda d: d.withField("groups", F.when(d.n_groups > 0, describe(d.groups)).otherwise("")))
    return score_links(written(batches.withColumn("docs", kept)))
