"""The alignment against a plain walk over both token lists."""

import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cadenza.llm.alignment import ByteTokens, align, batches_of, byte_of_sign, score_links
from cadenza.llm.common import written
from cadenza.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pairs int, groups string, `a``b` int"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain(texts, a, b):
    """Rows by text, token by token, with the links as a list of id pairs."""
    signs, rows = byte_of_sign(), []
    for text in texts:
        raw, ends = (" " + (text or "")).encode(), []
        if text:
            for ids, bytes_of in (
                (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(signs[c] for c in a.id_to_token(i))),
                (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
            ):
                parts = [bytes_of(i) for i in ids]
                if b"".join(parts) == raw:
                    at, spans = 0, []
                    for i, part in zip(ids, parts, strict=True):
                        spans.append((i, at, at + len(part)))
                        at += len(part)
                    ends.append(spans)
        if len(ends) < 2:
            rows.append((0, 0, 0, "", []))
            continue
        x, y = ends
        cuts = sorted({e for _, _, e in x} & {e for _, _, e in y})
        inside = lambda spans, lo, hi: ",".join(str(i) for i, s, _ in spans if lo <= s < hi)
        groups = ";".join(f"{inside(x, lo, hi)}|{inside(y, lo, hi)}" for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True))
        links = [(i, j) for i, s, e in x for j, t, f in y if s < f and t < e]
        rows.append((len(x), len(y), len(cuts), groups, links))
    counts = Counter(p for r in rows for p in r[4])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    return Counter((n, m, g, len(links), text, sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links)) for n, m, g, text, links in rows)


def texts_of(n, seed=5):
    rnd = random.Random(seed)
    parts = ["the", " cat", "Über", " 你好", "😀", "\n", "  ", "\t", "<s>", "<|endoftext|>", "'s", "12,345", "qzx", "▁", "\x00", "ing", "é", "a" * 30]
    return [None, "", " ", "▁", "<s></s>", "same text", "same text"] + ["".join(rnd.choices(parts, k=rnd.randint(1, 40))) for _ in range(n)]


def test_align(spark, tokenizers):
    texts = texts_of(150) + ["word " * 3000]
    rows = [(None if k % 7 == 0 else k, t, 1, "g", 2) for k, t in enumerate(texts)]
    out = align(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B)
    got = Counter(tuple(r) for r in out.select("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect())
    assert got == plain(texts, *tokenizers)
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter(r[0] for r in rows)


def test_batches_of_any_size_count_alike(spark):
    docs = spark.createDataFrame(list(enumerate(texts_of(60))), "doc_id long, text string")
    small, large = (Counter(score_links(written(batches_of(docs.coalesce(1), A, B, size))).collect()) for size in (50, 1 << 22))
    assert small == large


def test_no_rows(spark):
    assert align(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_fast_ids_are_the_files_own(tokenizers):
    tokens = ByteTokens(A)
    assert tokens.fast is not None
    for text in [*texts_of(400, 11)[2:], "x" * 20000, " " * 20000, "?!" * 9000]:
        assert tokens(text) == tokenizers[0].encode(text, add_special_tokens=False).ids


def test_query(spark, tokenizers):
    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").where(F.length("text") < 3000).collect()]
    rows = QUERIES["op13_alignment"](spark, sf)
    assert rows.count() == 200 and rows.where("n_groups = 0").count() == 0
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = align(docs, A, B, describe=lambda g: F.sha2(g, 256)).collect()
    want = Counter((n, m, g, k, sha256(t.encode()).hexdigest() if t else "", best, total) for (n, m, g, k, t, best, total), c in plain(texts, *tokenizers).items() for _ in range(c))
    assert Counter((r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in got) == want
