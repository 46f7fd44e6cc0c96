"""Chat windows, sharding and URL filters against plain Python."""

import hashlib
import math
import random
import struct
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import queries as Q
from cadenza.llm.chat import BOS, END, PAST, TURN, escaped, format_chat, read_targets, read_turns, unescaped
from cadenza.llm.common import copies
from cadenza.llm.sharding import interleaved_shards
from cadenza.llm.urls import judge_urls, link_edges

from .helpers import oracle_rows, spark_rows

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, extra string, block string"


def turns_of(spark, sf=SF):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    return rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def expected(rows):
    by = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in sorted(rows, key=key):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, ts in by.items():
        loss = "".join(t for role, t in ts if role == "assistant")
        out[c] = (len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(loss), sha(loss))
    return out


def test_chat_query_against_python(spark):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in Q.op1_chat_windows(spark, SF).collect()}
    assert got == expected(turns_of(spark))


def test_chat_small_budget_round_trip(spark):
    odd = [
        (1, 0, "system", "be <|turn|> brief ~1 ~0 ~"), (1, 1, "user", None), (1, 2, "assistant", "é[INST]</s>" * 30), (1, 3, "user", "x" * 900),
        (1, 4, "assistant", "<|end|>\n~2\n"), (1, 5, None, "q"), (1, 6, "assistant", ""), (1, 6, "assistant", ""), (1, None, "user", "early"),
        (None, 0, "user", "no id"), (None, 0, "assistant", "no id either"), (2, 0, "assi\nstant", "new\nline"),
    ]
    odd += [(3, t, "assistant" if t % 2 else "user", f"turn {t} " * (t % 7)) for t in range(40)]
    df = spark.createDataFrame([(*r, "e", "b") for r in odd], TURNS)
    w = format_chat(df, budget=120, history_turns=2, history_budget=30, block_budgets=1, bucket_turns=7)
    parts = w.select("*", read_turns(F.col("formatted")).alias("t"), read_targets(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    got = {}
    for r in sorted(parts, key=lambda r: (str(r.conv_id), r.block, r.window)):
        a = got.setdefault(r.conv_id, [[], []])
        a[0] += [tuple(t) for t in r.t]
        a[1] += r.l
        assert r.formatted.startswith(BOS) and r.formatted.count(TURN) == r.n_own == len(r.t)
        assert r.over_budget or r.n_tokens <= 120
        assert r.n_own == 1 or not r.over_budget
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    mine = {c: (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), len("".join(x)), sha("".join(x))) for c, (t, x) in got.items()}
    assert mine == expected([r[:4] for r in odd])
    later = [r for r in parts if r.conv_id == 1 and r.window > 0]
    assert later and all(f"{PAST}system\n" in r.formatted for r in later)
    crossing = [r for r in parts if r.conv_id == 3 and r.block > 0 and r.window == 0]
    assert crossing and all(PAST in r.formatted for r in crossing)
    again = format_chat(df, budget=120, history_turns=2, history_budget=30, block_budgets=1, bucket_turns=1000).select("conv_id", "block", "window", "formatted").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in w.select("conv_id", "block", "window", "formatted").collect())


def greedy(turns, budget, history_turns, history_budget):
    """Windows of (role, text) turns as lists of own turns, by a plain loop."""
    wide = lambda t: (len(t.encode()) - len(t)) / 2
    size = lambda t: math.ceil(wide(t) + (len(t) - wide(t)) / 4) + 4
    system = next((size(t) for r, t in turns if r == "system"), 0)
    out, used = [], 0
    for r, t in turns:
        if not out or used + size(t) > max(1, budget - history_budget - system):
            out.append([])
            used = 0
        out[-1].append((r, t))
        used += size(t)
    return out


def test_chat_windows_follow_tokens_not_turn_numbers(spark):
    sparse = [(1, 300 * k, "assistant" if k % 2 else "user", f"short turn {k}") for k in range(6)]
    tiny = [(2, k, "assistant" if k % 2 else "user", "ok") for k in range(514)]
    chinese = [(3, k, "user", "\u6f22" * 1500) for k in range(4)]
    rng = random.Random(3)
    mixed = [(4, 3 * k, "system" if k == 0 else "assistant" if k % 2 else "user", "word, " * rng.randrange(120)) for k in range(60)]
    df = spark.createDataFrame([(*r, "e", "b") for r in sparse + tiny + chinese + mixed], TURNS)
    got = {}
    for r in sorted(format_chat(df, budget=100_000).collect(), key=lambda r: (r.conv_id, r.block, r.window)):
        got.setdefault(r.conv_id, []).append(r.n_own)
    assert got == {1: [6], 2: [514], 3: [4], 4: [60]}
    small = format_chat(df, budget=2048).select("*", read_turns(F.col("formatted")).alias("t")).collect()
    assert [r.over_budget for r in small if r.conv_id == 3] == [False] * 4 and [r.n_own for r in small if r.conv_id == 3] == [1] * 4
    assert len([r for r in small if r.conv_id == 1]) == 1
    mine = [[tuple(t) for t in r.t] for r in sorted((r for r in small if r.conv_id == 4), key=lambda r: (r.block, r.window))]
    assert mine == greedy([r[2:] for r in mixed], 2048, 2, 256) and len(mine) > 2
    counted = format_chat(df.where("conv_id = 3"), budget=2048, tokens=F.lit(3000)).collect()
    assert all(r.over_budget for r in counted)


@pytest.mark.parametrize("block_budgets", [1, 2, 4, 64, 10**6])
def test_chat_windows_are_the_same_for_every_block(spark, block_budgets):
    """300 equal turns, a conversation of uneven ones with a system turn and some over the budget, and one without an id."""
    rnd = random.Random(4)
    rows = [(1, k, "user" if k % 2 else "assistant", "x", 36) for k in range(300)]
    rows += [(None if k % 3 else 2, k, "system" if k == 3 else "user", f"t{k}", rnd.choice([1, 5, 30, 90, 500])) for k in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    got = format_chat(df, budget=128, history_budget=8, tokens=F.col("n"), block_budgets=block_budgets, bucket_turns=16).collect()
    want = []
    for c in (1, 2, None):
        own = sorted((r[1], r[2], r[4] + 4) for r in rows if r[0] == c)
        room = max(1, 120 - next((n for _, role, n in own if role == "system"), 0))
        used, first = 0, None
        for k, (turn, _, n) in enumerate(own):
            if first is None or used + n > room:
                if first is not None:
                    want.append((c, first, own[k - 1][0]))
                used, first = 0, turn
            used += n
        want.append((c, first, own[-1][0]))
    assert Counter((r.conv_id, r.first_turn, r.last_turn) for r in got) == Counter(want)
    assert sum(r.n_own for r in got) == len(rows)


def test_chat_escapes_and_empty(spark):
    texts = ["", "~", "~1", "<|end|>", "<~1|", "</s>", "[/INST]", "<s><<||"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, u in df.select("t", escaped(F.col("t")), unescaped(escaped(F.col("t")))).collect():
        assert u == t and not any(x in e for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]", END))
    assert format_chat(spark.createDataFrame([], TURNS)).count() == 0


def test_shards_laws(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = Q.op8_interleaved_shards(spark, "/root/testdata/sf0.01").collect()
    size = {r.doc_id: (len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == size and len(got) == len(rows)
    n = Counter(r.shard for r in got)
    assert set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    full = interleaved_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 5)
    mix = Counter((r.shard, r.stratum) for r in full.collect())
    for st, k in Counter(r.source for r in rows).items():
        assert all(abs(mix[(s, st)] - k / 5) <= 1 for s in range(5))


def test_shards_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, rank long, _n string"
    odd = [(1, None, "en", None, 1, ""), (None, "", None, "a", 1, ""), (1, None, "en", None, 1, ""), (2, "é" * 70000, "fr", "a", 2, "")]
    got = interleaved_shards(spark.createDataFrame(odd, schema), 3).collect()
    assert sorted(r.position for r in got) == [0, 1, 2, 3]
    assert sorted(r["size"] for r in got) == [16, 16, 16, 140016]
    assert interleaved_shards(spark.createDataFrame([], schema), 3).count() == 0


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    path = rest.split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, k) for k, h, p in Q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_url_query_against_python(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = Q.op9_url_filter(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = plain_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow")


def test_url_query_against_sql(spark):
    assert spark_rows(Q.op9_url_filter(spark, SF)) == oracle_rows(Q.OP9_SQL, SF)


def test_url_aliases(spark, tmp_path):
    canon = lambda u: f'<html><link href="{u}" rel=x><link rel="canonical" href="{u}"></html>'
    fresh = lambda u: f"<META http-equiv='refresh' content='0; url={u}'>"
    rows = [
        (1, "http://a.net/x#top", canon("http://b.com/de/1")), (2, "http://c.net/", fresh("/y?a=1&amp;b=2")), (3, "http://c.net/y?a=1&b=2", canon("//d.example.org/es/")),
        (4, "http://e.net/1", canon("http://b.com/de/1")), (5, "http://e.org/1", canon("http://e.net/1")), (6, None, canon("http://z.com/de/")), (7, "nothing", None),
        (8, "HTTP://A.COM/de/q", None), (9, "http://f.net/d/p", canon("q.html")), (10, "http://f.net/d/q.html", None), (11, "http://g.net/x", ""), (8, "HTTP://A.COM/de/q", None),
    ]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    extra = spark.createDataFrame([("http://f.net/d/q.html", "http://q.com/de/"), (None, "x"), ("http://g.net/x", "http://g.net/x")], "src string, dst string")
    got = {r.page_id: (r.verdict, r.via) for r in judge_urls(df, Q.URL_RULES, extra).collect()}
    assert got[1] == ("allow", "alias") and got[4] == ("allow", "alias") and got[5] == ("allow", "rule")  # an allowed alias comes before a blocked one
    assert got[2] == got[3] == ("block", "alias")
    assert got[9] == got[10] == ("block", "alias") and got[8] == ("block", "rule")
    assert got[6] == got[7] == got[11] == ("allow", "default")
    assert link_edges(df).count() == 6
    # the oracle judges the same links, without the extra table
    df.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = Counter(con.execute(f"SELECT page_id, verdict, via FROM ({Q.OP9_SQL})").fetchall())
    assert Counter(map(tuple, judge_urls(df, Q.URL_RULES).select("page_id", "verdict", "via").collect())) == want
    assert judge_urls(df.limit(0), Q.URL_RULES).count() == 0 and judge_urls(df, []).count() == 12


def test_url_every_link_of_a_page_counts(spark, tmp_path):
    two = '<link rel=canonical href="http://a.net/"><link rel=canonical href="http://t.com/de/"><meta http-equiv=refresh content="0;url=http://b.net/"><meta http-equiv=refresh content="0;url=http://c.net/">'
    rows = [(1, "http://x.net/", two)] + [(2 + k, f"http://{h}.net/", "") for k, h in enumerate("abcd")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.via) for r in judge_urls(df, Q.URL_RULES).collect()}
    assert link_edges(df).count() == 4 and got == {k: ("block", "alias") for k in (1, 2, 3, 4)} | {5: ("allow", "default")}
    df.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert {r[0]: r[1:] for r in con.execute(f"SELECT page_id, verdict, via FROM ({Q.OP9_SQL})").fetchall()} == got


def test_url_components_against_union_find(spark):
    """Made pages: many chains, one component of a third of all pages, random links; verdicts against a union-find."""
    rng = random.Random(9)
    n = 3000
    url = lambda i: f"http://{'s%d.org' % i if i % 211 == 0 else 's%d.net' % i}/p" if i % 97 else f"http://h{i}.com/de/{i}"
    links = {i: [] for i in range(n)}
    for i in range(1, n // 3):
        links[i].append(rng.randrange(i))  # one tree
    for i in range(n // 3, n - 1):
        if i % 25:
            links[i].append(i + 1)  # chains of up to 25
    for i in range(0, n, 500):
        links[i].append(i)
    canon = lambda i: "".join(f'<link rel="canonical" href="{url(j)}">' for j in links[i])
    df = spark.createDataFrame([(i, url(i), canon(i)) for i in range(n)], "page_id long, url string, html string")
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, js in links.items():
        for j in js:
            root[find(i)] = find(j)
    seen = {}
    for i in range(n):
        seen.setdefault(find(i), set()).add(plain_rule(url(i))[3])
    want = {}
    for i in range(n):
        of = seen[find(i)]
        want[i] = plain_rule(url(i))[3] or ("allow" if "allow" in of or "block" not in of else "block")
    assert {r.page_id: r.verdict for r in judge_urls(df, Q.URL_RULES).collect()} == want
    assert set(want.values()) == {"allow", "block"} and len(seen) > 50


def test_url_open_tags_take_linear_time(spark):
    html = [("<link rel= " * 100_000, 0), ("<link href=" + " " * 1_000_000, 0), ("<meta http-equiv" + " " * 500_000 + "<link rel=canonical href='/a'" * 20_000 + ">", 1), ("<LINK\nREL = 'canonical' HREF=\" /b\">x<a>", 1)]
    pages = spark.createDataFrame([(f"http://h.org/{k}", h) for k, (h, _) in enumerate(html)], "url string, html string")
    begin = time.time()
    got = {r.src: r.dst for r in link_edges(pages).collect()}
    assert got == {"http://h.org/2": "http://h.org/a", "http://h.org/3": "http://h.org/b"} and time.time() - begin < 8


def test_shards_of_equal_rows_are_spread(spark):
    """A third of all rows, equal ones, fall into as many buckets as others do."""
    docs = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("t")).alias("text"), F.lit("s").alias("source"))
    rows = copies(docs.select("doc_id", "text"), "copy").withColumn("b", F.pmod(F.xxhash64("doc_id", "text", "copy"), F.lit(4096)))
    assert rows.groupBy("b").count().agg(F.max("count")).first()[0] < 90 and rows.count() == 9000
    out = interleaved_shards(docs, 40).collect()
    assert len(out) == 9000 and len({(r.shard, r.slot) for r in out}) == 9000


def plain_shards(rows, n_shards, seed=17):
    """(doc_id, crc, shard, slot) of rows (doc_id, text, source): shuffled by hash inside each source, then by fractional rank."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    seen, by_source, line = Counter(), defaultdict(list), []
    for d, text, source in rows:
        raw = (text or "").encode()
        crc, size = zlib.crc32(raw), len(raw) + 16
        copy = seen[d, source, crc, size]
        seen[d, source, crc, size] += 1
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        for v in (d, crc, copy):
            h = h if v is None else xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        h = signed(h)
        by_source[source].append((h % 4096, h, d, crc))
    for source, own in by_source.items():
        own.sort(key=lambda x: x[:2])
        line += [((k + 0.5) / len(own), source is not None, source or "", h, d, crc) for k, (_, h, d, crc) in enumerate(own)]
    line.sort(key=lambda x: x[:4])
    n, out = len(line), []
    for p, (*_, d, crc) in enumerate(line):
        shard = p * n_shards // n
        out.append((d, crc, shard, p - -(-shard * n // n_shards)))
    return Counter(out)


def test_shards_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows += [(None, None, None)] * 50 + [(5, "same", "src1")] * 20 + [(None, "x", "src1"), (3, None, None)]
    for n_shards in (40, 7):
        got = interleaved_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), n_shards).collect()
        assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in got) == plain_shards(rows, n_shards)


def test_url_long_chain(spark):
    n = 40
    df = spark.createDataFrame([(i, f"http://n{i:03}.net/", "") for i in range(n)], "page_id long, url string, html string")
    chain = spark.createDataFrame([(f"http://n{i:03}.net/", f"http://n{i + 1:03}.net/") for i in range(n - 1)] + [("http://n000.net/", "http://t.com/de/")], "src string, dst string")
    assert {r.verdict for r in judge_urls(df, Q.URL_RULES, chain).collect()} == {"block"}
