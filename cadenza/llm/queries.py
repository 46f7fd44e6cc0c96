"""The contract queries of the operators in this package: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .chat import format_chat, read_targets, read_turns
from .common import LOWER, UPPER, WORD, crc_mod, read
from .decontaminate import decontaminate
from .fingerprint import containment, distinct_shingles, fingerprints, likeness, said
from .jaccard import jaccard_classes
from .language import fit_dictionaries, identify
from .license import NOTICES, PHRASES, scan_licenses, template_rows
from .manifest import folded, leaf_digest, manifest, siblings
from .packing import pack
from .sharding import interleaved_shards
from .topk import top_k
from .toxicity import fit_lexicon, score_toxicity
from .urls import judge_urls

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], turns.schema)
    windows = format_chat(turns.unionByName(own))
    digest = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    parts = F.struct(
        "block", "window", F.col("n_own").alias("n"), digest.alias("turns"),
        F.array_join(read_targets(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    by_conv = windows.select("conv_id", parts.alias("p"), F.length("formatted").cast("long").alias("chars")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("p")).alias("p"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows")
    )
    turns_text, loss = F.array_join("p.turns", ""), F.array_join("p.loss", "")
    return by_conv.select(
        "conv_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x.n).alias("n_turns"),
        F.sha2(turns_text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars", "n_windows",
    )


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents").select("doc_id", "text"), n=5, threshold=0.8)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))[0]


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fold = crc_mod(F.col("doc_id"), 5)
    dictionaries = fit_dictionaries(docs.where(fold != 0).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = crc_mod(F.col("doc_id"), 4)
    lexicon = fit_lexicon(docs, read(spark, sf_dir, "labels").where(fold != 2))
    scored = score_toxicity(docs, lexicon)
    return scored.select("doc_id", (fold == 2).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.3).cast("int").alias("predicted"), F.col("tox_hits").alias("n_hits"))


def op8_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleaved_shards(read(spark, sf_dir, "documents"), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), length=2048)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's leaf, its proof, and whether the proof still holds after every fifth row's text was tampered with (rows
    without a doc_id are left as they are)."""
    docs = read(spark, sf_dir, "documents")
    kept = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest(*kept, F.translate("text", UPPER, LOWER)))
    rows = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], carry={"tampered": tampered})
    out = rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))
    own, other = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        said(own).alias("fingerprint"), said(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, F.col("next_sketch")).alias("near_next"),
        containment(own, other).alias("contained_edited"), distinct_shingles(own).alias("n_shingles"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    rows = align(read(spark, sf_dir, "documents").select("doc_id", "text"), a, b, describe=lambda groups: F.sha2(groups, 256))
    return rows.withColumnRenamed("groups", "groups_sha256")


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP4_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def _templates_sql() -> str:
    text = lambda w: "NULL" if w is None else f"'{w}'"
    return ", ".join(f"({k}, '{label}', {str(exact).lower()}, {n}, {i}, {text(a)}, {text(b)}, {text(c)})" for k, label, exact, n, i, a, b, c in template_rows(PHRASES, NOTICES))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
t AS (SELECT * FROM (VALUES {_templates_sql()}) AS v(template, label, exact, n_grams, tpos, t1, t2, t3)),
p AS (SELECT rid, i AS place, w[i + 1] AS w1, w[i + 2] AS w2, w[i + 3] AS w3 FROM (SELECT rid, w, unnest(range(0, len(w) - 1)) AS i FROM d WHERE len(w) > 1)),
h AS (SELECT rid, template, label, exact, n_grams, place - tpos AS diagonal, tpos, place FROM p JOIN t ON w1 = t1 AND w2 = t2 WHERE t3 IS NULL OR t3 = w3),
v AS (SELECT rid, template, label, exact, n_grams, diagonal, list(DISTINCT tpos) AS votes, min(place) AS first, max(place) AS last FROM h GROUP BY ALL),
a AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= CASE WHEN exact THEN 0 ELSE 2 END THEN 0 ELSE 1 END AS apart FROM v),
r AS (SELECT *, sum(apart) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM a),
m AS (SELECT rid, label, exact, n_grams, len(list_distinct(flatten(list(votes)))) / n_grams AS coverage, min(first) AS first, max(last) AS last, min(diagonal) AS diagonal FROM r GROUP BY rid, template, label, exact, n_grams, run),
g AS (SELECT *, CASE WHEN exact THEN coverage = 1 ELSE coverage >= 0.6 AND last - first + 1 <= 1.5 * n_grams + 1 END AS good FROM m),
f AS (SELECT rid, count(*) FILTER (WHERE good AND exact) AS n_base, min(diagonal) FILTER (WHERE good AND exact) AS first_word, max(diagonal) FILTER (WHERE good AND exact) AS last_word,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE good AND exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE good) AS labels, max(coverage) AS score FROM g GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN f USING (rid)
"""


def _rules_sql(host: str, path: str, part: str) -> str:
    ordered = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    cases = " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{k if part == 'verdict' else h + p}'" for k, h, p in ordered)
    return f"CASE {cases} END"


_HOST = f"translate(regexp_extract({{u}}, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
_PATH = "regexp_extract({u}, '://[^/?#]*([^?#]*)', 1)"
OP9_SQL = f"""
WITH RECURSIVE l AS (SELECT split_part(url, '#', 1) AS src, regexp_extract(url, '^[^:/?#]+://[^/?#]*') AS site, regexp_extract(url, '^[^:/?#]+://[^?#]*/') AS folder,
 replace(unnest(list_concat(list_transform(regexp_extract_all(coalesce(html, ''), '(?i)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\\bhref\\s*=\\s*["'']?\\s*([^"''>\\s]+)', 1)),
  list_transform(regexp_extract_all(coalesce(html, ''), '(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\\burl\\s*=\\s*["'']?\\s*([^"''>\\s]+)', 1)))), '&amp;', '&') AS t FROM pages WHERE url IS NOT NULL),
e AS (SELECT src, split_part(CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(src, '^[^:/?#]+:') || t WHEN starts_with(t, '/') THEN site || t
  WHEN regexp_matches(folder, '://[^/]') THEN folder || t ELSE site || '/' || t END, '#', 1) AS dst FROM l WHERE t <> ''),
b AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
c(node, seen) AS (SELECT src, src FROM b UNION SELECT c.node, b.dst FROM c JOIN b ON b.src = c.seen),
k AS (SELECT node, min(seen) AS comp FROM c GROUP BY node),
j AS (SELECT comp, {_rules_sql(_HOST.format(u='node'), _PATH.format(u='node'), 'verdict')} AS v FROM k),
z AS (SELECT comp, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS alias FROM j GROUP BY comp),
o AS (SELECT page_id, url, {_HOST.format(u="coalesce(url, '')")} AS host, {_PATH.format(u="coalesce(url, '')")} AS path FROM pages),
x AS (SELECT *, {_rules_sql('host', 'path', 'rule')} AS rule, {_rules_sql('host', 'path', 'verdict')} AS own FROM o)
SELECT page_id, host, path, rule, coalesce(own, alias, 'allow') AS verdict, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN alias IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM x LEFT JOIN k ON k.node = split_part(url, '#', 1) LEFT JOIN z USING (comp)
"""

def _merkle_sql(source_levels: int = 8, top_levels: int = 6, fanout: int = 16) -> str:
    """Levels of both trees, one CTE each: nodes l{k} and t{k}, runs of siblings r{k} and s{k}; then each row's node,
    folded upwards (f), beside its siblings so far (p). Levels beyond a tree's height have no runs and change nothing."""
    said = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(said, ("doc_id", "source", "lang", "n_chars")), said(text)]) + ")"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {byte}), 4294967295)"
    parts = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf, {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS low, coalesce({crc} % 5 = 0, false) AS hit FROM documents)",
        "l0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d)",
    ]

    def levels(node: str, run: str, count: int) -> None:
        for k in range(count):
            parts.append(f"{run}{k} AS (SELECT tree, i // {fanout} AS i, list(h ORDER BY i) AS hs FROM {node}{k} WHERE n > 1 GROUP BY ALL)")
            parts.append(f"{node}{k + 1} AS (SELECT tree, i, sha256(array_to_string(hs, '')) AS h, count(*) OVER (PARTITION BY tree) AS n FROM {run}{k})")

    levels("l", "r", source_levels)
    parts.append("sub AS (" + " UNION ALL ".join(f"SELECT tree, h FROM l{k} WHERE n = 1" for k in range(source_levels + 1)) + ")")
    parts.append("t0 AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM sub)")
    levels("t", "s", top_levels)
    parts.append("top AS (" + " UNION ALL ".join(f"SELECT h FROM t{k} WHERE n = 1" for k in range(top_levels + 1)) + ")")
    parts.append("p0 AS (SELECT l0.doc_id, l0.tree, leaf, l0.i, t0.i AS j, CASE WHEN hit THEN coalesce(low, leaf) ELSE leaf END AS f, '' AS p FROM l0 JOIN t0 ON t0.name = l0.tree)")
    steps = [(f"r{k}", "p.tree", "p.i", k) for k in range(source_levels)] + [(f"s{k}", "''", "p.j", k) for k in range(top_levels)]
    for k, (run, tree, at, level) in enumerate(steps):
        pos = f"({at} // {fanout**level}) % {fanout}"
        left, right = f"array_to_string(hs[1:{pos}], '')", f"array_to_string(hs[{pos} + 2:], '')"
        parts.append(
            f"p{k + 1} AS (SELECT doc_id, p.tree, leaf, p.i, j, CASE WHEN hs IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN hs IS NULL THEN p ELSE p || {left} || {right} END AS p"
            f" FROM p{k} p LEFT JOIN {run} r ON r.tree = {tree} AND r.i = {at} // {fanout ** (level + 1)})"
        )
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = top.h AS verified FROM p{len(steps)} p JOIN sub USING (tree), top"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_windows, op2_top_k, op3_jaccard_join, op4_decontamination, op5_license_scan, op6_language, op7_toxicity, op8_interleaved_shards, op9_url_filter, op10_best_two_fit, op11_merkle_manifest, op12_fingerprints, op13_alignment)
}
ORACLES: dict[str, str] = {"op2_top_k": OP2_SQL, "op4_decontamination": OP4_SQL, "op5_license_scan": OP5_SQL, "op9_url_filter": OP9_SQL, "op11_merkle_manifest": _merkle_sql()}
