"""Lyric analytics over documents: every document is a song text, every line a lyric line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_up
from ..functions.text import ACCENTED, EN_STOP, FR_STOP, FR_SOUNDS, FR_VOWEL, PLAIN, french_or_english, normal_line, rhyme, safe_name, syllables, words
from ..operators.repeats import repeated_runs
from ..operators.windows import top
from ..sources.tables import LINES, lyric_lines, table, text_sizes
from ..sources.timings import labelled, parsed
from .timeline import r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9'']+', ' ', 'g'), ' ')"


def words_sql(x: str) -> str:
    return f"list_filter(string_split({norm_sql(x)}, ' '), lambda w: w <> '')"


def _in(words_: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words_) + ")"


LANG_SQL = f"""langs AS (SELECT doc_id, CASE WHEN len(list_filter(w, lambda x: x IN {_in(FR_STOP)})) + CASE WHEN regexp_matches(lower(text), '[éèêàùçœ]') THEN 3 ELSE 0 END
 >= len(list_filter(w, lambda x: x IN {_in(EN_STOP)})) THEN 'fr' ELSE 'en' END AS l FROM (SELECT doc_id, text, {words_sql('text')} AS w FROM documents))"""


@query(f"WITH {LANG_SQL} SELECT doc_id, l AS detected FROM langs")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", french_or_english(F.col("text")).alias("detected"))


@query(f"WITH {LINES} SELECT doc_id, pos, {norm_sql('text')} AS norm FROM lines")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyric_lines(spark, sf_dir).select("doc_id", "pos", normal_line(F.col("text")).alias("norm"))


@query(f"""WITH {LINES}, n AS (SELECT doc_id, pos, text, {norm_sql('text')} AS norm FROM lines), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS k FROM n)
SELECT doc_id, norm, arg_min(text, pos) AS first_text, count(*) AS repeats FROM c WHERE k >= 2 GROUP BY 1, 2""")
def lines_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lyric_lines(spark, sf_dir).withColumn("norm", normal_line(F.col("text")))
    g = n.groupBy("doc_id", "norm").agg(F.min_by("text", "pos").alias("first_text"), F.count(F.lit(1)).alias("repeats"))
    return g.where("repeats >= 2")


WORDS_SQL = f"ws AS (SELECT doc_id, {words_sql('text')} AS w FROM documents)"


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", words(normal_line(F.col("text"))).alias("w"))


GRAMS_SQL = f"""{WORDS_SQL}, g AS (SELECT doc_id, array_to_string(w[i + 1:i + n], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM ws, (SELECT unnest([3, 4, 5, 6]) AS n) WHERE len(w) >= n)),
c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 2)"""


def gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 3- to 6-grams of each document; n-grams cross line ends.

    A text's n-grams are sorted by their hashes where it lies, and each stretch of equal ones gives a row, so n-grams are
    neither dealt out nor grouped. Only rows that share their doc_id with others have their n-grams counted together.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(F.xxhash64("doc_id", "text"))
    several = docs.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    of = lambda how: docs.join(several, same, how).select("doc_id", words(normal_line(F.col("text"))).alias("w"))

    def sized(w: DataFrame) -> DataFrame:
        return w.select("doc_id", "w", F.explode(F.array(*map(F.lit, (3, 4, 5, 6)))).alias("size")).where(F.size("w") >= F.col("size"))

    gram = lambda i: F.array_join(F.slice("w", i, F.col("size")), " ")
    starts = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
    # word by word: inside a lambda a slice copies the whole text
    word = lambda i, n: F.xxhash64(*[F.get("w", i + k - 1) for k in range(n)])
    hashed = lambda i: F.when(F.col("size") == 3, word(i, 3)).when(F.col("size") == 4, word(i, 4)).when(F.col("size") == 5, word(i, 5)).otherwise(word(i, 6))
    hashes = F.transform(starts, lambda i: F.struct(hashed(i).alias("h"), i.alias("i")))
    by_hash = sized(of("left_anti")).select("doc_id", "w", "size", F.sort_array(hashes).alias("s"))
    like = lambda x, k: F.coalesce(F.get("s", k).h == x.h, F.lit(False))
    place = lambda x, k: F.struct(x.i.alias("i"), k.alias("k"))
    marked = F.transform("s", lambda x, k: F.when(like(x, k - 1) != like(x, k + 1), place(x, k)))
    ends = by_hash.select("doc_id", "w", "size", F.array_compact(marked).alias("e"))
    # first and last places of stretches take turns; no filter on them, as it would be moved below and sort once a place
    turns = F.when(F.size("e") > 1, F.sequence(F.lit(0), F.size("e") - 2, F.lit(2)))
    stretch = F.transform(turns, lambda j: F.struct(F.get("e", j).i.alias("i"), (F.get("e", j + 1).k - F.get("e", j).k + 1).cast("long").alias("n")))
    at = ends.select("doc_id", "w", "size", F.explode_outer(stretch).alias("x")).where("x IS NOT NULL")
    alone = at.select("doc_id", gram(F.col("x.i")).alias("gram"), "x.n")
    shared = sized(of("left_semi")).select("doc_id", "w", "size", F.explode(starts).alias("i")).select("doc_id", gram(F.col("i")).alias("gram")).groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return alone.unionByName(shared)


@query(f"WITH {GRAMS_SQL} SELECT doc_id, gram, n FROM c")
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_counts(spark, sf_dir)


@query(f"""WITH {GRAMS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n * length(gram) DESC, gram) AS p FROM c)
SELECT a.doc_id, a.gram, a.n FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.doc_id = a.doc_id AND b.p < a.p AND contains(b.gram, a.gram)) QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY p) <= 5""")
def signature_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five weightiest repeated phrases of a document that no weightier one contains."""
    item = F.struct((-F.col("n") * F.length("gram")).alias("weight"), "gram", "n")
    k = gram_counts(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("k"))
    none = F.array().cast("array<struct<weight:bigint,gram:string,n:bigint>>")

    def step(kept, x):
        free = (F.size(kept) < 5) & ~F.exists(kept, lambda h: h.gram.contains(x.gram))
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    # a phrase in one that was left out is also in the one that holds that
    return k.select("doc_id", F.explode(F.aggregate("k", none, step)).alias("x")).select("doc_id", "x.gram", "x.n")


@query(f"WITH {WORDS_SQL} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(len(list_distinct(w)) / greatest(1, len(w)), 6) AS unique_ratio FROM ws")
def unique_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.size(F.array_distinct("w")) / F.greatest(F.lit(1), F.size("w"))
    return doc_words(spark, sf_dir).select("doc_id", F.size("w").cast("long").alias("n_words"), r(ratio, 6).alias("unique_ratio"))


def _syllables_sql(line: str, fr: str) -> str:
    parts = f"list_filter(regexp_split_to_array(regexp_replace(lower({line}), '[^a-zà-ÿœæ'' -]', ' ', 'g'), '[\\s-]+'), lambda w: w <> '')"
    bare = f"list_transform({parts}, lambda w: regexp_replace(w, '^[a-z]''', ''))"
    counted = f"list_transform({bare}, lambda v: {{'w': v, 'n': len(regexp_extract_all(v, '%s'))}})"
    spoken = "list_transform(%s, lambda x: {'w': x.w, 'n': x.n - CASE WHEN x.n > 1 AND %s THEN 1 ELSE 0 END})"
    total = "CAST(coalesce(list_sum(list_transform(%s, lambda y: greatest(1, y.n - CASE WHEN y.n > 1 AND %s THEN 1 ELSE 0 END))), 0) AS BIGINT)"
    french = total % (spoken % (counted % f"[{FR_VOWEL}]+", "regexp_matches(x.w, '[^aeiouy]es?$')"), "length(y.w) > 4 AND regexp_matches(y.w, '[^aeiouy]ent$')")
    english = total % (spoken % (counted % "[aeiouy]+", "regexp_matches(x.w, '[^aeiouy]e$') AND NOT regexp_matches(x.w, 'le$')"), "regexp_matches(y.w, '[^aeiouy]ed$') AND NOT regexp_matches(y.w, '[td]ed$')")
    return f"CASE WHEN {fr} THEN {french} ELSE {english} END"


SYL_SQL = f"{LINES}, {LANG_SQL}, syl AS (SELECT lines.doc_id, pos, text, {_syllables_sql('text', chr(108) + ' = ' + chr(39) + 'fr' + chr(39))} AS n, l FROM lines JOIN langs USING (doc_id))"


def line_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the language is found below the explode, once a document and not once a line
    lang = table(spark, sf_dir, "documents").select("doc_id", french_or_english(F.col("text")).alias("l"), F.split("text", "\r?\n").alias("raws"))
    lines = lang.select("doc_id", "l", F.posexplode("raws").alias("pos", "raw")).select("doc_id", "l", F.col("pos").cast("long").alias("pos"), F.trim("raw").alias("text")).where("text <> ''")
    return lines.withColumn("n", syllables(F.col("text"), F.col("l") == "fr").cast("long"))


@query(f"WITH {SYL_SQL} SELECT doc_id, pos, n FROM syl")
def line_syllable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_syllables(spark, sf_dir).select("doc_id", "pos", "n")


RHYME_EN_SQL = rf"""{LINES}, lw AS (SELECT doc_id, pos, regexp_replace(translate(list_last(regexp_split_to_array(trim(regexp_replace(lower(text), '[^a-zà-ÿœæ'' ]+', ' ', 'g'), ' '), '\s+')), '{ACCENTED}', '{PLAIN}'), '''', '', 'g') AS w FROM lines),
tk AS (SELECT doc_id, pos, CASE WHEN regexp_extract(w, '([aeiouy]+[^aeiouy]*)$', 1) <> '' THEN regexp_extract(w, '([aeiouy]+[^aeiouy]*)$', 1) ELSE regexp_extract(w, '.{{0,2}}$') END AS k FROM lw),
rk AS (SELECT doc_id, pos, upper(regexp_replace(regexp_replace(regexp_replace(k, 'e$', ''), 'ies$|y$', 'i'), 's$', '')) AS k FROM tk)"""


@query(f"WITH {RHYME_EN_SQL} SELECT doc_id, pos, k AS rhyme FROM rk")
def rhyme_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyric_lines(spark, sf_dir).select("doc_id", "pos", rhyme(F.col("text"), F.lit(False)).alias("rhyme"))


_CONS = "[^aeiouyàâäéèêëîïôöùûü]+"


def _sound_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{end}') THEN '{sound}'" for end, sound in FR_SOUNDS) + " END"


def _rhyme_sql(source: str) -> str:
    """CTEs from `source` (id, pos, text, l) to rk (its columns and k, the rhyme key in the language l)."""
    cons = f"string_split(regexp_extract(c, '({_CONS})$', 1), '')"
    once = f"array_to_string(list_filter({cons}, lambda x, i: i = 1 OR x <> {cons}[i - 1]), '')"
    sound = _sound_sql(f"regexp_replace(c, '{_CONS}$', '')")
    return rf"""lw AS (SELECT *, list_last(regexp_split_to_array(trim(regexp_replace(lower(text), '[^a-zà-ÿœæ'' ]+', ' ', 'g'), ' '), '\s+')) AS last FROM {source}),
tk AS (SELECT *, regexp_replace(translate(last, '{ACCENTED}', '{PLAIN}'), '''', '', 'g') AS e, regexp_replace(regexp_replace(last, '^[a-z]''', ''), 'œ', 'e', 'g') AS f FROM lw),
ck AS (SELECT *, CASE WHEN regexp_extract(e, '([aeiouy]+[^aeiouy]*)$', 1) <> '' THEN regexp_extract(e, '([aeiouy]+[^aeiouy]*)$', 1) ELSE regexp_extract(e, '.{{0,2}}$') END AS t,
 regexp_replace(regexp_replace(regexp_replace(f, '(es|ent)$', ''), 'e$', ''), '[stxdzp]+$', '') AS c FROM tk),
vk AS (SELECT *, coalesce({sound}, '') || upper({once}) AS code FROM ck),
rk AS (SELECT *, CASE WHEN l <> 'fr' THEN upper(regexp_replace(regexp_replace(regexp_replace(t, 'e$', ''), 'ies$|y$', 'i'), 's$', '')) WHEN f = '' THEN '' WHEN regexp_matches(f, '(ée?s?|er|ez)$') THEN 'É' WHEN regexp_matches(f, 'ai[st]?$') THEN 'È'
 ELSE coalesce(CASE WHEN regexp_matches(c, '[nm]$') THEN {_sound_sql('c')} END, CASE WHEN code <> '' THEN code ELSE upper(regexp_extract(c, '.{{0,2}}$')) END) END AS k FROM vk)"""


@query(f"WITH {LINES}, fl AS (SELECT *, 'fr' AS l FROM lines), {_rhyme_sql('fl')} SELECT doc_id, pos, k AS rhyme FROM rk")
def rhyme_key_french(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyric_lines(spark, sf_dir).select("doc_id", "pos", rhyme(F.col("text"), F.lit(True)).alias("rhyme"))


# Headers of sections in brackets or by keyword, and the name of text without one.
HEADER = r"^[\[(]\s*([^\])]+)\s*[\])]\s*:?$"
HEADER_WORD = r"(?i)^(refrain|couplet|hook|chorus|verse|pont|bridge|intro|outro|pré-refrain|pre-chorus)\s*\d*\s*:?$"
NO_SECTION = "Texte"
HOOK_SECTION = r"(?i)refrain|hook|chorus"


def sectioned(lines: DataFrame, key: str) -> DataFrame:
    """Lines (key, pos, text) without the headers, each with the section of the last header before it."""
    bracket, word = F.regexp_extract("text", HEADER, 1), F.regexp_extract("text", HEADER_WORD, 1)
    header = F.when(F.col("text").rlike(HEADER), F.trim(bracket)).when(F.col("text").rlike(HEADER_WORD), F.trim(word))
    line = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_header", header)
    return marked.withColumn("section", F.coalesce(F.last("_header", ignorenulls=True).over(line), F.lit(NO_SECTION))).where(F.col("_header").isNull()).drop("_header")


def _sections_sql(source: str, key: str) -> str:
    return f"""hd AS (SELECT *, CASE WHEN regexp_matches(text, '{HEADER}') THEN trim(regexp_extract(text, '{HEADER}', 1)) WHEN regexp_matches(text, '{HEADER_WORD}') THEN trim(regexp_extract(text, '{HEADER_WORD}', 1)) END AS header FROM {source}),
sec AS (SELECT * EXCLUDE (header) FROM (SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '{NO_SECTION}') AS section FROM hd) WHERE header IS NULL)"""


def lettered(lines: DataFrame, key: str) -> DataFrame:
    """Lines (key, pos, section, k) with the letter of their rhyme by first appearance in the section, and whether one of
    the two lines before or after in the section has the same rhyme."""
    first = lines.withColumn("first", F.min("pos").over(Window.partitionBy(key, "section", "k")))
    line = Window.partitionBy(key, "section").orderBy("pos")
    near = F.lit(False)
    for step in (1, 2):
        near = near | F.coalesce(F.col("k") == F.lag("k", step).over(line), F.lit(False)) | F.coalesce(F.col("k") == F.lead("k", step).over(line), F.lit(False))
    order = F.dense_rank().over(Window.partitionBy(key, "section").orderBy("first")) - 1
    return first.withColumns({"letter": F.char(65 + order % 26), "rhymed": (F.col("k") != "") & near}).drop("first")


def _letters_sql(key: str) -> str:
    return f"""fk AS (SELECT *, min(pos) OVER (PARTITION BY {key}, section, k) AS first FROM rk), dk AS (SELECT *, chr(CAST(65 + (dense_rank() OVER (PARTITION BY {key}, section ORDER BY first) - 1) % 26 AS INTEGER)) AS letter,
 coalesce(k <> '' AND (coalesce(k = lag(k) OVER w, false) OR coalesce(k = lag(k, 2) OVER w, false) OR coalesce(k = lead(k) OVER w, false) OR coalesce(k = lead(k, 2) OVER w, false)), false) AS rhymed FROM fk WINDOW w AS (PARTITION BY {key}, section ORDER BY pos))"""


RHYMES_SQL = f"{LINES}, {LANG_SQL}, ln AS (SELECT lines.*, l FROM lines JOIN langs USING (doc_id)), {_sections_sql('ln', 'doc_id')}, {_rhyme_sql('sec')}, {_letters_sql('doc_id')}"


@query(f"WITH {RHYMES_SQL} SELECT doc_id, pos, letter, rhymed FROM dk")
def rhyme_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rhymes in the language of each text: letters by first appearance in the section, and whether a line rhymes with
    one of the two before or after it there."""
    lines = sectioned(line_syllables(spark, sf_dir), "doc_id").select("doc_id", "pos", "section", rhyme(F.col("text"), F.col("l") == "fr").alias("k"))
    return lettered(lines, "doc_id").select("doc_id", "pos", "letter", "rhymed")


@query(f"WITH {RHYMES_SQL} SELECT doc_id, round(avg(CASE WHEN rhymed THEN 1.0 ELSE 0.0 END), 6) AS density FROM dk GROUP BY doc_id")
def rhyme_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rhyme_letters(spark, sf_dir).groupBy("doc_id").agg(r(F.avg(F.when(F.col("rhymed"), 1.0).otherwise(0.0)), 6).alias("density"))


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as song texts of many sections: each turn is a section, and its role is the header, as a keyword for
    the assistant's (chorus), in square brackets for the user's and in round ones for others. (song, l, pos, text), with the language of the whole text."""
    header = F.when(F.col("role") == "assistant", "CHORUS 2:").when(F.col("role") == "user", "[ Verse 1 ]").otherwise(F.concat(F.lit("("), F.coalesce("role", F.lit("none")), F.lit(") :")))
    part = F.concat(header, F.lit("\n"), F.coalesce("text", F.lit("")))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("t"))
    texts = turns.select(F.col("conv_id").alias("song"), F.array_join(F.transform("t", lambda t: t.part), "\n").alias("text"))
    known = texts.select("song", french_or_english(F.col("text")).alias("l"), F.split("text", "\r?\n").alias("raws"))
    lines = known.select("song", "l", F.posexplode("raws").alias("pos", "raw"))
    return lines.select("song", "l", F.col("pos").cast("long").alias("pos"), F.trim("raw").alias("text")).where("text <> ''")


SONGS_SQL = f"""so AS (SELECT conv_id AS song, array_to_string(list(part ORDER BY turn, part), chr(10)) AS text FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'CHORUS 2:' WHEN role = 'user' THEN '[ Verse 1 ]' ELSE '(' || coalesce(role, 'none') || ') :' END || chr(10) || coalesce(text, '') AS part FROM conversations) GROUP BY conv_id),
sw AS (SELECT song, text, {words_sql('text')} AS w FROM so), sl AS (SELECT song, text, CASE WHEN len(list_filter(w, lambda x: x IN {_in(FR_STOP)})) + CASE WHEN regexp_matches(lower(text), '[éèêàùçœ]') THEN 3 ELSE 0 END >= len(list_filter(w, lambda x: x IN {_in(EN_STOP)})) THEN 'fr' ELSE 'en' END AS l FROM sw),
song AS (SELECT song, l, CAST(pos AS BIGINT) AS pos, text FROM (SELECT song, l, unnest(range(0, len(x))) AS pos, trim(unnest(x), ' ') AS text FROM (SELECT song, l, regexp_split_to_array(text, '\\r?\\n') AS x FROM sl)) WHERE text <> '')"""


@query(f"WITH {SONGS_SQL}, {_sections_sql('song', 'song')} SELECT song, section, count(*) AS n, min(pos) AS first FROM sec GROUP BY 1, 2")
def song_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under each section's name."""
    return sectioned(songs(spark, sf_dir), "song").groupBy("song", "section").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


@query(f"WITH {SONGS_SQL}, {_sections_sql('song', 'song')}, {_rhyme_sql('sec')}, {_letters_sql('song')} SELECT song, pos, section, k AS rhyme, letter, rhymed FROM dk")
def song_rhymes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sectioned(songs(spark, sf_dir), "song").withColumn("k", rhyme(F.col("text"), F.col("l") == "fr"))
    return lettered(lines, "song").select("song", "pos", "section", F.col("k").alias("rhyme"), "letter", "rhymed")


@query(r"""WITH t AS (SELECT conv_id, turn, trim(text, ' ') AS text FROM (SELECT conv_id, turn, unnest(regexp_split_to_array('[' || role || ']' || chr(10) || coalesce(text, ''), '\r?\n')) AS text FROM conversations))
SELECT conv_id, turn, regexp_extract(text, '^\[\s*([^\]]+?)\s*\]$', 1) AS section, count(*) AS n FROM t WHERE regexp_matches(text, '^\[\s*[^\]]+\]$') GROUP BY 1, 2, 3""")
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.concat(F.lit("["), "role", F.lit("]\n"), F.coalesce("text", F.lit(""))), "\r?\n")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(lines).alias("raw")).withColumn("text", F.trim("raw"))
    named = t.where(F.col("text").rlike(r"^\[\s*[^\]]+\]$")).withColumn("section", F.regexp_extract("text", r"^\[\s*([^\]]+?)\s*\]$", 1))
    return named.groupBy("conv_id", "turn", "section").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINES}, n AS (SELECT doc_id, pos, {norm_sql('text')} AS norm FROM lines), t AS (SELECT doc_id, arg_min(list_filter(string_split(norm, ' '), lambda w: w <> '')[1], pos) AS title FROM n GROUP BY doc_id)
SELECT n.doc_id, title, count(*) FILTER (WHERE contains(norm, title)) AS drops, coalesce(min(pos) FILTER (WHERE contains(norm, title)), -1) AS first FROM n JOIN t USING (doc_id) WHERE title <> '' GROUP BY 1, 2""")
def title_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of a text stands for its title: how many lines hold it, and which first."""
    n = lyric_lines(spark, sf_dir).select("doc_id", "pos", normal_line(F.col("text")).alias("norm"))
    t = n.groupBy("doc_id").agg(F.min_by(F.get(words(F.col("norm")), F.lit(0)), "pos").alias("title")).where("title <> ''")
    has = F.col("norm").contains(F.col("title"))
    return n.join(t, "doc_id").groupBy("doc_id", "title").agg(F.count_if(has).alias("drops"), F.coalesce(F.min(F.when(has, F.col("pos"))), F.lit(-1)).cast("long").alias("first"))


def _hooks_sql(source: str, key: str) -> str:
    """CTEs from `source` (key, pos, text, section, l) to hs: syllables n, repetitions and the hook score of each line."""
    mean = "coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(1, len(w))"
    return f"""hn AS (SELECT {key}, pos, text, section, {_syllables_sql('text', "l = 'fr'")} AS n, {norm_sql('text')} AS norm, {words_sql('text')} AS w FROM {source}), hr AS (SELECT *, count(*) OVER (PARTITION BY {key}, norm) AS reps FROM hn),
hs AS (SELECT *, CAST(floor(100 * (0.3 * CASE WHEN n BETWEEN 4 AND 11 THEN 1.0 WHEN n <= 14 THEN 0.5 ELSE 0.1 END + 0.3 * least(1.0, (reps - 1) / 2) + 0.15 * CASE WHEN regexp_matches(lower(text), '{ADDRESS}') THEN 1 ELSE 0 END
 + 0.15 * CASE WHEN regexp_matches(section, '{HOOK_SECTION}') THEN 1 ELSE 0 END + 0.1 * CASE WHEN {mean} <= 5 THEN 1.0 WHEN {mean} <= 6.5 THEN 0.6 ELSE 0.3 END) + 0.5) AS BIGINT) AS score FROM hr)"""


# Words that address a listener; the score's weights are 0.3, 0.3, 0.15, 0.15 and 0.1.
ADDRESS = "(^|[^a-z0-9_])(tu|toi|te|t''|you|your|we|nous|on)($|[^a-z0-9_])"
# the same by what stands around a word, with fewer choices
ADDRESSED = "(?<![a-z0-9_])(?:t(?:u|oi|e|')|you|your|we|nous|on)(?![a-z0-9_])"


HOOK_SQL = f"{LINES}, {LANG_SQL}, ln AS (SELECT lines.*, l FROM lines JOIN langs USING (doc_id)), {_sections_sql('ln', 'doc_id')}, {_hooks_sql('sec', 'doc_id')}"


def hook_scores(lines: DataFrame, key: str) -> DataFrame:
    """Hook score of lines (key, pos, text, section, n): singable length, repetition, address to a listener, a section
    that is a hook, short words."""
    s = lines.withColumn("norm", normal_line(F.col("text")))
    reps = F.count(F.lit(1)).over(Window.partitionBy(key, "norm"))
    short = F.when(F.col("n").between(4, 11), 1.0).when(F.col("n") <= 14, 0.5).otherwise(0.1)
    address = F.when(F.lower("text").rlike(ADDRESSED), 1).otherwise(0)
    hook = F.when(F.col("section").rlike(HOOK_SECTION), 1).otherwise(0)
    letters = F.length(F.translate("norm", " ", ""))  # single blanks stand between the words
    mean = letters / (F.length("norm") - letters + 1)
    simple = F.when(mean <= 5, 1.0).when(mean <= 6.5, 0.6).otherwise(0.3)
    rep = F.least(F.lit(1.0), (F.col("reps") - 1) / 2)
    return s.withColumn("reps", reps).withColumn("score", half_up(100 * (0.3 * short + 0.3 * rep + 0.15 * address + 0.15 * hook + 0.1 * simple)))


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hook_scores(sectioned(line_syllables(spark, sf_dir), "doc_id"), "doc_id")


@query(f"WITH {HOOK_SQL} SELECT doc_id, pos, score FROM hs")
def line_hook_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_lines(spark, sf_dir).select("doc_id", "pos", "score")


@query(f"WITH {HOOK_SQL}, d AS (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY doc_id, norm ORDER BY score DESC, pos) = 1) SELECT doc_id, pos, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS INTEGER) AS place FROM d QUALIFY place <= 4")
def hook_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top(scored_lines(spark, sf_dir), ["doc_id", "norm"], [F.desc("score"), F.asc("pos")]).drop("rank")
    return top(best, ["doc_id"], [F.desc("score"), F.asc("pos")], 4, "place").select("doc_id", "pos", "score", "place")


@query(f"""WITH {HOOK_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS total FROM hs),
x AS (SELECT doc_id, i, m, total, sum(n) OVER (PARTITION BY doc_id, m ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s4, CASE m WHEN 2 THEN sum(n) OVER (PARTITION BY doc_id, m ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) WHEN 3 THEN sum(n) OVER (PARTITION BY doc_id, m ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) ELSE sum(n) OVER (PARTITION BY doc_id, m ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) END AS syl,
 CASE m WHEN 2 THEN avg(score) OVER (PARTITION BY doc_id, m ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) WHEN 3 THEN avg(score) OVER (PARTITION BY doc_id, m ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) ELSE avg(score) OVER (PARTITION BY doc_id, m ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) END AS a FROM o, (SELECT unnest([2, 3, 4]) AS m))
SELECT doc_id, i, m, round(a * CASE WHEN syl <= 44 THEN 1 ELSE 0.5 END + m * 2, 6) AS score FROM x WHERE i + m <= total QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(a * CASE WHEN syl <= 44 THEN 1 ELSE 0.5 END + m * 2, 6) DESC, i, m) = 1""")
def lyric_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best run of two to four lines, as one frame per length; the first wins a tie."""
    line = Window.partitionBy("doc_id").orderBy("pos")
    o = scored_lines(spark, sf_dir).withColumns({"i": (F.row_number().over(line) - 1).cast("long"), "total": F.count(F.lit(1)).over(Window.partitionBy("doc_id"))})
    each = []
    for m in (2, 3, 4):
        w = line.rowsBetween(0, m - 1)
        value = F.avg("score").over(w) * F.when(F.sum("n").over(w) <= 44, 1.0).otherwise(0.5) + m * 2
        each.append(F.struct(F.lit(m).alias("m"), F.round(value, 6).alias("score")))
    # all lengths in one pass, so that the lines are scored once
    every = o.select("doc_id", "i", "total", F.array(*each).alias("x")).select("doc_id", "i", "total", F.explode("x").alias("x")).where(F.col("i") + F.col("x.m") <= F.col("total")).select("doc_id", "i", "x.m", "x.score")
    return top(every, ["doc_id"], [F.desc("score"), F.asc("i"), F.asc("m")]).select("doc_id", "i", "m", "score")


SONG_HOOKS_SQL = f"{SONGS_SQL}, {_sections_sql('song', 'song')}, {_hooks_sql('sec', 'song')}"


def song_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sectioned(songs(spark, sf_dir), "song")
    return hook_scores(lines.withColumn("n", syllables(F.col("text"), F.col("l") == "fr").cast("long")), "song")


@query(f"WITH {SONG_HOOKS_SQL} SELECT song, pos, section, n, score FROM hs")
def song_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song_scores(spark, sf_dir).select("song", "pos", "section", "n", "score")


# Titles of the four new orders of a text.
RESTRUCTURES = ["hook A-A-B-A", "short clip", "call and response", "hook first"]
_ECHO_SQL = r"""{x} || ' (' || array_to_string(list_reverse(list_reverse(regexp_split_to_array(regexp_replace({x}, '[.,!?…]+$', ''), '\s+'))[1:2]), ' ') || ')'"""


@query(f"""WITH {SONG_HOOKS_SQL}, lo AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY song) AS total FROM hs),
u AS (SELECT * FROM lo QUALIFY row_number() OVER (PARTITION BY song, norm ORDER BY score DESC, pos) = 1), c AS (SELECT song, list(text ORDER BY score DESC, pos)[1:2] AS h, arg_min(norm, (-score, pos)) AS hn FROM u GROUP BY song),
x AS (SELECT a.song, a.i, b.i - a.i + 1 AS m, sum(l.score) / (b.i - a.i + 1) * CASE WHEN sum(l.n) <= 44 THEN 1 ELSE 0.5 END + (b.i - a.i + 1) * 2 AS s FROM lo a JOIN lo b ON a.song = b.song AND b.i BETWEEN a.i + 1 AND a.i + 3 JOIN lo l ON l.song = a.song AND l.i BETWEEN a.i AND b.i GROUP BY 1, 2, 3, b.i),
bw AS (SELECT song, i AS best FROM x QUALIFY row_number() OVER (PARTITION BY song ORDER BY round(s, 6) DESC, i, m) = 1),
g AS (SELECT lo.song, array_to_string(list(text ORDER BY i), chr(10)) AS cut FROM lo JOIN bw USING (song) JOIN (SELECT song, i AS fi, section AS fs FROM lo) f ON f.song = lo.song AND f.fi = best WHERE i >= best AND (i < best + 2 OR (i < best + 4 AND section = fs)) GROUP BY 1),
rest AS (SELECT song, array_to_string(list(text ORDER BY pos), chr(10)) AS rest FROM (SELECT lo.song, text, pos, row_number() OVER (PARTITION BY lo.song ORDER BY pos) AS k FROM lo JOIN c USING (song) WHERE norm <> hn) WHERE k <= 8 GROUP BY song),
a AS (SELECT c.song, h[1] AS a, coalesce(h[2], h[1]) AS b FROM c JOIN (SELECT DISTINCT song FROM lo WHERE total >= 2) USING (song))
SELECT song, title, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM (
 SELECT song, '{RESTRUCTURES[0]}' AS title, concat_ws(chr(10), a, a, b, a) AS text FROM a UNION ALL SELECT song, '{RESTRUCTURES[1]}', cut FROM g JOIN a USING (song)
 UNION ALL SELECT song, '{RESTRUCTURES[2]}', concat_ws(chr(10), {_ECHO_SQL.format(x='a')}, {_ECHO_SQL.format(x='b')}, {_ECHO_SQL.format(x='a')}, {_ECHO_SQL.format(x='b')}) FROM a
 UNION ALL SELECT song, '{RESTRUCTURES[3]}', concat_ws(chr(10), a, b, '') || CASE WHEN rest IS NULL THEN '' ELSE chr(10) || rest END FROM a LEFT JOIN rest USING (song))""")
def restructures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four new orders of each text of two lines or more: the best hook with a contrast, the best short stretch of one
    section, hooks with their echoes, and the first other lines after the hooks. Digests and lengths of the texts."""
    line = Window.partitionBy("song").orderBy("pos")
    lo = song_scores(spark, sf_dir).withColumns({"i": (F.row_number().over(line) - 1).cast("long"), "total": F.count(F.lit(1)).over(Window.partitionBy("song"))}).where("total >= 2")
    best = top(lo, ["song", "norm"], [F.desc("score"), F.asc("pos")]).drop("rank")
    place = F.struct((-F.col("score")).alias("s"), "pos", "text", "norm")
    hooks = best.groupBy("song").agg(F.array_sort(F.collect_list(place)).alias("h")).select("song", F.get("h", F.lit(0)).text.alias("a"), F.coalesce(F.get("h", F.lit(1)).text, F.get("h", F.lit(0)).text).alias("b"), F.get("h", F.lit(0)).norm.alias("hook"))
    parts = []
    for m in (2, 3, 4):
        w = line.rowsBetween(0, m - 1)
        value = F.avg("score").over(w) * F.when(F.sum("n").over(w) <= 44, 1.0).otherwise(0.5) + m * 2
        parts.append(lo.select("song", "i", "total", "section", F.lit(m).alias("m"), F.round(value, 6).alias("value")).where(F.col("i") + m <= F.col("total")))
    start = top(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["song"], [F.desc("value"), F.asc("i"), F.asc("m")]).select("song", F.col("i").alias("best"), F.col("section").alias("of"))
    text_of = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x.text), "\n").alias(c)
    inside = (F.col("i") >= F.col("best")) & ((F.col("i") < F.col("best") + 2) | ((F.col("i") < F.col("best") + 4) & (F.col("section") == F.col("of"))))
    cut = lo.join(start, "song").where(inside).groupBy("song").agg(text_of("cut"))
    other = top(lo.join(hooks.select("song", "hook"), "song").where("norm <> hook"), ["song"], [F.asc("pos")], 8).groupBy("song").agg(text_of("rest"))

    def echo(x):
        ws = F.split(F.regexp_replace(x, "[.,!?…]+$", ""), r"\s+")
        return F.concat(x, F.lit(" ("), F.array_join(F.slice(ws, F.greatest(F.lit(1), F.size(ws) - 1), F.lit(2)), " "), F.lit(")"))

    a, b = F.col("a"), F.col("b")
    texts = [F.concat_ws("\n", a, a, b, a), F.col("cut"), F.concat_ws("\n", echo(a), echo(b), echo(a), echo(b)), F.concat(F.concat_ws("\n", a, b, F.lit("")), F.coalesce(F.concat(F.lit("\n"), F.col("rest")), F.lit("")))]
    four = F.explode(F.array(*[F.struct(F.lit(t).alias("title"), x.alias("text")) for t, x in zip(RESTRUCTURES, texts, strict=True)]))
    found = hooks.join(cut, "song").join(other, "song", "left").withColumn("x", four)
    return found.select("song", "x.title", F.md5("x.text").alias("text_md5"), F.length("x.text").cast("long").alias("n_chars"))


@query(f"""WITH w AS (SELECT item_id, unnest(list_distinct({words_sql('text')})) AS w, len(list_distinct({words_sql('text')})) AS n FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(2 * count(*) / (any_value(a.n) + any_value(b.n)), 6) AS dice FROM w a JOIN w b ON a.w = b.w AND a.item_id < b.item_id GROUP BY 1, 2 HAVING 2 * count(*) / (any_value(a.n) + any_value(b.n)) >= 0.35""")
def similar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag-of-words Dice similarity through an inverted index: an equi join on words."""
    bag = F.array_distinct(words(normal_line(F.col("text"))))
    w = table(spark, sf_dir, "benchmark").select("item_id", F.size(bag).alias("n"), F.explode(bag).alias("w"))
    a, b = w.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "w"), w.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "w")
    dice = 2 * F.count(F.lit(1)) / (F.first("na") + F.first("nb"))
    return a.join(b, "w").where("a < b").groupBy("a", "b").agg(dice.alias("d")).where("d >= 0.35").select("a", "b", r(F.col("d"), 6).alias("dice"))


LINE_RUNS_SQL = f"""WITH {LINES}, o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, {words_sql('text')} AS w FROM lines),
c AS (SELECT doc_id, i, len(any_value(w)) AS n, x, count(*) AS c FROM (SELECT doc_id, i, w, unnest(w) AS x FROM o) GROUP BY doc_id, i, x),
p AS (SELECT a.doc_id, a.i, b.i AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i GROUP BY 1, 2, 3 HAVING 2 * sum(least(a.c, b.c)) / (any_value(a.n) + any_value(b.n)) >= 0.75),
g AS (SELECT doc_id, i, j, i - row_number() OVER (PARTITION BY doc_id, j - i ORDER BY i) AS g FROM p)
SELECT doc_id, CAST(min(i) AS BIGINT) AS i, CAST(min(j) AS BIGINT) AS j, count(*) AS n, CAST(least(count(*), any_value(j - i)) AS BIGINT) AS k FROM g GROUP BY doc_id, j - i, g HAVING count(*) >= 2 AND any_value(j - i) >= 2"""


@query(LINE_RUNS_SQL)
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of n >= 2 successive lines i, i + 1, ... of a document that resemble the lines j, j + 1, ...

    Lines are counted without blank ones and resemble each other from a Dice similarity of 0.75 of their words,
    repeated words counted. Of a stretch, the first k lines end before line j, so both runs have no line in common.
    """
    found = repeated_runs(lyric_lines(spark, sf_dir), text_sizes(spark, sf_dir)).where("d >= 2")
    return found.select("doc_id", "i", (F.col("i") + F.col("d")).alias("j"), "n", F.least("n", "d").alias("k"))


@query(f"""WITH {LINES}, o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, text FROM lines WHERE doc_id IS NOT NULL), lr AS ({LINE_RUNS_SQL}),
f AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM lr UNION SELECT DISTINCT doc_id, unnest(range(j, j + n)) AS i FROM lr)
SELECT o.doc_id AS song, o.i, round(o.i * 2.5 + 0.25, 2) AS start, round(o.i * 2.5 + 0.25 + length(text) / 64, 2) AS "end", text, f.i IS NOT NULL AS rep FROM o LEFT JOIN f ON f.doc_id = o.doc_id AND f.i = o.i""")
def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all texts as rows of a timings file (start, end and the quoted text), read back and marked where they repeat."""
    line = Window.partitionBy("doc_id").orderBy("pos")
    o = lyric_lines(spark, sf_dir).where("doc_id IS NOT NULL").select("doc_id", (F.row_number().over(line) - 1).alias("i"), "text")
    start = F.col("i") * 2.5 + 0.25
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(",", F.round(start, 2), F.round(start + F.length("text") / 64, 2), quoted)
    sizes = text_sizes(spark, sf_dir).withColumnRenamed("doc_id", "song")
    return labelled(parsed(o.select(F.col("doc_id").alias("song"), row.alias("row"))).where("problem IS NULL"), sizes)


def _safe_sql(x: str) -> str:
    plain = f"regexp_replace(translate({x}, '{ACCENTED + ACCENTED.upper()}', '{PLAIN + PLAIN.upper()}'), '[–—]', '-', 'g')"
    kept = f"regexp_replace(regexp_replace(regexp_replace({plain}, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
    return f"CASE WHEN {kept} = '' THEN 'file' ELSE {kept} END"


@query(f"SELECT page_id, {_safe_sql('url')} AS name, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_matches(url, '[.]html$') AS is_html FROM pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", safe_name(F.col("url")).alias("name"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.col("url").rlike("[.]html$").alias("is_html"))


@query(r"""SELECT page_id, CASE WHEN s IN ('voix', 'voice', 'vox') THEN 'vocals' WHEN s = 'en' THEN 'english' ELSE regexp_replace(s, '[^a-z0-9]+', '-', 'g') END AS stem FROM (SELECT page_id, lower(regexp_extract(url, '/([a-z]{2})/', 1)) AS s FROM pages)""")
def stem_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.lower(F.regexp_extract("url", "/([a-z]{2})/", 1))
    alias = F.create_map(*[F.lit(x) for pair in (("voix", "vocals"), ("voice", "vocals"), ("vox", "vocals"), ("en", "english")) for x in pair])
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.try_element_at(alias, s), F.regexp_replace(s, "[^a-z0-9]+", "-")).alias("stem"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?…]\s+|\n+'), lambda x: trim(x, ' ') <> '') AS l FROM documents)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n, array_to_string(list_reverse(list_reverse(regexp_split_to_array(trim(l[1], ' '), ' +'))[1:2]), ' ') AS echo FROM s WHERE len(l) > 0""")
def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each text and the echo (last two words) of its first one."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"[.!?…]\s+|\n+"), lambda x: F.trim(x) != "").alias("l"))
    first = F.split(F.trim(F.get("l", F.lit(0))), " +")
    n = F.size(first)
    echo = F.array_join(F.slice(first, F.greatest(F.lit(1), n - 1), F.lit(2)), " ")
    return s.where(F.size("l") > 0).select("doc_id", F.size("l").cast("long").alias("n"), echo.alias("echo"))


@query("SELECT doc_id, n_chars BETWEEN 1 AND 5000 AND lang IN ('fr', 'en') AS accepted, coalesce(TRY_CAST(substr(source, 4) AS BIGINT), -1) AS src, least(500, greatest(10, n_chars)) AS clamped FROM documents")
def source_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ok = F.col("n_chars").between(1, 5000) & F.col("lang").isin("fr", "en")
    return d.select("doc_id", ok.alias("accepted"), F.coalesce(F.substring("source", 4, 100).try_cast("long"), F.lit(-1)).alias("src"), F.least(F.lit(500), F.greatest(F.lit(10), "n_chars")).alias("clamped"))
