"""Lyric text functions: normalising, language, syllables, rhymes. Columns in, columns out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their base letters, and the stop words that vote for a language.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
FR_STOP = ["je", "tu", "il", "elle", "nous", "vous", "ils", "le", "la", "les", "un", "une", "des", "et", "est", "que", "qui", "pas", "dans", "pour", "sur", "mon", "ma", "mes", "ton", "ta", "tes", "moi", "toi", "avec", "c'est", "j'suis", "ça", "on"]
EN_STOP = ["i", "you", "he", "she", "we", "they", "the", "a", "an", "and", "is", "are", "to", "of", "in", "on", "my", "your", "me", "it", "that", "with", "for", "i'm", "don't", "can't", "love", "baby"]
FR_VOWEL = "aeiouyàâäéèêëîïôöùûüœæ"
# Endings that are not spoken, in French and English, and those of English rhymes with what they become.
FR_MUTE, FR_TAIL = "[^aeiouy]es?$", "[^aeiouy]ent$"
EN_MUTE, EN_MUTE_NOT, EN_TAIL, EN_TAIL_NOT = "[^aeiouy]e$", "le", "[^aeiouy]ed$", "[td]ed$"
EN_RHYME, EN_LEVELS = "([aeiouy]+[^aeiouy]*)$", [("e$", ""), ("ies$|y$", "i"), ("s$", "")]
# French endings with a sound of their own, and the signs that are dropped before others are read.
FR_CLOSED, FR_OPEN, FR_DROPPED = "(ée?s?|er|ez)$", "ai[st]?$", ["(es|ent)$", "e$", "[stxdzp]+$"]


def without_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def plain_line(text: Column) -> Column:
    """Lower case, no accents."""
    return without_accents(F.lower(text))


#: What is no sign of a word, and a word: normal_line puts blanks for the one, what it leaves are the others.
NO_WORD, WORD = "[^a-z0-9']+", "[a-z0-9']+"


def normal_line(text: Column) -> Column:
    """Lower case, no accents, only a-z, 0-9, apostrophes and single blanks."""
    return F.trim(F.regexp_replace(plain_line(text), NO_WORD, " "))


def words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: conditional branches share no work otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def french_or_english(text: Column) -> Column:
    """More stop words win; French accents count three; a tie is French."""
    accents = F.when(F.lower(text).rlike("[éèêàùçœ]"), 3).otherwise(0)

    def decide(w: Column) -> Column:
        votes = lambda stop: F.size(F.filter(w, lambda x: x.isin(stop)))
        return F.when(votes(FR_STOP) + accents >= votes(EN_STOP), "fr").otherwise("en")

    return let(words(normal_line(text)), decide)


def _syllables(bare: Column, vowels: str, mute, tail) -> Column:
    """Vowel groups of each word, less one for a mute ending and one for a silent tail while more than one is left."""
    counted = F.transform(bare, lambda w: F.struct(w.alias("w"), F.regexp_count(w, F.lit(f"[{vowels}]+")).alias("n")))
    spoken = F.transform(counted, lambda x: F.struct(x.w.alias("w"), (x.n - F.when((x.n > 1) & mute(x.w), 1).otherwise(0)).alias("n")))
    return F.aggregate(spoken, F.lit(0), lambda a, x: a + F.greatest(F.lit(1), x.n - F.when((x.n > 1) & tail(x.w), 1).otherwise(0)))


def syllables(line: Column, french: Column) -> Column:
    """Vowel groups of each word less silent endings, at least one a word."""
    clean = F.regexp_replace(F.lower(line), "[^a-zà-ÿœæ' -]", " ")
    parts = F.filter(F.split(clean, r"[\s-]+"), lambda w: w != "")
    bare = F.transform(parts, lambda w: F.regexp_replace(w, "^[a-z]'", ""))
    in_french = _syllables(bare, FR_VOWEL, lambda w: w.rlike(FR_MUTE), lambda w: (F.length(w) > 4) & w.rlike(FR_TAIL))
    in_english = _syllables(bare, "aeiouy", lambda w: w.rlike(EN_MUTE) & ~w.endswith(EN_MUTE_NOT), lambda w: w.rlike(EN_TAIL) & ~w.rlike(EN_TAIL_NOT))
    return F.when(french, in_french).otherwise(in_english)


def _last_word(line: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(line), "[^a-zà-ÿœæ' ]+", " "))
    return F.regexp_extract(clean, r"(\S*)$", 1)


def english_rhyme(line: Column) -> Column:
    """Last vowel group and what follows of the last word, endings levelled, in upper case."""
    last = F.regexp_replace(without_accents(_last_word(line)), "'", "")
    tail = let(last, lambda w: F.coalesce(F.nullif(F.regexp_extract(w, EN_RHYME, 1), F.lit("")), F.regexp_extract(w, ".{0,2}$", 0)))
    return F.upper(reduce(lambda t, level: F.regexp_replace(t, *level), EN_LEVELS, tail))


# French endings and their sounds, the first that fits.
FR_SOUNDS = [("(eaux|eau|aux|au|ô|o)$", "O"), ("(ain|ein|in|ïn|im|un|yn)$", "IN"), ("(an|en|am|em)$", "AN"), ("(on|om)$", "ON"), ("(où|ou)$", "OU"), ("(oi|oî)$", "WA"), ("(ai|ei|è|ê|ë|e)$", "È"), ("(é)$", "É"), ("(û|u)$", "U"), ("(î|ï|i|y)$", "I"), ("(â|à|a)$", "A")]


def _sound(text: Column) -> Column:
    return F.coalesce(*(F.when(text.rlike(end), sound) for end, sound in FR_SOUNDS))


def french_rhyme(line: Column) -> Column:
    """Sound of the last word's end: open and closed e, nasal vowels, then the vowel with its consonants, doubled ones once."""
    last = F.regexp_replace(F.regexp_replace(_last_word(line), "^[a-z]'", ""), "œ", "e")

    def of_stem(w: Column) -> Column:
        stem = F.regexp_replace(w, "[^aeiouyàâäéèêëîïôöùûü]+$", "")
        doubled = F.regexp_extract(w, "([^aeiouyàâäéèêëîïôöùûü]+)$", 1)
        vowel = F.coalesce(let(stem, _sound), F.lit(""))
        code = F.concat(vowel, F.upper(F.regexp_replace(doubled, r"(.)\1+", "$1")))
        plain = F.coalesce(F.nullif(code, F.lit("")), F.upper(F.regexp_extract(w, ".{0,2}$", 0)))
        return F.coalesce(F.when(w.rlike("[nm]$"), _sound(w)), plain)

    def of_word(w: Column) -> Column:
        cut = reduce(lambda t, end: F.regexp_replace(t, end, ""), FR_DROPPED, w)
        return F.when(w == "", "").when(w.rlike(FR_CLOSED), "É").when(w.rlike(FR_OPEN), "È").otherwise(let(cut, of_stem))

    return let(last, of_word)


def rhyme(line: Column, french: Column) -> Column:
    return F.when(french, french_rhyme(line)).otherwise(english_rhyme(line))


def safe_name(name: Column, default: str = "file") -> Column:
    """Accents dropped, dashes levelled, other signs to underscores, repeated ones once."""
    plain = F.regexp_replace(F.translate(name, ACCENTED + ACCENTED.upper(), PLAIN + PLAIN.upper()), "[–—]", "-")
    kept = F.regexp_replace(F.regexp_replace(plain, "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    kept = F.regexp_replace(kept, "^_|_$", "")
    return F.when(kept == "", default).otherwise(kept)


# The stems that are known by name, and other names for one of them.
STEMS = ["vocals", "drums", "bass", "guitar", "piano", "other", "instrumental"]
STEM_ALIASES = {"no vocals": "instrumental", "no_vocals": "instrumental", "accompaniment": "instrumental"}


def stem_of(name: Column) -> Column:
    """The stem a file name tells: what its first brackets hold, or the name before its last dot; other words with hyphens."""
    inside = F.regexp_extract(name, r"\(([^)]+)\)", 1)
    told = F.lower(F.trim(F.when(inside != "", inside).otherwise(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"))))
    aliases = F.create_map(*[F.lit(x) for pair in STEM_ALIASES.items() for x in pair])
    stem = F.coalesce(F.try_element_at(aliases, told), told)
    plain = F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(stem.isin(STEMS), stem).otherwise(F.coalesce(F.nullif(plain, F.lit("")), F.when(name.isNotNull(), "stem")))
