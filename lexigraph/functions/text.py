"""Text expressions: cleaners, tokenisers, splitters, detectors. Character classes are spelled out, as \\w and \\s differ between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(t: Column) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(t, "[ \\t\\n\\r]+"), lambda x: x != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def tokens(t: Column) -> Column:
    """[a-z']+ of the lower-cased text."""
    return F.regexp_extract_all(F.lower(t), F.lit("[a-z']+"), F.lit(0))


def accent_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit("[a-záéíóúüñàèìòùâêîôûäöß]+"), F.lit(0))


def lyric_lines(t: Column) -> Column:
    """Drops what stands before the first 'Lyrics' header, section marks in brackets, a closing '<n>Embed', blank lines; keeps the line structure."""
    t = F.regexp_replace(t, "(?s)^.*?Lyrics\\n", "")
    t = F.regexp_replace(t, "(?i)[0-9]*Embed[ \\t\\n]*$", "")
    t = F.regexp_replace(t, "(?i)You might also like", "")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, "\\[[^\\]]*\\]", "")))
    return F.filter(lines, lambda x: x != "")


def clean_whole(t: Column) -> Column:
    """The whole text without bracketed marks; three or more newlines become two."""
    t = F.regexp_replace(t, "\\[[^\\]]*\\]", "")
    return F.trim(F.regexp_replace(t, "\n{3,}", "\n\n"))


def clean_prose(t: Column) -> Column:
    """Brackets, rules, white space, underscores, tags, quotes, asterisms; the order matters."""
    for pattern, to in (("\\[[^\\]]*\\]", " "), ("-{3,}", " "), ("[ \\t\\r\\n]+", " "), ("_", ""), ("<[^>]+>", " "), ("[\"“”]", ""), ("\\*[ *]*\\*", " "), (" {2,}", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def chunks(t: Column, size: int = 3000, overlap: int = 100) -> Column:
    """Fixed chunks with overlap; the last one may be short. Empty for the empty text."""
    step = size - overlap
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(t, s + 1, F.lit(size)))


def sentences(t: Column) -> Column:
    """Cuts after . ! ? before a capital; keeps 25 to 400 characters and five words or more."""
    cut = F.split(t, "(?<=[.!?])[ \\n]+(?=[A-ZÁÉÍÓÚÑÄÖÜÀÈÊÇ])")
    return F.filter(cut, lambda s: (F.length(s) >= 25) & (F.length(s) <= 400) & (word_count(s) >= 5))


def slug(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normal_title(t: Column) -> Column:
    t = F.lower(F.trim(t))
    for a, b in (("á", "a"), ("é", "e"), ("í", "i"), ("ó", "o"), ("ú", "u"), ("ñ", "n"), ("'", ""), ("’", ""), ("-", " "), ("_", " ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, " +", " "))


#: Marker words of Spanish, English and French; strong Spanish ones; those of the first generation.
SPANISH = [
    "que", "de", "la", "el", "y", "en", "un", "una", "con", "por", "los", "las", "como", "es", "te", "mi", "mis", "tu", "tus", "sin", "sus", "para", "pero", "más", "si", "yo", "me", "se", "lo", "al", "del",
    "ya", "no", "nos", "ni", "muy", "aquí", "allá", "esto", "esta",
]
ENGLISH = [
    "the", "of", "and", "to", "you", "i", "is", "my", "in", "on", "with", "for", "at", "by", "that", "this", "be", "are", "was", "but", "not", "have", "do", "what", "when", "like", "baby", "just", "go",
]
FRENCH = [
    "je", "tu", "le", "la", "et", "de", "les", "un", "une", "ne", "pas", "ce", "que", "est", "mais", "ou", "où", "des", "du", "ses", "mon", "ma", "mes", "ton", "ta", "tes", "son", "sa", "quand", "comment",
]
SPANISH_STRONG = [
    "pa'", "p'", "pa", "tá", "ta", "qué", "cómo", "dónde", "sí", "está", "esté", "soy", "eres", "fue", "muy", "más", "hacer", "haces", "haciendo", "ese", "esa",
]
FIRST = {
    "ES": ["que", "de", "la", "el", "y", "en", "un", "una", "con", "por", "los", "las", "como"],
    "EN": ["the", "of", "and", "to", "you", "i", "is", "my", "in", "on", "with"],
    "FR": ["je", "tu", "le", "la", "et", "de", "les", "un", "une", "ne", "pas"],
}
WORD = "[A-Za-zÁÉÍÓÚáéíóúÑñüÜçÇ']+"
ACCENTED = "[ñÑáéíóúüÁÉÍÓÚÜ]"
KANA = "[\\u3040-\\u30ff\\u4e00-\\u9fff]"

#: English words that carry no topic (fixed values).
STOP = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "could",
    "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in",
    "into", "is", "it", "its", "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own",
    "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up",
    "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would", "you", "your", "yours", "yourself", "yourselves",
]


def stripped_length(t: Column) -> Column:
    return F.length(F.regexp_replace(t, "^\\s+|\\s+$", ""))


def hits(found: Column, words: list[str]) -> Column:
    """How many different words of a list are there."""
    return F.size(F.array_intersect(found, F.array(*map(F.lit, words))))


def first_of_best(counts: dict[str, Column], least: int) -> Column:
    """The name of the greatest count, the first of equal ones, null below `least`."""
    best = F.greatest(*counts.values())
    out = F.lit(None).cast("string")
    for name in reversed(list(counts)):
        out = F.when((counts[name] == best) & (best >= least), name).otherwise(out)
    return out


def detect(t: Column, found: Column | None = None, fallback: Column | None = None) -> Column:
    """struct(lang, confidence): OTHER below two characters, JA by script, MIXED where two languages or more have a marker and the text four words, else the language of most markers if there are two, the strong ones counting twice and an accented
    letter as one more for Spanish; else the fallback, a struct of the same kind, which is OTHER if none is given (there is no statistical detector here). found: the text's words (WORD, lower-cased), where a column has them already."""
    found = F.regexp_extract_all(F.lower(t), F.lit(f"({WORD})"), F.lit(1)) if found is None else found
    counts = {"ES": hits(found, SPANISH) + 2 * hits(found, SPANISH_STRONG) + t.rlike(ACCENTED).cast("int"), "EN": hits(found, ENGLISH), "FR": hits(found, FRENCH)}
    present = sum(((c >= 1).cast("int") for c in counts.values()), F.lit(0))
    said = lambda lang, p: F.struct(lang.alias("lang"), F.lit(p).alias("confidence"))
    other = said(F.lit("OTHER"), 0.0)
    best = first_of_best(counts, 2)
    out = F.when(best.isNotNull(), said(best, 0.85)).otherwise(other if fallback is None else fallback)
    out = F.when((present >= 2) & (F.size(found) >= 4), said(F.lit("MIXED"), 0.7)).otherwise(out)
    out = F.when(F.size(found) == 0, other).otherwise(out)
    return F.when(t.isNull() | (stripped_length(t) < 2), other).when(t.rlike(KANA), said(F.lit("JA"), 1.0)).otherwise(out)


def detect_first(t: Column, detected: Column | None = None) -> Column:
    """The first generation: OTHER below two characters, JA by script, else what a detector says (without one the language of most markers, OTHER if there are none); but MIXED where four words hold markers of two languages or more. Words stand between spaces."""
    words = F.filter(F.split(F.lower(t), "\\s+"), lambda w: w != "")
    counts = {k: hits(words, v) for k, v in FIRST.items()}
    active = sum(((c >= 1).cast("int") for c in counts.values()), F.lit(0))
    out = F.coalesce(first_of_best(counts, 1) if detected is None else detected, F.lit("OTHER"))
    out = F.when(t.rlike(KANA), "JA").otherwise(out)
    out = F.when(t.isNull() | (stripped_length(t) < 2), "OTHER").otherwise(out)
    return F.when((F.size(words) >= 4) & (active >= 2), "MIXED").otherwise(out)


def strip_tags(t: Column) -> Column:
    for pattern in ("(?s)<(script|style)[^>]*>.*?</(script|style)>", "(?s)<!--.*?-->", "<[^>]+>"):
        t = F.regexp_replace(t, pattern, " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, "[ \\t\\r\\n]+", " "))
