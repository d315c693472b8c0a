"""Text as columns: words, tokens, sentences, normal forms.

Regular expressions use explicit classes, which Java and RE2 read alike, so
each result can be compared with another engine's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions.series import let

WORD_GAP = "[ \\t\\n\\r]+"
TOKEN = "[\\p{L}\\p{N}_]+"
LETTERS = "\\p{L}+"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words(text: Column) -> Column:
    """White-space separated words (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return matches(F.lower(text), TOKEN)


def content_terms(text: Column) -> Column:
    """Lower-case tokens of more than two characters that aren't numbers."""
    return F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~F.rlike(t, F.lit("^[0-9]+$")))


def characters(text: Column) -> Column:
    """Single characters without white space and punctuation."""
    return F.filter(F.split(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", ""), ""), lambda c: c != "")


def ngrams(items: Column, n: int) -> Column:
    """Joined runs of n items."""

    def runs(x: Column) -> Column:
        last = F.size(x) - n
        found = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", *(F.get(x, i + k) for k in range(n))))
        return F.when(last >= 0, found).otherwise(F.array().cast("array<string>"))

    return let(items, runs)


def sentences(text: Column) -> Column:
    """Parts between runs of end marks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, WORD_GAP, " "))), lambda s: s != "")


def careful_sentences(text: Column) -> Column:
    """Parts that end in a mark and are followed by a capital."""
    flat = F.regexp_replace(text, "\\s+", " ")
    return F.filter(F.split(flat, "(?<=[.!?])\\s+(?=\\p{Lu})"), lambda s: F.trim(s) != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\\n[ \\t]*\\n"), lambda p: F.trim(p) != "")


def sentence_lengths(text: Column) -> Column:
    return F.transform(sentences(text), lambda s: F.size(words(s)))


def html_text(html: Column) -> Column:
    """Visible text: no scripts, styles, comments or tags; white space collapsed."""
    bare = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, "(?s)<!--.*?-->", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, "[ \\t\\n\\r]+", " "))


def url_title(url: Column) -> Column:
    """The last part of a url's path as a title."""
    path = F.regexp_replace(url, "[?#].*$", "")
    last = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(last, "\\.[a-z]+$", ""), "[-_]+", " ")))


def strip_frame(text: Column, start: str, end: str, least: int = 1000) -> Column:
    """Lines between the marks; the whole text if less than ``least`` characters are left."""
    body = F.trim(F.regexp_replace(F.regexp_replace(text, f"(?s)^.*?{start}[^\\n]*\\n", ""), f"(?s)\\n[^\\n]*{end}.*$", ""))
    return F.when(F.length(body) < least, text).otherwise(body)


def strip_ruby(text: Column) -> Column:
    """Japanese text without readings in 《》, notes in ［＃］ and bars before ruby."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "《[^》]*》", ""), "［＃[^］]*］", ""), "｜", "")


def normal_ru(text: Column) -> Column:
    """Lower-case Cyrillic words and hyphens, with one letter for both forms of e."""
    kept = F.regexp_replace(F.translate(F.lower(text), "ё", "е"), "[^\\p{IsCyrillic}\\- \\t\\n\\r]", " ")
    return F.trim(F.regexp_replace(kept, WORD_GAP, " "))


def normal_ar(text: Column) -> Column:
    """Arabic without vowel signs, with one form of alef, ya and ta."""
    return F.translate(F.regexp_replace(text, "[\\x{064B}-\\x{0652}\\x{0670}\\x{0640}]", ""), "أإآىة", "اااي" + "ه")


def normal_zh(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\p{L}\\p{N}]", "")


#: Endings in the order in which they are tried.
RU_ENDINGS = ["иями", "ями", "ами", "иях", "ого", "его", "ому", "ему", "ыми", "ими", "ать", "ять", "ить", "еть", "ешь", "ишь", "ает", "яет", "ала", "ила", "али", "или", "ой", "ей", "ый", "ий", "ая", "яя", "ое", "ее", "ых", "их", "ом", "ем", "ам", "ям", "ах", "ях", "ов", "ев", "ть", "ал", "ил", "а", "я", "о", "е", "ы", "и", "у", "ю", "ь"]


def stem_ru(word: Column) -> Column:
    """The word without the first ending that leaves three characters."""
    return F.coalesce(*(F.when(F.endswith(word, F.lit(e)) & (F.length(word) - len(e) >= 3), F.left(word, F.length(word) - F.lit(len(e)))) for e in RU_ENDINGS), word)


def cyrillic(text: Column, share: float = 0.3, head: int = 5000) -> Column:
    """``ru`` if the head has more Cyrillic letters than ``share`` of its Latin ones, else ``en``."""
    start = F.left(text, F.lit(head))
    return F.when(count(start, "[а-яА-ЯёЁ]") > share * count(start, "[a-zA-Z]"), "ru").otherwise("en")


def weighted_genre(text: Column, title: Column, phrases: dict[str, dict[str, int]], least: int = 10, head: int = 100_000) -> Column:
    """The genre with the largest weighted count of its phrases, at least ``least``; the first of equal ones; else general."""
    body = F.lower(F.concat_ws(" ", F.left(text, F.lit(head)), title))
    scores = {g: sum((count(body, p) * w for p, w in found.items()), F.lit(0)) for g, found in phrases.items()}
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    return F.when(best < least, "general").otherwise(F.coalesce(*(F.when(s == best, F.lit(g)) for g, s in scores.items())))


def scene_breaks(text: Column) -> Column:
    """Scenes between lines of stars, dashes, hashes, or several empty lines."""
    marked = F.regexp_replace(text, "\\n[ \\t]*(\\*[ \\t]*){3,}\\n|\\n[ \\t]*-{3,}[ \\t]*\\n|\\n[ \\t]*#{1,3}[ \\t]*\\n|\\n{4,}", "\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


CHAPTER = "(?im)^[ \\t]*(chapter|chapitre|kapitel|cap[ií]tulo|глава)[ \\t]+([0-9]+|[ivxlc]+)\\b[^\\n]*"


def chapters(text: Column, least: int = 2, otherwise: int = 6) -> Column:
    """Parts between chapter headings; without ``least`` headings, equal parts."""
    marked = F.filter(F.split(F.regexp_replace(text, CHAPTER, "\u0001"), "\u0001"), lambda s: F.trim(s) != "")
    each = F.greatest(F.ceil(F.length(text) / otherwise), F.lit(1)).cast("int")
    equal = F.filter(F.transform(F.sequence(F.lit(0), F.lit(otherwise - 1)), lambda i: F.substring(text, i * each + 1, each)), lambda s: s != "")
    return F.when(count(text, CHAPTER) >= least, marked).otherwise(equal)
