"""Words of texts as columns, query terms, snippets and what pages of HTML link to."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that part words; what is neither these, a letter, a digit nor an apostrophe vanishes.
DIVIDERS = " \t\n\r,.=/\\?&|+-*()[]{}:"
MIN_WORD, MAX_WORD, MAX_COUNT = 3, 30, 255
_PARTING = r"[ \t\n\r,.=/\\?&|+\-*()\[\]{}:]+"
_VANISHING = r"[^\p{L}\p{Nd}' \t\n\r,.=/\\?&|+\-*()\[\]{}:]"


def default_stop_words(spark) -> list[str]:
    """Spark's English and Norwegian stop words."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({*StopWordsRemover.loadDefaultStopWords("english"), *StopWordsRemover.loadDefaultStopWords("norwegian")})


def tokens(text: Column, stop_words: Iterable[str] = (), min_word: int = MIN_WORD, max_word: int = MAX_WORD) -> Column:
    """The words of a text in order: lower case, longer ones cut, short ones and stop words left out."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _VANISHING, ""), _PARTING)
    words = F.transform(F.filter(parts, lambda w: F.length(w) >= min_word), lambda w: F.substring(w, 1, max_word))
    stop = sorted(set(stop_words))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


@dataclass(frozen=True)
class Term:
    """A word of a query: as it is, as a prefix (`word*`), inside words (`*word`) or misspelt (`word~`)."""

    word: str
    prefix: bool = False
    infix: bool = False
    fuzzy: bool = False


def terms(query: str, stop_words: Iterable[str] = (), infix: bool = True, min_word: int = MIN_WORD, max_word: int = MAX_WORD) -> list[Term]:
    """The terms of a query; those that are too short or stop words say nothing and are left out."""
    stop = set(stop_words)
    kept = "".join(c if c.isalnum() or c in "'*~" else " " if c in DIVIDERS else "" for c in query.lower())
    found = []
    for part in kept.split():
        bare = part.replace("*", "").replace("~", "")
        if len(bare) >= min_word and part not in stop:
            part = part[:max_word]
            stripped = part.replace("~", "")
            word = stripped.replace("*", "")
            found.append(Term(word, stripped.endswith("*"), infix and stripped.startswith("*"), "~" in part))
    return found


def snippet(text: Column, words: list[str], length: int = 255, start: str = "[", end: str = "]", dots: str = "...", edits: int = 0) -> Column:
    """A part of the text around the first of `words` that it has, the match between `start` and `end`. If it has none of
    them, the match is its first word that is at most `edits` edits from the first of `words` for which there is one."""
    size = F.length(text)
    at, width = F.lit(0), F.lit(0)
    for word in reversed(words if edits else []):
        near = F.filter(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}']+)"), 1), lambda w: F.levenshtein(F.lower(w), F.lit(word.lower()), edits) >= 0)
        match = F.get(near, 0)
        here = F.regexp_instr(text, F.concat(F.lit(r"(?<![\p{L}\p{Nd}'])"), match, F.lit(r"(?![\p{L}\p{Nd}'])")))
        at, width = F.when(here > 0, here).otherwise(at), F.when(here > 0, F.length(match)).otherwise(width)
    for word in reversed(words):
        here = F.locate(word.lower(), F.lower(text))
        at, width = F.when(here > 0, here).otherwise(at), F.when(here > 0, F.lit(len(word))).otherwise(width)
    first = F.greatest(F.least(at + F.floor(width / 2) - length // 2, size - length + 1), F.lit(1)).cast("int")
    last = F.greatest(F.least(first + length, size + 1), at + width).cast("int")
    part = lambda a, b: F.substring(text, a, F.greatest(b - a, F.lit(0)))
    found = F.concat(
        F.when(first > 1, dots).otherwise(""), part(first, at), F.lit(start), part(at, at + width), F.lit(end),
        part(at + width, last), F.when(last <= size, dots).otherwise(""),
    )
    plain = F.concat(F.substring(text, 1, length), F.when(size > length, dots).otherwise(""))
    return F.when(at > 0, found).otherwise(plain)


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)


def html_images(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<img\s[^>]*?src\s*=\s*["']([^"']*)["']"""), 1)


def html_favicons(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<link\s(?=[^>]*rel\s*=\s*["'][^"']*icon)[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)


def html_urls(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)(?:href|src)\s*=\s*["']([^"']*)["']"""), 1))


def html_rewrite(html: Column, old: str, new: str) -> Column:
    """URLs in attributes that begin with `old` begin with `new`."""
    import re

    return F.regexp_replace(html, r"""(?i)((?:href|src)\s*=\s*["'])""" + re.escape(old), "$1" + new.replace("$", r"\$"))


def html_text(html: Column) -> Column:
    """The text of a page: no comments, scripts, styles or tags; common entities replaced; blanks run together."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))
