"""Text rules: normalisation, ordered keyword families, stems, patterns. Patterns keep to the dialect that engines share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r"
WORD_OR_WORD = r"[0-9A-Za-z_] or [0-9A-Za-z_]"
#: Fixed value: options that state that there is no answer, whole and lower-cased. "none" or "can't walk" are answers.
NA_LIKE = r"^((cannot|can't|unable to|impossible to) (tell|determine|say|know|be determined|be seen)\b.*|not (sure|visible|determinable|clear|applicable|known)|unknown|unclear|undetermined|indeterminate|n/a|none of the above|not enough information)$"


def stripped(text: Column) -> Column:
    """Without white space on either side (trim alone takes spaces)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(stripped(text), r"\s+", " ")


def dedup_key(text: Column) -> Column:
    return F.lower(stripped(text))


def opening(text: Column, words: int = 4) -> Column:
    """The first words, joined by one space."""
    return F.array_join(F.slice(F.split(stripped(text), r"\s+"), 1, words), " ")


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def first_family(text: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first rule whose pattern occurs in the lower-cased text."""
    low, out = F.lower(text), None
    for name, pattern in rules:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return F.lit(other) if out is None else out.otherwise(other)


def stem(word: Column) -> Column:
    """A crude stem: "es" goes from words of five letters or more, else "s" from words of four or more."""
    n = F.length(word)
    cut = F.when(word.endswith("es") & (n >= 5), 2).when(word.endswith("s") & (n >= 4), 1).otherwise(0)
    return F.substring(word, F.lit(1), n - cut)


def is_plural(noun: Column) -> Column:
    return noun.endswith("s") & ~noun.rlike("(ss|us|is)$")


def agreement(noun: Column) -> Column:
    return F.when(is_plural(noun), "are").otherwise("is")


def is_either_or(text: Column) -> Column:
    return text.rlike(WORD_OR_WORD)


def is_na_like(option: Column) -> Column:
    return F.lower(stripped(option)).rlike(NA_LIKE)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
