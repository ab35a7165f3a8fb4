"""Column expressions on text shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lexical_words(text: Column) -> Column:
    """Lower-cased words; apostrophes and hyphens count inside and after a word, not before it."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}][\p{L}\p{Nd}'-]*)"), 1), F.lower)


def lexical_word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}][\p{L}\p{Nd}'-]*)"), 1))


OVERRIDE_TAG = r"\{[^}]*\}"
ANY_TAG = r"</?[a-zA-Z][a-zA-Z0-9]*[^>]*>"


def strip_markup(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, OVERRIDE_TAG, ""), ANY_TAG, "")


def comparable_tokens(text: Column) -> Column:
    """Lower-case words without markup and punctuation: the form in which cues and spoken words are compared."""
    bare = F.regexp_replace(F.lower(strip_markup(text)), r"[^\p{L}\p{Nd}\s\x{00A0}]", "")
    return F.filter(F.split(bare, r"[\s\x{00A0}]+"), lambda t: t != "")


def strip_payload(text: Column) -> Column:
    """Line ends normalised, every tag removed, runs of three or more newlines cut to two, trimmed."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(unix, "<[^>]*>", ""), r"\n{3,}", "\n\n"))
