"""Language tags: two- and three-letter codes, names, and the tag priority of media streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Supported languages as (name, two-letter, three-letter, other three-letter codes).
LANGUAGES = (
    ("English", "en", "eng", ()), ("Spanish", "es", "spa", ()), ("French", "fr", "fra", ("fre",)),
    ("German", "de", "deu", ("ger",)), ("Italian", "it", "ita", ()), ("Portuguese", "pt", "por", ()),
    ("Japanese", "ja", "jpn", ()), ("Korean", "ko", "kor", ()), ("Chinese", "zh", "zho", ("chi",)),
    ("Russian", "ru", "rus", ()), ("Arabic", "ar", "ara", ()), ("Hindi", "hi", "hin", ()),
    ("Dutch", "nl", "nld", ("dut",)), ("Polish", "pl", "pol", ()), ("Swedish", "sv", "swe", ()),
    ("Danish", "da", "dan", ()), ("Norwegian", "no", "nor", ("nob", "nno")), ("Finnish", "fi", "fin", ()),
)
TAG_KEYS = ("language", "LANGUAGE", "Language", "language_ietf", "lang", "LANG")
NEUTRAL = ("", "und", "nolang", "unknown")


def _table(pick: int) -> Column:
    cells = []
    for row in LANGUAGES:
        for form in (row[1], row[2], *row[3], row[0].lower()):
            cells += [F.lit(form), F.lit(row[pick])]
    return F.create_map(*cells)


def _key(code: Column) -> Column:
    return F.lower(F.trim(F.coalesce(code, F.lit(""))))


def iso2(code: Column) -> Column:
    k = _key(code)
    return F.coalesce(_table(1)[k], F.when(F.length(k) == 2, k).otherwise(""))


def iso3(code: Column) -> Column:
    k = _key(code)
    return F.coalesce(_table(2)[k], F.when(F.length(k) == 3, k).when(F.length(k) == 2, "und").otherwise(""))


def display_name(code: Column) -> Column:
    k = _key(code)
    return F.coalesce(_table(0)[k], F.upper(k))


def from_tags(tags: Column) -> Column:
    vals = [F.nullif(F.trim(F.regexp_replace(tags[k], r"\x00", "")), F.lit("")) for k in TAG_KEYS]
    return F.coalesce(*vals, F.lit(""))


def allowed_audio(raw: Column) -> Column:
    """English and untagged audio passes."""
    k = _key(raw)
    return k.isin(*NEUTRAL) | (iso2(k) == "en")


def normalise_languages(rows: DataFrame, tag: str) -> DataFrame:
    known = _table(1)[_key(F.col(tag))].isNotNull()
    return rows.select("*", iso2(F.col(tag)).alias("iso2"), iso3(F.col(tag)).alias("iso3"), display_name(F.col(tag)).alias("language_name"),
                       F.when(known, "known").otherwise("unknown").alias("status"))


def unknown_languages(rows: DataFrame, tag: str) -> DataFrame:
    return (normalise_languages(rows, tag).filter("status = 'unknown'").groupBy(F.lower(F.trim(tag)).alias("tag"))
            .agg(F.count(F.lit(1)).alias("n")))


def language_filter(rows: DataFrame, tag: str) -> DataFrame:
    """Adds allowed and the exclusion reason."""
    ok = allowed_audio(F.col(tag))
    return rows.withColumns({"allowed": ok, "reason": F.when(~ok, F.concat(F.lit("language="), _key(F.col(tag)), F.lit(" is not english or unknown")))})
