"""Disc labels and catalogue titles: cleaning, numbers, comparison forms, name markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.functions.text import strip

# Patterns of disc metadata, media formats and edition words in labels.
DISC_WORDS = r"(?i)\b(?:season[\s_]*\d+|s\d{1,2}|disc[\s_]*\d+|d\d{1,2}|volume[\s_]*\d+|part[\s_]*\d+|tv\s+series)\b"
FORMAT_WORDS = (r"(?i)(\s*[-\x{2013}:]\s*)?(?:(?:4K\s+)?Ultra\s+HD(?:\s+Blu[- ]?ray)?|Blu[- ]?ray|\bUHD\b|\bDVD\b|\bBD\b|\b4K\b"
                r"|\b2160p\b|\b1080p\b)[\x{2122}\x{00AE}]*")
EDITION_WORDS = (r"(?i)(\s*[-\x{2013}:,]\s*)?\b(?:\d{1,3}(?:st|nd|rd|th)\s+anniversary(?:\s+edition)?"
                 r"|(?:special|collector'?s|limited|ultimate|deluxe|extended|unrated|remastered|restored|definitive|signature|anniversary"
                 r"|platinum|diamond)\s+edition|(?:director'?s|extended|theatrical|final|international)\s+cut|steelbook)\b")
TRAILING = r"[\s:_-]+$"
TRAILING_YEAR = r"(?:\s*\((\d{4})\)|\s+(\d{4}))\s*$"
SEASON = r"(?i)(?:s|season[\s_]*)(\d+)"
DISC_NUMBER = r"(?i)(?:^|[^a-z0-9])(?:disc[\s_]*|volume[\s_]*|part[\s_]*|d)(\d{1,2})(?:$|[^a-z0-9])"
TV_HINT = r"(?i)(tv\s+series|season[\s_]*\d+|(?:^|[^a-zA-Z])s\d{1,2}(?:[^a-zA-Z0-9]|$))"
MARKERS = (r"(?:^|[^a-z0-9])s0*(\d{1,2})e0*(\d{1,3})(?:$|[^a-z0-9])", r"(?:^|[^a-z0-9])0*(\d{1,2})[x.]0*(\d{1,3})(?:$|[^a-z0-9])")
TITLE_FILE = r"(?i)(?:^|[^a-z0-9])(?:title_)?t(\d{2,3})"
MIN_YEAR, MAX_YEAR = 1880, 2100
UNUSABLE = ("logical_volume_id", "volume_id", "dvd_video", "bluray", "bd_rom", "untitled", "unknown disc")
UNUSABLE_PREFIXES = ("volume_", "disk_", "track_")


def or_else(c: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), other)


def clean_query(title: Column) -> Column:
    """Season, disc and format words removed; the title itself when nothing remains."""
    t = F.regexp_replace(F.regexp_replace(title, "_", " "), DISC_WORDS, "")
    return or_else(strip(F.regexp_replace(F.regexp_replace(t, FORMAT_WORDS, ""), TRAILING, "")), title)


def narrow_query(title: Column) -> Column:
    return or_else(strip(F.regexp_replace(F.regexp_replace(title, EDITION_WORDS, ""), TRAILING, "")), title)


def split_year(title: Column) -> tuple[Column, Column]:
    """(title without a trailing year, year or 0)."""
    t = strip(title)
    found = or_else(F.regexp_extract(t, TRAILING_YEAR, 1), F.regexp_extract(t, TRAILING_YEAR, 2))
    year = F.nullif(found, F.lit("")).cast("int")
    rest = strip(F.regexp_replace(t, TRAILING_YEAR, ""))
    ok = F.coalesce(year.between(MIN_YEAR, MAX_YEAR), F.lit(False)) & (rest != "")
    return F.when(ok, rest).otherwise(t), F.when(ok, year).otherwise(0)


def canonical_title(title: Column, year: Column, season: Column, media_type: Column) -> Column:
    tv = (media_type == "tv") & (season > 0)
    base = F.when(tv, F.concat(title, F.lit(" Season "), F.lpad(season.cast("string"), 2, "0"))).otherwise(title)
    return F.when(F.coalesce(year, F.lit("")) != "", F.concat(base, F.lit(" ("), year, F.lit(")"))).otherwise(base)


def _first_int(pattern: str, *sources: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).try_cast("int") for s in sources], F.lit(0))


def season_number(*sources: Column) -> Column:
    return _first_int(SEASON, *sources)


def disc_number(*sources: Column) -> Column:
    return _first_int(DISC_NUMBER, *sources)


def media_hint(raw: Column) -> Column:
    return F.when(raw.rlike(TV_HINT), "tv").otherwise("")


def comparison_key(text: Column) -> Column:
    """Lower case, & and + spelled out, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[&+]", "and"), r"[^\p{L}\p{Nd}]", "")


def comparison_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def candidate_text(text: Column) -> Column:
    return F.array_join(comparison_tokens(text), " ")


def disc_name(volume: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(volume, r"^\d+_", ""), r"(?i)_S\d+_DISC_\d+$", ""), r"(?i)_TV$", "")
    return strip(F.regexp_replace(v, "_", " "))


def unusable_label(label: Column) -> Column:
    t = strip(label)
    low = F.lower(t)
    bad = (t == "") | low.isin(*UNUSABLE) | t.rlike(r"^\d+$")
    for p in UNUSABLE_PREFIXES:
        bad = bad | low.startswith(p)
    return bad


def episode_markers(text: Column) -> Column:
    """All (season, episode) markers such as s01e02, 1x02 or 1.02 in a name."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def found(p: str) -> Column:
        z = F.arrays_zip(F.regexp_extract_all(low, F.lit(p), 1).alias("s"), F.regexp_extract_all(low, F.lit(p), 2).alias("e"))
        return F.transform(z, lambda m: F.struct(m["s"].cast("int").alias("season"), m["e"].cast("int").alias("episode")))

    return F.array_distinct(F.concat(found(MARKERS[0]), found(MARKERS[1])))


def looks_like_pack(text: Column, season: Column) -> Column:
    low, s = F.lower(text), season.cast("string")
    a = F.concat(F.lit("s0?"), s, F.lit(r"[ ._-]*e\d{1,2}\s*[-–]\s*(?:e)?\d{1,2}"))
    b = F.concat(F.lit(r"\b0?"), s, F.lit(r"[x.]\d{1,2}\s*[-–]\s*\d{1,2}\b"))
    return F.regexp_like(low, a) | F.regexp_like(low, b)


def file_title_id(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, TITLE_FILE, 1), F.lit("")).cast("int")


def last_group_size(raw: Column) -> Column:
    """Characters of the balanced parenthesis group that ends a text, at any depth; 0 when there is none."""
    def step(a: Column, i: Column) -> Column:
        c = F.substr(raw, F.length(raw) - i + 1, F.lit(1))
        depth = a["depth"] + F.when(c == ")", 1).when(c == "(", -1).otherwise(0)
        return F.when(a["size"] > 0, a).otherwise(F.struct(depth.alias("depth"), F.when(depth == 0, i).otherwise(0).alias("size")))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"))
    return F.when(raw.endswith(")"), F.aggregate(F.sequence(F.lit(1), F.length(raw)), start, step)["size"]).otherwise(0)


def catalogue_title(raw: Column) -> Column:
    """Bracket alias, else the text before the bracket, else T of "T (T)", else the name after a volume id, else raw."""
    alias = F.when(raw.contains("["), strip(F.regexp_extract(raw, r"^[^\[]*\[(.+)\][^\]]*$", 1)))
    before = F.when(raw.contains("["), strip(F.substring_index(raw, "[", 1)))
    size = last_group_size(raw)
    left, right = strip(F.left(raw, F.length(raw) - size)), strip(F.substr(raw, F.length(raw) - size + 2, size - 2))
    twice = F.when((size > 0) & (left != "") & (F.lower(left) == F.lower(right)), left)
    head = strip(F.substring_index(raw, "(", 1))
    volume = raw.endswith(")") & raw.rlike(r"^[^(]+\(") & head.contains("_") & (F.upper(head) == head)
    inner = F.when(volume, strip(F.regexp_extract(raw, r"^[^(]+\((.*)\)$", 1)))
    empty = F.lit("")
    return F.coalesce(F.nullif(alias, empty), F.nullif(before, empty), F.nullif(twice, empty), F.nullif(inner, empty), raw)


def normalise_titles(labels: DataFrame) -> DataFrame:
    """(label_id, label, disc_name) to query title, year, season, disc, hint, comparison key and status."""
    named = or_else(disc_name(F.col("label")), F.col("label"))
    title, year = split_year(named)
    query = clean_query(title)
    return labels.select(
        "label_id", "label", query.alias("query"), narrow_query(query).alias("narrow"), year.alias("year"),
        season_number(F.col("label")).alias("season"), disc_number(F.col("label")).alias("disc"), media_hint(F.col("label")).alias("hint"),
        comparison_key(query).alias("key"), F.when(unusable_label(F.col("label")), "unusable").otherwise("ok").alias("status"))
