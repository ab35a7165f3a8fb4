"""File names and library paths: sanitising, identity markers, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.functions.text import strip

# Library path markers, and the byte limit of review folder names.
PROVIDER_ID = r"(?i)\[tmdbid-([0-9]+)\]"
SEASON_FOLDER = r"(?i)(?:^|/)season ([0-9]{1,2})(?:/|$)"
EPISODE_FILE = r"(?i)(?:^|[^a-z0-9])s([0-9]{1,2})e([0-9]{1,3})(?:-e([0-9]{1,3}))?(?:[^a-z0-9]|$)"
REVIEW_BYTES = 96


def display_segment(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(name, r"[:/\\]", " "), r"[\x00-\x1f\x7f]", " ")
    s = strip(F.regexp_replace(F.regexp_replace(s, r'[?"<>|*]', ""), r"\s{2,}", " "))
    return F.when(s == "", "manual-import").otherwise(s)


def path_segment(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(name, r"[/\\:*]", "-"), r'[?"<>|]', "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), r"-{2,}", "-"), r"^[-_]+|[-_]+$", "")
    return F.when(s == "", "queue").otherwise(s)


def truncate_bytes(segment: Column, limit: int) -> Column:
    """Longest whole-character prefix of at most `limit` bytes, trimmed of separators when cut."""
    sizes = F.transform(F.sequence(F.lit(1), F.least(F.length(segment), F.lit(limit))), lambda i: F.octet_length(F.substring(segment, F.lit(1), i)))
    keep = F.size(F.filter(sizes, lambda n: n <= limit))
    cut = F.regexp_replace(F.substring(segment, F.lit(1), keep), r"^[-_]+|[-_]+$", "")
    return F.when(F.octet_length(segment) <= limit, segment).otherwise(cut)


def review_folder(reason: Column, fingerprint: Column, item_id: Column) -> Column:
    r = strip(F.coalesce(reason, F.lit("")))
    seg = F.when(r == "", "manual-review").otherwise(F.coalesce(F.nullif(truncate_bytes(path_segment(r), REVIEW_BYTES), F.lit("")), F.lit("manual-review")))
    tail = F.coalesce(F.nullif(F.substring(fingerprint, 1, 8), F.lit("")), F.concat(F.lit("id"), item_id.cast("string")))
    return F.concat(seg, F.lit("_"), tail)


def parse_library_paths(files: DataFrame) -> DataFrame:
    """Identity in library paths: provider id, season, episode range, and the error of inconsistent markers."""
    p = F.regexp_replace("path", r"\\", "/")
    ids = F.array_distinct(F.regexp_extract_all(p, F.lit(PROVIDER_ID), 1))
    base = F.substring_index(p, "/", -1)

    def num(text: Column, pattern: str, g: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, g), F.lit("")).try_cast("int")

    d = files.withColumns({"_ids": ids, "_id": F.get(ids, 0).try_cast("long"), "_folder": num(p, SEASON_FOLDER, 1), "_s": num(base, EPISODE_FILE, 1),
                           "_e": num(base, EPISODE_FILE, 2), "_l": F.coalesce(num(base, EPISODE_FILE, 3), num(base, EPISODE_FILE, 2))})
    tv = F.col("_folder").isNotNull()
    bad = (F.col("_s") <= 0) | (F.col("_folder") != F.col("_s")) | (F.col("_e") <= 0) | (F.col("_l") < F.col("_e"))
    error = (F.when(F.size("_ids") == 0, None).when(F.col("_id").isNull() | (F.col("_id") <= 0), "invalid id")
             .when(F.size("_ids") > 1, "conflicting ids").when(tv & F.col("_s").isNull(), "no episode marker").when(tv & bad, "inconsistent episode marker"))
    d = d.withColumn("error", error)
    good = F.col("error").isNull() & (F.size("_ids") > 0)
    return d.select(*files.columns, (F.size("_ids") > 0).alias("found"), "error", F.when(good, F.col("_id")).alias("provider_id"),
                    *[F.when(good & tv, F.col(c)).otherwise(F.when(good, F.lit(0))).alias(n) for c, n in (("_s", "season"), ("_e", "episode"), ("_l", "episode_end"))])


def plan_library_layout(items: DataFrame, root: str = "/library", films: str = "movies", shows: str = "tv") -> DataFrame:
    """Target folder and file per item and how many items want the same path.

    `items` (item_id, media_type, title, show_title, year, provider_id, season, episode, episode_end, key).
    """
    film = F.lower("media_type").isin("movie", "film")
    year = F.when(F.coalesce("year", F.lit("")) != "", F.concat(F.lit(" ("), F.col("year"), F.lit(")"))).otherwise("")
    mark = F.when(F.col("provider_id") > 0, F.concat(F.lit(" [tmdbid-"), F.col("provider_id").cast("string"), F.lit("]"))).otherwise("")

    def two(c: str) -> Column:
        return F.lpad(F.col(c).cast("string"), F.greatest(F.length(F.col(c).cast("string")), F.lit(2)), F.lit("0"))

    base = F.concat(display_segment(F.coalesce(F.nullif("title", F.lit("")), F.lit("Manual Import"))), year, mark)
    named = display_segment(F.coalesce("show_title", F.lit("")))
    show = F.when(named == "manual-import", display_segment(F.coalesce("title", F.lit("")))).otherwise(named)
    safe = F.when(show == "manual-import", "Manual Import").otherwise(show)
    span = F.when(F.col("episode_end") > F.col("episode"), F.concat(F.lit("-E"), two("episode_end"))).otherwise("")
    numbered = F.concat(safe, F.lit(" - S"), two("season"), F.lit("E"), two("episode"), span)
    open_key = F.concat(show, F.lit(" - "), F.col("key"))
    folder = F.when(film, F.concat_ws("/", F.lit(root), F.lit(films), base)).otherwise(
        F.concat_ws("/", F.lit(root), F.lit(shows), F.concat(show, year, mark), F.concat(F.lit("Season "), two("season"))))
    name = F.when(film, base).otherwise(display_segment(F.when((F.col("season") > 0) & (F.col("episode") > 0), numbered).otherwise(open_key)))
    d = items.select("item_id", folder.alias("folder"), F.concat(name, F.lit(".mkv")).alias("file"))
    same = d.groupBy("folder", "file").agg(F.count(F.lit(1)).alias("wanted_by"))
    return d.join(same, ["folder", "file"])
