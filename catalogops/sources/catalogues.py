"""Key catalogues, key-value reports, nested search results, and the identity lookup over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.functions.text import strip
from catalogops.functions.titles import catalogue_title

# Provider prefixes and studio names.
STUDIOS = {
    "sony": "Sony Pictures", "warner": "Warner Bros.", "universal": "Universal Pictures", "disney": "Walt Disney Studios",
    "paramount": "Paramount Pictures", "mgm": "Metro-Goldwyn-Mayer", "fox": "20th Century Studios", "lionsgate": "Lionsgate",
}
YEAR = r"(?:\b|_)((?:19|20)\d{2})(?:\b|_|$)"


def normal_disc_id(raw: Column) -> Column:
    """40 upper-case hex digits, without a 0x prefix; NULL otherwise."""
    s = F.regexp_replace(F.trim(raw), "^(?:0X)?(?:0x)?", "")
    return F.when(s.rlike("^[0-9a-fA-F]{40}$"), F.upper(s))


def parse_key_catalogue(lines: DataFrame) -> DataFrame:
    """(pos, value) lines `id | title | ...` to (disc_id, title); comments skipped, the later line wins."""
    p = F.split(strip(F.col("value")), r"\|", 3)
    d = lines.filter(~strip(F.col("value")).startswith(";")).select("pos", normal_disc_id(F.get(p, 0)).alias("disc_id"), strip(F.get(p, 1)).alias("raw"))
    d = d.filter("disc_id is not null and raw <> ''")
    return d.groupBy("disc_id").agg(F.max_by("raw", "pos").alias("raw")).select("disc_id", catalogue_title(F.col("raw")).alias("title"))


def read_key_catalogue(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path)
    pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return parse_key_catalogue(raw.select(pos.alias("pos"), "value"))


def report_year(*sources: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(s, YEAR, 1), F.lit("")) for s in sources], F.lit(""))


def studio(provider: Column) -> Column:
    low = F.lower(provider)
    out = F.when(F.length(provider) > 3, provider).otherwise("")
    for prefix, name in STUDIOS.items():
        out = F.when(low.startswith(prefix), name).otherwise(out)
    return out


def parse_key_value_reports(reports: DataFrame) -> DataFrame:
    """(report_id, text) of `key: value` lines to one typed row; the last value of a key wins."""
    pairs = F.transform(F.filter(F.split("text", "\n"), lambda x: x.contains(":")),
                        lambda x: F.struct(F.lower(strip(F.substring_index(x, ":", 1))).alias("k"), strip(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    d = reports.withColumn("_p", pairs)

    def last(*keys: str) -> Column:
        hits = F.filter("_p", lambda p: p["k"].isin(*keys))
        return F.when(F.size(hits) > 0, F.element_at(hits, -1)["v"]).otherwise("")

    name, volume, provider = last("disc title", "disc name"), last("volume identifier"), last("provider data")
    return d.select("report_id", F.upper(last("disc id")).alias("disc_id"), volume.alias("volume_id"), name.alias("disc_name"),
                    (F.lower(last("bluray detected")) == "yes").alias("is_bluray"), (F.lower(last("aacs detected")) == "yes").alias("has_aacs"),
                    provider.alias("provider"), studio(provider).alias("studio"), report_year(name, volume).alias("year"))


HIT = ("id string, attributes struct<release:string,language:string,download_count:bigint,hearing_impaired:boolean,foreign_parts_only:boolean,"
       "files:array<struct<file_id:bigint,file_name:string>>>")


def flatten_hits(hits: DataFrame) -> DataFrame:
    """One row per (hit, file); hits without files are kept."""
    a = "attributes."
    keep = [c for c in hits.columns if c != "attributes"]
    return hits.select(*keep, F.col(a + "release").alias("release"), F.col(a + "language").alias("language"), F.col(a + "download_count").alias("downloads"),
                       F.coalesce(a + "hearing_impaired", F.lit(False)).alias("hearing_impaired"), F.coalesce(a + "foreign_parts_only", F.lit(False)).alias("foreign_only"),
                       F.explode_outer(a + "files").alias("f")).select("*", "f.file_id", "f.file_name").drop("f")


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    return flatten_hits(spark.read.schema(HIT).json(path))


def lookup_identity(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Title and its source per item: catalogue by id, report name, scan name, label, constant.

    `items` (item_id, disc_id, report_name, scan_name, label).
    """
    c = catalogue.select(F.col("disc_id").alias("_id"), F.nullif("title", F.lit("")).alias("_t"))
    d = items.withColumn("_id", normal_disc_id(F.col("disc_id"))).join(c, "_id", "left")

    def some(col: str) -> Column:
        return F.nullif(F.coalesce(col, F.lit("")), F.lit(""))

    source = (F.when(F.col("_t").isNotNull(), "catalogue").when(some("report_name").isNotNull(), "report").when(some("scan_name").isNotNull(), "scan")
              .when(some("label").isNotNull(), "label").otherwise("fallback"))
    return d.select("item_id", F.coalesce("_t", some("report_name"), some("scan_name"), some("label"), F.lit("Unknown Disc")).alias("title"), source.alias("source"))
