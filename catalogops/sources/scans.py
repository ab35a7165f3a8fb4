"""Line output of disc scans: `PREFIX:body` lines become title and track tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Attribute numbers of titles and tracks.
TITLE_ATTRS = {"name": 2, "chapters": 8, "duration": 9, "size_bytes": 10, "playlist": 16, "segment_count": 25, "segment_map": 26}
TRACK_ATTRS = {"codec_id": 5, "codec_short": 6, "codec_long": 7, "bit_rate": 13, "channel_layout": 40}


def _clock(c: Column) -> Column:
    ok = c.rlike(r"^\d+:\d+:\d+$")
    p = F.split(c, ":")
    return F.when(ok, F.get(p, 0).try_cast("int") * 3600 + F.get(p, 1).try_cast("int") * 60 + F.get(p, 2).try_cast("int")).otherwise(0)


def _int(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0))


def split_scan_lines(lines: DataFrame) -> DataFrame:
    """(disc_id, pos, line) to (disc_id, pos, kind, title_id, stream_id, attr, value); other lines are dropped.

    A line is cut once, at as many commas as its kind has numbers in front of the value; the value keeps its own commas.
    """
    kind = F.col("kind")
    width = F.when(kind == "CINFO", 3).when(kind == "TINFO", 4).otherwise(5)
    body = F.substring("line", 7, 2_147_483_647)  # the three kinds have five letters
    raw = F.element_at("parts", -1)

    def number(i: int, *kinds: str) -> Column:
        return F.when(kind.isin(*kinds), F.trim(F.get("parts", F.lit(i))).try_cast("int"))

    d = lines.withColumn("kind", F.substring_index("line", ":", 1)).filter(kind.isin("CINFO", "TINFO", "SINFO"))
    # exploded as one row, so that the filters below read the parts instead of cutting the line again
    d = d.select("disc_id", "pos", "kind", width.alias("width"), F.explode(F.array(F.split(body, ",", width))).alias("parts"))
    d = d.filter((F.size("parts") == F.col("width")) & raw.rlike("^.*$"))
    attr = F.coalesce(number(0, "CINFO"), number(1, "TINFO"), number(2, "SINFO"))
    value = F.regexp_extract(raw, r'^("?)(.*)\1$', 2)
    d = d.select("disc_id", "pos", "kind", number(0, "TINFO", "SINFO").alias("title_id"), number(1, "SINFO").alias("stream_id"), attr.alias("attr"), value.alias("value"))
    return d.filter("attr is not null and (kind = 'CINFO' or title_id is not null) and (kind <> 'SINFO' or stream_id is not null)")


def disc_names(split: DataFrame) -> DataFrame:
    return split.filter("kind = 'CINFO' and attr = 2").groupBy("disc_id").agg(F.max_by("value", "pos").alias("name"))


def scan_titles(split: DataFrame) -> DataFrame:
    """One row per (disc, title); the last line of an attribute wins; titles known from streams alone appear too."""
    t = F.col("kind") == "TINFO"
    g = split.filter("kind <> 'CINFO'").groupBy("disc_id", "title_id").agg(
        *[F.max_by("value", F.when(t & (F.col("attr") == a), F.col("pos"))).alias(n) for n, a in TITLE_ATTRS.items()])

    def text(c: str) -> Column:
        return F.coalesce(c, F.lit("")).alias(c)

    return g.select("disc_id", "title_id", text("name"), _clock(F.coalesce("duration", F.lit(""))).alias("duration"), _int(F.col("chapters")).alias("chapters"),
                    _int(F.col("size_bytes")).alias("size_bytes"), text("playlist"), _int(F.col("segment_count")).alias("segment_count"), text("segment_map"))


def track_type(value: Column) -> Column:
    v = F.lower(F.coalesce(value, F.lit("")))
    return (F.when(v.contains("video"), "video").when(v.contains("audio"), "audio").when(v.contains("sub") | v.contains("text"), "subtitle")
            .when(v.contains("data"), "data").otherwise("unknown"))


def scan_tracks(split: DataFrame) -> DataFrame:
    """One row per (disc, title, stream) with its place in the title, typed fields and the attribute map.

    The few lines of a stream are gathered once, in order; every field is read from that list.
    """
    key = ["disc_id", "title_id", "stream_id"]
    g = split.filter("kind = 'SINFO'").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "attr", "value"))).alias("_l"))

    def last(*ids: int, ok=lambda v: F.lit(True)) -> Column:
        return F.try_element_at(F.filter("_l", lambda x: x["attr"].isin(*ids) & ok(x["value"])), F.lit(-1))["value"]

    def first(*ids: int) -> Column:
        return F.get(F.filter("_l", lambda x: x["attr"].isin(*ids) & (x["value"] != "")), 0)["value"]

    # the last full value of every attribute number, by number
    full = F.array_sort(F.transform(F.filter("_l", lambda x: x["value"] != ""), lambda x: F.struct(x["attr"].alias("attr"), x["pos"].alias("pos"), x["value"].alias("v"))))
    ends = F.filter("_full", lambda x, i: F.coalesce(F.get("_full", i + 1)["attr"] != x["attr"], F.lit(True)))
    attributes = F.map_from_entries(F.transform(ends, lambda x: F.struct(x["attr"].alias("attr"), x["v"].alias("v"))))
    place = Window.partitionBy("disc_id", "title_id").orderBy(F.get("_l", 0)["pos"])  # streams of one title
    return (g.withColumn("_full", full)
            .select(*key, F.coalesce(last(30), first(2), F.lit("")).alias("name"), F.coalesce(F.lower(first(3, 28)), F.lit("")).alias("language"),
                    F.coalesce(first(4, 29), F.lit("")).alias("language_name"), *[F.coalesce(last(a), F.lit("")).alias(n) for n, a in TRACK_ATTRS.items()],
                    F.coalesce(last(14, ok=lambda v: v.try_cast("int") > 0).try_cast("int"), F.lit(0)).alias("channels"),
                    F.when(F.size("_full") > 0, attributes).alias("attributes"), track_type(last(1)).alias("type"), (F.rank().over(place) - 1).cast("long").alias("ord")))


def title_hashes(titles: DataFrame, tracks: DataFrame) -> DataFrame:
    """Stable metadata hash per title over its ordered track attributes, and how many titles of a disc share it."""
    def low(c: str) -> Column:
        return F.lower(F.trim(c))

    pairs = F.flatten(F.transform(F.array_sort(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<int,string>")))),
                                  lambda e: F.array(e["key"].cast("string"), F.lower(F.trim(e["value"])))))
    parts = F.concat(F.array(F.col("stream_id").cast("string"), F.col("ord").cast("string"), F.col("type"), low("codec_id"), low("codec_short"), low("codec_long"), low("language"),
                             low("language_name"), low("name"), F.col("channels").cast("string"), low("channel_layout"), low("bit_rate")), pairs)
    per = tracks.groupBy("disc_id", "title_id").agg(F.array_sort(F.collect_list(F.struct("stream_id", "type", parts.alias("parts")))).alias("ts"))  # streams of one title
    head = F.array(low("name"), F.col("duration").cast("string"), F.trim("segment_map"))
    every = F.concat(head, F.flatten(F.transform(F.coalesce("ts", F.array().cast("array<struct<stream_id:int,type:string,parts:array<string>>>")), lambda x: x["parts"])))
    h = titles.join(per, ["disc_id", "title_id"], "left").select("disc_id", "title_id", F.sha2(F.concat(F.array_join(every, "\0"), F.lit("\0")), 256).alias("title_hash"))
    return h.withColumn("shared_by", F.count(F.lit(1)).over(Window.partitionBy("disc_id", "title_hash")))  # titles of one disc
