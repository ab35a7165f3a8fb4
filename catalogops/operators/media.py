"""Media probes: streams, validation, audio choice, output summaries and A/V timing.

A probe is one row (item_id, role, path, streams array<struct>, format struct).  All work on the streams of one
file happens inside the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.functions import languages as L
from catalogops.functions.times import media_duration_seconds

STREAMS = ("array<struct<index:int,codec_name:string,codec_type:string,codec_long_name:string,start_time:string,duration:string,"
           "width:int,height:int,channels:int,channel_layout:string,color_transfer:string,color_primaries:string,"
           "tags:map<string,string>,disposition:map<string,int>,side_data_list:array<struct<side_data_type:string>>>>")
FORMAT = "struct<duration:string,size:string,bit_rate:string>"

# Codecs without loss, limits of artifact checks.
LOSSLESS = ("truehd", "flac", "mlp", "alac", "pcm_s16le", "pcm_s24le", "pcm_s32le", "pcm_bluray", "pcm_s24be", "pcm_s16be")
LOSSLESS_WORDS = ("lossless", "master audio", "dts-hd")
MIN_FILE_BYTES = 10 * 1024 * 1024
AUDIO_TOLERANCE = 5.0
DRIFT_LIMIT_MS = 100.0


def parse_probes(rows: DataFrame, json: str = "probe") -> DataFrame:
    """Text probes to typed rows; number-or-string fields are read as text."""
    p = F.from_json(json, f"struct<streams:{STREAMS},format:{FORMAT}>")
    return rows.withColumn("_p", p).select(*[c for c in rows.columns if c != json], F.coalesce("_p.streams", F.array().cast(STREAMS)).alias("streams"),
                                           F.col("_p.format").alias("format"))


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("probe"))
    return parse_probes(text)


def number(text: Column) -> Column:
    """Unparsable numbers count as 0."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def stream_table(probes: DataFrame) -> DataFrame:
    keep = [c for c in probes.columns if c not in ("streams", "format")]
    return (probes.select(*keep, number(F.col("format.duration")).alias("file_duration"), number(F.col("format.size")).cast("long").alias("file_size"),
                          F.posexplode("streams").alias("pos", "s")).select(*keep, "file_duration", "file_size", "pos", "s.*"))


def of_type(kind: str, streams: str = "streams") -> Column:
    return F.filter(streams, lambda s: s["codec_type"] == kind)


def _flag(s: Column, name: str) -> Column:
    return F.coalesce(s["disposition"][name] == 1, F.lit(False))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stream_seconds(s: Column) -> Column:
    """Own duration, else the duration tag; NULL when neither can be read."""
    def ok(c: Column) -> Column:
        v = media_duration_seconds(c)
        return F.when(c.contains(":") | (v > 0), v)

    return F.coalesce(ok(s["duration"]), ok(s["tags"]["DURATION"]), ok(s["tags"]["duration"]))


def validate_artifacts(probes: DataFrame) -> DataFrame:
    """First failing check per file, NULL when valid."""
    fail = (F.when(F.trim(F.coalesce("path", F.lit(""))) == "", "empty_path").when(number(F.col("format.size")) < MIN_FILE_BYTES, "too_small")
            .when(F.size(of_type("video")) == 0, "no_video").when(F.size(of_type("audio")) == 0, "no_audio")
            .when(number(F.col("format.duration")) <= 0, "invalid_duration"))
    return probes.withColumn("failure", fail)


def duration_agreement(probes: DataFrame) -> DataFrame:
    """First audio stream that disagrees with the video length; short commentary is tolerated down to half."""
    first_video = F.get(F.filter(F.transform(of_type("video"), stream_seconds), lambda d: d.isNotNull()), 0)
    d = probes.withColumn("video_seconds", F.when(number(F.col("format.duration")) > 0, number(F.col("format.duration"))).otherwise(F.coalesce(first_video, F.lit(0.0))))
    v = F.col("video_seconds")

    def judge(s: Column, i: Column) -> Column:
        a = stream_seconds(s)
        bad = a.isNotNull() & (F.abs(v - a) > AUDIO_TOLERANCE) & ~(_flag(s, "comment") & (a < v) & (a >= v / 2))
        return F.struct(i.alias("stream"), a.alias("seconds"), F.coalesce(bad, F.lit(False)).alias("bad"))

    bad = F.get(F.filter(F.transform(of_type("audio"), judge), lambda j: j["bad"]), 0)
    return d.withColumn("_b", F.when(v > 0, bad)).select(*probes.columns, "video_seconds", F.col("_b.stream").alias("bad_stream"),
                                                          (F.col("_b.seconds") - v).alias("difference"))


def channel_count(s: Column) -> Column:
    layout = F.lower(F.trim(_text(s["channel_layout"])))
    main = F.regexp_extract(F.substring_index(layout, "(", 1), r"^\s*(\d+)\s*\.\s*(\d+)\s*$", 1).try_cast("int")
    sub = F.regexp_extract(F.substring_index(layout, "(", 1), r"^\s*(\d+)\s*\.\s*(\d+)\s*$", 2).try_cast("int")
    return F.when(s["channels"] > 0, s["channels"]).when(layout == "mono", 1).when(layout == "stereo", 2).otherwise(F.coalesce(main + sub, F.lit(0)))


def is_lossless(s: Column) -> Column:
    long = F.lower(_text(s["codec_long_name"]))
    out = F.lower(_text(s["codec_name"])).isin(*LOSSLESS)
    for w in LOSSLESS_WORDS:
        out = out | long.contains(w)
    return out


def best_stream(probes: DataFrame) -> DataFrame:
    """Primary audio per file: English pool, else the first stream; channels, lossless, default, order decide."""
    def describe(s: Column, i: Column) -> Column:
        return F.struct(i.alias("ordinal"), L.iso2(L.from_tags(s["tags"])).alias("lang"), channel_count(s).alias("ch"), is_lossless(s).alias("loss"), _flag(s, "default").alias("dflt"))

    d = probes.withColumn("_a", F.transform(of_type("audio"), describe))
    eng = F.filter("_a", lambda a: a["lang"].startswith("en"))
    d = d.withColumn("_pool", F.when(F.size(eng) > 0, eng).otherwise(F.slice("_a", 1, 1)))

    def scored(a: Column, i: Column) -> Column:
        base = F.when(a["ch"] >= 8, 1000).when(a["ch"] >= 6, 800).when(a["ch"] >= 4, 600).when(a["ch"] >= 2, 400).otherwise(200)
        tenths = (base + F.when(a["loss"], 100).otherwise(50) + F.when(a["dflt"], 5).otherwise(0)) * 10 - i
        return F.struct(tenths.alias("tenths"), (-i).alias("neg"), a["ordinal"].alias("ordinal"))

    d = d.withColumn("_best", F.array_max(F.transform("_pool", scored)))
    removed = F.transform(F.filter("_a", lambda a: a["ordinal"] != F.col("_best.ordinal")), lambda a: a["ordinal"])
    return d.select(*[c for c in probes.columns if c not in ("streams", "format")], F.col("_best.ordinal").alias("primary"), (F.col("_best.tenths") / 10).alias("score"),
                    removed.alias("removed"), (F.size(F.filter("_a", lambda a: a["lang"].startswith("en"))) == 0).alias("fallback")).filter("primary is not null")


def kept_indices(count: Column, primary: Column, extra: Column) -> Column:
    """Primary first, then the wanted extras in range, ascending and distinct."""
    ok = F.array_sort(F.array_distinct(F.filter(extra, lambda i: (i >= 0) & (i < count) & (i != primary))))
    return F.when(count > 0, F.concat(F.array(primary), ok)).otherwise(F.array().cast("array<int>"))


def remap_indices(refs: Column, kept: Column) -> Column:
    """Old stream indices to their places in the kept list; dropped streams vanish."""
    return F.filter(F.transform(refs, lambda r: F.array_position(kept, r) - 1), lambda p: p >= 0)


def is_hdr(s: Column) -> Column:
    tr, pr = F.lower(_text(s["color_transfer"])), F.lower(_text(s["color_primaries"]))
    side = F.exists(F.coalesce(s["side_data_list"], F.array().cast("array<struct<side_data_type:string>>")),
                    lambda d: F.lower(d["side_data_type"]).contains("mastering display") | F.lower(d["side_data_type"]).contains("content light"))
    return tr.contains("smpte2084") | tr.contains("arib-std-b67") | pr.contains("bt2020") | F.coalesce(side, F.lit(False))


def subtitle_label_ok(lang: Column, title: Column, forced: Column) -> Column:
    t, g = F.lower(F.trim(_text(title))), _text(lang)
    name = F.lower(L.display_name(g))
    return (t != "") & ~(forced & ~t.contains("forced")) & ((g == "") | (name == "") | t.contains(name) | t.contains(F.lower(g)))


def output_media(probes: DataFrame) -> DataFrame:
    """Per file the first video, its HDR flag, audio and subtitle lists with label checks."""
    video = F.get(of_type("video"), 0)

    def audio(s: Column) -> Column:
        named = F.lower(_text(s["tags"]["title"])).contains("commentary")
        comm = _flag(s, "comment") | named
        return F.struct(s["index"].alias("index"), s["codec_name"].alias("codec"), s["channels"].alias("channels"), _text(s["tags"]["language"]).alias("language"),
                        _flag(s, "default").alias("is_default"), comm.alias("commentary"), (~comm | named).alias("label_ok"))

    def sub(s: Column) -> Column:
        forced = _flag(s, "forced")
        return F.struct(s["index"].alias("index"), _text(s["tags"]["language"]).alias("language"), forced.alias("forced"),
                        subtitle_label_ok(s["tags"]["language"], s["tags"]["title"], forced).alias("label_ok"))

    keep = [c for c in probes.columns if c not in ("streams", "format")]
    return probes.select(*keep, number(F.col("format.duration")).alias("duration"), number(F.col("format.size")).cast("long").alias("size"),
                         video["codec_name"].alias("video_codec"), video["width"].alias("width"), video["height"].alias("height"),
                         F.coalesce(is_hdr(video), F.lit(False)).alias("hdr"), F.transform(of_type("audio"), audio).alias("audio"),
                         F.transform(of_type("subtitle"), sub).alias("subtitles"))


def audio_summary(media: DataFrame) -> DataFrame:
    n = F.size("audio")
    comm = F.size(F.filter("audio", lambda a: a["commentary"]))
    good = F.forall("audio", lambda a: ~a["commentary"] | a["label_ok"])
    return media.groupBy("item_id").agg(F.sum(n).alias("audio_tracks"), F.sum(comm).alias("commentary_tracks"), F.bool_and(good).alias("commentary_labels_ok"))


def subtitle_summary(results: DataFrame, media: DataFrame) -> DataFrame:
    """`results` (item_id, source, validation): counts per outcome, joined with the output's subtitle tracks."""
    v = F.col("validation")
    r = results.groupBy("item_id").agg(F.count_if(v == "passed").alias("passed"), F.count_if(v == "needs_review").alias("review"),
                                       F.count_if(v == "failed").alias("failed"), F.count_if(F.lower("source") == "none").alias("skipped"))
    m = media.groupBy("item_id").agg(F.sum(F.size("subtitles")).alias("tracks"), F.bool_and(F.forall("subtitles", lambda s: s["label_ok"])).alias("labels_ok"),
                                     F.count_if(F.size("subtitles") > 1).alias("extra_subtitle_files"),
                                     F.count_if(F.exists("subtitles", lambda s: s["forced"])).alias("forced_subtitle_files"))
    return r.join(m, "item_id", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("passed", "review", "failed", "skipped", "tracks")}).withColumn(
        "labels_ok", F.coalesce("labels_ok", F.lit(True)))


def default_language_problem(probes: DataFrame) -> DataFrame:
    """Files with several audio streams and English audio whose default stream is in another language."""
    langs = F.transform(of_type("audio"), lambda s: F.struct(L.iso2(L.from_tags(s["tags"])).alias("lang"), _flag(s, "default").alias("dflt")))
    d = probes.withColumn("_l", langs)
    first = F.get(F.filter("_l", lambda x: x["dflt"] & (x["lang"] != "")), 0)["lang"]
    bad = (F.size("_l") >= 2) & F.exists("_l", lambda x: x["lang"].startswith("en")) & first.isNotNull() & ~first.startswith("en")
    return d.filter(bad).select(*[c for c in probes.columns if c not in ("streams", "format")], first.alias("default_language"))


def start_offset(ordinal: Column | None = None) -> Column:
    """Audio start less video start: the given audio ordinal, else the default, else the first; NULL when unknown."""
    audio = of_type("audio")
    default = F.get(F.filter(audio, lambda s: _flag(s, "default")), 0)
    pick = F.get(audio, ordinal) if ordinal is not None else F.coalesce(default, F.get(audio, 0))
    if ordinal is not None:
        pick = F.when(ordinal >= 0, pick).otherwise(F.coalesce(default, F.get(audio, 0)))
    return pick["start_time"].try_cast("double") - F.get(of_type("video"), 0)["start_time"].try_cast("double")


def av_offset_drift(source: DataFrame, output: DataFrame, limit_ms: float = DRIFT_LIMIT_MS) -> DataFrame:
    """Per (item_id, key): change of the audio offset between source and output in ms and whether it is small.

    `source` may carry `audio_ordinal` of the primary stream.
    """
    ordinal = F.col("audio_ordinal") if "audio_ordinal" in source.columns else None
    s = source.select("item_id", "key", start_offset(ordinal).alias("source_offset"))
    o = output.select("item_id", "key", start_offset().alias("output_offset"))
    d = o.join(s, ["item_id", "key"], "left").withColumn("drift_ms", F.round((F.col("output_offset") - F.col("source_offset")) * 1000, 6))
    state = F.when(F.col("drift_ms").isNull(), "unavailable").when(F.abs("drift_ms") <= limit_ms, "passed").otherwise("failed")
    return d.withColumn("status", state)


def media_stats(files: DataFrame, by: list[str]) -> DataFrame:
    """File count and the range of positive durations and sizes; failed probes are left out."""
    d, s = F.col("duration"), F.col("size")
    return files.filter(F.coalesce("error", F.lit("")) == "").groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), F.min(F.when(d > 0, d)).alias("duration_min"), F.max(F.when(d > 0, d)).alias("duration_max"),
        F.min(F.when(s > 0, s)).alias("size_min"), F.max(F.when(s > 0, s)).alias("size_max"))


def majority_profile(members: DataFrame, keys: list[str], profile: dict[str, str], pos: str, ident: str) -> DataFrame:
    """Each member of a group of at least two against the most frequent profile (first seen wins ties).

    `profile` maps a label to its column; differences read "label: value (expected value)".
    """
    cols = list(profile.values())
    p = members.select(*keys, pos, ident, F.struct(*cols).alias("profile"))
    c = p.groupBy(*keys, "profile").agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    m = c.groupBy(*keys).agg(F.min_by("profile", F.struct(-F.col("n"), F.col("first"))).alias("major"), F.max("n").alias("majority_count"),
                             F.sum("n").alias("total")).filter("total >= 2")
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    diffs = F.array(*[F.when(~F.col(f"profile.{c}").eqNullSafe(F.col(f"major.{c}")), F.concat(F.lit(f"{label}: "), text(f"profile.{c}"), F.lit(" (expected "), text(f"major.{c}"), F.lit(")")))
                      for label, c in profile.items()])
    return (p.join(m, keys).withColumn("differences", F.array_compact(diffs))
            .select(*keys, pos, ident, "majority_count", "total", (F.size("differences") > 0).alias("deviates"), "differences"))


def keep_representative(judged: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Deviating members and the first conforming one; the omitted count per group rides along."""
    g = judged.groupBy(*keys).agg(F.min(F.when(~F.col("deviates"), F.col(pos))).alias("_rep"), F.count_if(~F.col("deviates")).alias("_same"))
    d = judged.join(g, keys).withColumn("representative", ~F.col("deviates") & (F.col(pos) == F.col("_rep")))
    return d.filter("deviates or representative").withColumn("omitted", F.greatest(F.col("_same") - 1, F.lit(0))).drop("_rep", "_same")
