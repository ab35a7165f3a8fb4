"""Item audits: envelopes and their child tables, episode and asset statistics, routing, sequences, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from catalogops.operators.skew import int_slice, sliced_window

ENVELOPE_VERSION = 1
ASSET = "struct<episode_key:string,title_id:int,path:string,status:string,subtitles_muxed:boolean,error_msg:string>"
ENVELOPE = (
    "struct<version:int,fingerprint:string,metadata:struct<id:int,title:string,media_type:string,show_title:string,year:string,season_number:int,disc_number:int,disc_source:string>,"
    "titles:array<struct<id:int,name:string,duration:int,chapters:int,size_bytes:bigint,playlist:string,segment_count:int,segment_map:string,title_hash:string,episode_title:string>>,"
    "episodes:array<struct<key:string,title_id:int,season:int,episode:int,episode_end:int,episode_title:string,runtime_seconds:int,match_score:double,match_confidence:double,"
    "needs_review:boolean,review_reason:string>>,"
    f"assets:struct<ripped:array<{ASSET}>,encoded:array<{ASSET}>,subtitled:array<{ASSET}>,final:array<{ASSET}>,transcript:array<{ASSET}>>,"
    "attributes:struct<subtitle_generation_results:array<struct<episode_key:string,source:string,language:string,validation_result:string,review_issues:array<string>,severe_issues:array<string>>>,"
    "audio_analysis:struct<primary_description:string,commentary_tracks:array<struct<index:int>>,episodes:array<struct<key:string,commentary_tracks:int,excluded_tracks:int>>>,"
    "content_id:struct<method:string,reference_source:string,completed:boolean,episodes_synchronized:boolean>>>")
KINDS = ("ripped", "encoded", "subtitled", "final", "transcript")


def parse_envelopes(items: DataFrame, column: str = "rip_spec_data", parts: tuple[str, ...] = ()) -> DataFrame:
    """Adds `env` and `env_status`: parsed, blank, malformed or version; only parsed rows carry content, of which `parts` are read or else all.

    Both come out of a generator, so a text is parsed once, whatever is filtered on or taken from it.
    """
    whole = DataType.fromDDL(ENVELOPE)
    schema = StructType([f for f in whole if not parts or f.name in ("version", *parts)])
    text = F.trim(column)

    def judged(version: Column) -> Column:
        status = (F.when(F.coalesce(text, F.lit("")) == "", "blank").when(version.isNull(), "malformed")
                  .when(version.try_cast("int") == ENVELOPE_VERSION, "parsed").otherwise("version"))
        return F.transform(F.array(status), lambda s: F.struct(s.alias("env_status"), F.when(s == "parsed", F.from_json(text, schema)).alias("env")))[0]

    return items.select("*", F.inline_outer(F.transform(F.array(F.get_json_object(text, "$.version")), judged)))


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.filter("env_status in ('malformed', 'version')").select("item_id", "env_status")


def explode_titles(parsed: DataFrame) -> DataFrame:
    return parsed.select("item_id", F.posexplode("env.titles").alias("pos", "t")).select("item_id", "pos", "t.*")


def explode_episodes(parsed: DataFrame) -> DataFrame:
    return (parsed.select("item_id", F.posexplode("env.episodes").alias("pos", "e")).select("item_id", "pos", "e.*")
            .withColumns({"episode": F.coalesce("episode", F.lit(0)), "episode_end": F.coalesce("episode_end", F.lit(0)),
                          "needs_review": F.coalesce("needs_review", F.lit(False)), "match_confidence": F.coalesce("match_confidence", F.lit(0.0))}))


def explode_assets(parsed: DataFrame) -> DataFrame:
    """One row per asset of the five kinds."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"env.assets.{k}").alias("list")) for k in KINDS])
    d = parsed.filter("env is not null").select("item_id", F.explode(kinds).alias("k")).select("item_id", "k.kind", F.posexplode("k.list").alias("pos", "a"))
    return d.select("item_id", "kind", "pos", F.col("a.episode_key").alias("key"), F.coalesce("a.title_id", F.lit(-1)).alias("title_id"),
                    F.coalesce("a.path", F.lit("")).alias("path"), F.coalesce("a.status", F.lit("")).alias("status"),
                    F.coalesce("a.subtitles_muxed", F.lit(False)).alias("muxed"), F.coalesce("a.error_msg", F.lit("")).alias("error"))


def completed() -> Column:
    return (F.col("path") != "") & (F.col("status") != "failed")


def episode_last() -> Column:
    return F.greatest("episode", "episode_end")


def episode_stats(episodes: DataFrame) -> DataFrame:
    """Counts, confidence range and mean, ladder counts, contiguity and range per item."""
    c, ok = F.col("match_confidence"), F.col("episode") > 0
    conf = F.when(c > 0, c)
    touched = ok | (c > 0) | F.col("needs_review") | (F.coalesce("review_reason", F.lit("")) != "")
    g = episodes.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(ok).alias("matched"), F.count_if(~ok).alias("unresolved"), (~F.bool_or(touched)).alias("placeholder_only"),
        F.min(conf).alias("confidence_min"), F.max(conf).alias("confidence_max"), F.round(F.avg(conf), 3).alias("confidence_mean"),
        F.count_if(conf < 0.9).alias("below_090"), F.count_if(conf < 0.8).alias("below_080"), F.count_if(conf < 0.7).alias("below_070"),
        F.count_if("needs_review").alias("review_episodes"))
    numbers = episodes.filter(ok).select("item_id", F.explode(F.when(F.col("episode_end") > F.col("episode"), F.array("episode", "episode_end")).otherwise(F.array("episode"))).alias("n"))
    s = numbers.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("n").alias("_d"), F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    run = (F.col("_n") == F.col("_d")) & (F.col("_hi") - F.col("_lo") == F.col("_n") - 1)
    return g.join(s, "item_id", "left").select(*g.columns, F.coalesce(run, F.lit(False)).alias("contiguous"),
                                               F.concat_ws("-", F.col("_lo").cast("string"), F.col("_hi").cast("string")).alias("range"))


def asset_health(assets: DataFrame) -> DataFrame:
    """Total, ok, failed and muxed per item and kind."""
    bad = F.col("status") == "failed"
    return assets.groupBy("item_id", "kind").agg(F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"),
                                                 F.count_if(F.col("muxed") & (F.col("kind") == "subtitled")).alias("muxed"))


def failed_by_kind(assets: DataFrame) -> DataFrame:
    bad = F.col("status") == "failed"
    return assets.groupBy("item_id").agg(*[F.count_if(bad & (F.col("kind") == k)).alias(f"failed_{k}") for k in KINDS])


def item_totals(assets: DataFrame) -> DataFrame:
    """Distinct episodes per item that have a completed asset of each kind."""
    key = F.lower("key")
    return assets.groupBy("item_id").agg(*[F.count_distinct(F.when(completed() & (F.col("kind") == k), key)).alias(k) for k in KINDS])


def sequence_checks(numbers: DataFrame, keys: list[str]) -> DataFrame:
    """Per key over positive numbers: contiguous (a duplicate breaks it), gaps, fragmented, the single missing number.

    Gaps are counted between neighbours of the distinct numbers in a two-level order, never over a gathered list.
    """
    n = numbers.filter("number > 0")
    raw = n.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"))
    d = sliced_window(n.select(*keys, "number").distinct(), keys, ["number"], int_slice("number", 100_000), leads={"_next": "number"})
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct"), F.min("number").alias("lo"), F.max("number").alias("hi"),
                             F.count_if(F.col("_next") - F.col("number") > 1).alias("gaps"), F.sum("number").alias("_s"))
    missing = F.when((F.col("distinct") >= 2) & (F.col("hi") - F.col("lo") == F.col("distinct")), F.expr("(lo + hi) * (hi - lo + 1) div 2") - F.col("_s"))
    return raw.join(g, keys).select(*keys, "members", "lo", "hi", ((F.col("members") == F.col("distinct")) & (F.col("gaps") == 0)).alias("contiguous"), "gaps",
                                    ((F.col("distinct") >= 3) & (F.col("gaps") > 1)).alias("fragmented"), missing.cast("long").alias("missing"))


def structural_reasons(checks: DataFrame, disc: str) -> DataFrame:
    """Review reasons of a numbered set: disc 1 not starting at 1, fragmented subset."""
    r = F.array(F.when((F.col(disc) == 1) & (F.col("lo") > 1), F.concat(F.lit("disc 1 matched subset starts at episode "), F.col("lo").cast("string"))),
                F.when(F.col("fragmented"), "accepted episode subset is fragmented"))
    return checks.withColumn("reasons", F.array_compact(r))


def within_root(path: Column, root: Column) -> Column:
    r = F.regexp_replace(root, "/+$", "")
    return (path != "") & (r != "") & ((path == r) | path.startswith(F.concat(r, F.lit("/"))))


def _finals(assets: DataFrame) -> DataFrame:
    """Last final asset per (item, key in any case)."""
    f = assets.filter("kind = 'final' and key <> ''").withColumn("_k", F.lower("key"))
    return f.groupBy("item_id", "_k").agg(F.max_by(F.struct("path", "status"), "pos").alias("a")).select("item_id", "_k", "a.*")


def routing_entries(items: DataFrame, episodes: DataFrame, assets: DataFrame) -> DataFrame:
    """Completed final assets with actual and expected destination.

    `items` (item_id, media_type, needs_review, review_dir, library_dir).
    """
    dest = (F.when(within_root(F.col("path"), F.col("review_dir")), "review").when(within_root(F.col("path"), F.col("library_dir")), "library").otherwise("other"))
    ep = episodes.select("item_id", F.lower("key").alias("_k"), ((F.col("episode") <= 0) | F.col("needs_review")).alias("_want")).dropDuplicates(["item_id", "_k"])
    f = assets.filter("kind = 'final'").filter(completed()).withColumn("_k", F.lower("key"))
    want = F.when(F.col("media_type") == "tv", F.coalesce("_want", F.lit(False))).otherwise(F.col("needs_review"))
    d = f.join(items, "item_id").join(ep, ["item_id", "_k"], "left").select("item_id", "key", "path", dest.alias("destination"), want.alias("expected_review"))
    return d.withColumn("matches", F.when(F.col("expected_review"), F.col("destination") == "review").otherwise(F.col("destination") == "library"))


def routing_check(items: DataFrame, episodes: DataFrame, assets: DataFrame) -> DataFrame:
    """Per series item: clean episodes, misrouted ones each way, missing finals, and severities."""
    tv = items.filter("media_type = 'tv'").select("item_id", "review_dir")
    e = episodes.filter("key <> ''").join(tv, "item_id").withColumn("_k", F.lower("key")).join(_finals(assets), ["item_id", "_k"], "left")
    want, missing = (F.col("episode") <= 0) | F.col("needs_review"), ~F.coalesce(completed(), F.lit(False))
    here = within_root(F.col("path"), F.col("review_dir"))
    g = e.groupBy("item_id").agg(
        F.count_if(~want).alias("clean"), F.count_if(missing).alias("missing_final"), F.count_if(~missing & want & ~here).alias("review_in_library"),
        F.count_if(~missing & ~want & here).alias("clean_in_review"), F.count_if(F.col("path").isNotNull()).alias("_f"))
    sev = F.when(F.col("clean_in_review") > 0, F.when((F.col("clean") > 0) & (F.col("clean_in_review") == F.col("clean")), "critical").otherwise("warning"))
    return g.select("item_id", "clean", "clean_in_review", sev.alias("clean_in_review_severity"), "review_in_library",
                    F.when(F.col("_f") > 0, F.col("missing_final")).otherwise(0).alias("missing_final"))


STAGE_NAMES = ("planned", "ripped", "encoded", "subtitled", "final")


def enrich_episodes(episodes: DataFrame, titles: DataFrame, assets: DataFrame, subtitles: DataFrame | None = None,
                    active: DataFrame | None = None, audio: DataFrame | None = None) -> DataFrame:
    """Episodes with title fallbacks, furthest stage, failure, per-kind paths, subtitle and audio records and active flag.

    `audio` (item_id, key, codec, language, channels): the record of the first language and codec in their order.
    """
    a = assets.withColumn("_k", F.lower("key"))
    first = a.groupBy("item_id", "_k", "kind").agg(F.min_by(F.struct("path", "status", "error"), "pos").alias("x")).select("item_id", "_k", "kind", "x.*")
    done = completed()
    per = first.groupBy("item_id", "_k").agg(
        *[F.max(F.when((F.col("kind") == k) & done, F.col("path"))).alias(f"{k}_path") for k in STAGE_NAMES[1:]],
        F.max(F.when(done, F.array_position(F.array(*[F.lit(s) for s in STAGE_NAMES]), F.col("kind")) - 1)).alias("_stage"),
        F.max_by("error", F.when((F.col("status") == "failed") & F.col("kind").isin("encoded", "subtitled", "final"),
                                 F.array_position(F.array(*[F.lit(s) for s in STAGE_NAMES]), F.col("kind")))).alias("_error"),
        F.bool_or((F.col("status") == "failed") & F.col("kind").isin("encoded", "subtitled", "final")).alias("_failed"))
    t = titles.select("item_id", F.col("id").alias("title_id"), F.col("name").alias("source_title"), F.col("duration").alias("_dur"), F.col("episode_title").alias("_et"))
    d = (episodes.withColumn("_k", F.lower("key")).join(t, ["item_id", "title_id"], "left").join(per, ["item_id", "_k"], "left"))
    if subtitles is not None:
        s = subtitles.withColumn("_k", F.lower("key")).groupBy("item_id", "_k").agg(F.max("source").alias("subtitle_source"), F.max("validation").alias("subtitle_validation"))
        d = d.join(s, ["item_id", "_k"], "left")
    if audio is not None:
        s = audio.withColumn("_k", F.lower("key")).groupBy("item_id", "_k").agg(F.min(F.struct("language", "codec", "channels")).alias("audio"), F.count(F.lit(1)).alias("audio_tracks"))
        d = d.join(s, ["item_id", "_k"], "left").withColumn("audio_tracks", F.coalesce("audio_tracks", F.lit(0)))
    if active is not None:
        act = active.select("item_id", F.lower("key").alias("_k")).distinct().withColumn("active", F.lit(True))
        d = d.join(act, ["item_id", "_k"], "left").withColumn("active", F.coalesce("active", F.lit(False)))

    def filled(*cols: str) -> Column:
        return F.coalesce(*[F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in cols], F.lit(""))

    stage = F.element_at(F.array(*[F.lit(s) for s in STAGE_NAMES]), (F.coalesce("_stage", F.lit(0)) + 1).cast("int"))
    return d.withColumns({"title": filled("episode_title", "_et", "source_title"), "stage": stage,
                          "runtime": F.when(F.coalesce("runtime_seconds", F.lit(0)) > 0, F.col("runtime_seconds")).otherwise(F.coalesce("_dur", F.lit(0))),
                          "status": F.when(F.coalesce("_failed", F.lit(False)), "failed").otherwise(""), "error": F.coalesce("_error", F.lit(""))}).drop("_k", "_dur", "_et", "_stage", "_error", "_failed")


def reason_value(reason: Column, key: str) -> Column:
    """Value of a key=value field inside a reason text; "" when absent."""
    return F.regexp_replace(F.regexp_extract(reason, rf"(?:^|\s){key}=(\S*)", 1), r"^,+|,+$", "")


def source_summary(items: DataFrame, decisions: DataFrame, media: DataFrame) -> DataFrame:
    """Per item: input resolution and codecs from probe decisions, output facts from the first file, UHD guess.

    `items` (item_id, title, disc_source), `decisions` (item_id, seq, decision_type, decision_reason, fields),
    `media` (item_id, pos, video_codec, width, height, hdr).  Items about which nothing is known are left out.
    """
    probe = decisions.filter("decision_type = 'file_probe'")
    res = F.coalesce(F.col("fields")["resolution"], F.nullif(reason_value(F.col("decision_reason"), "resolution"), F.lit("")))
    cod = F.coalesce(F.nullif(F.col("fields")["codecs"], F.lit("")), F.nullif(reason_value(F.col("decision_reason"), "codecs"), F.lit("")))
    p = probe.select("item_id", "seq", res.alias("r"), cod.alias("c")).groupBy("item_id").agg(
        F.min_by("r", F.when(F.coalesce("r", F.lit("")) != "", F.col("seq"))).alias("input_resolution"), F.max_by("c", F.when(F.col("c").isNotNull(), F.col("seq"))).alias("input_codecs"))
    m = media.groupBy("item_id").agg(F.min_by(F.struct("video_codec", "width", "height", "hdr"), "pos").alias("v"))
    size = F.when((F.col("v.width") > 0) & (F.col("v.height") > 0), F.format_string("%dx%d", F.col("v.width"), F.col("v.height")))
    d = items.join(p, "item_id", "left").join(m, "item_id", "left").select(
        "item_id", "title", F.nullif("disc_source", F.lit("")).alias("disc_source"), "input_resolution", "input_codecs", F.col("v.video_codec").alias("output_codec"),
        size.alias("output_resolution"), F.coalesce("v.hdr", F.lit(False)).alias("hdr"))

    def starts(c: str, s: str) -> Column:
        return F.coalesce(F.col(c).startswith(s), F.lit(False))

    uhd = F.coalesce(F.upper("title").contains("UHD"), F.lit(False)) | starts("input_resolution", "3840x2160") | starts("output_resolution", "3840x")
    known = F.coalesce("disc_source", "input_resolution", "input_codecs", "output_codec", "output_resolution").isNotNull() | F.col("hdr") | F.col("uhd_likely")
    return d.withColumn("uhd_likely", uhd).filter(known).drop("title")


def anomalies(summary: DataFrame) -> DataFrame:
    """(item_id, rule, severity, category, message) from one wide summary row per item.

    All rules are tested in one pass over the row; columns that a caller does not have count as absent.  `rule` is
    the position in the fixed rule order.
    """
    have = set(summary.columns)

    def n(c: str) -> Column:
        return F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in have else F.lit(0).cast("long")

    def s(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")

    def b(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)

    def msg(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    gate = b("phase_episode_id")
    only80, only90 = n("below_080") - n("below_070"), n("below_090") - n("below_080")
    early = b("placeholder_only") & ~gate
    prov = s("provenance")
    rules: list[tuple[Column, Column | str, str, Column]] = [
        (s("error_message") != "", "critical", "item_state", msg("stopped in ", s("failed_at_stage"), ": ", s("error_message"))),
        (b("needs_review"), "warning", "item_state", msg("held for review: ", s("review_reasons"))),
        (n("log_errors") > 0, "critical", "logs", msg(n("log_errors"), " log lines at error level")),
        (n("log_warnings") > 0, "warning", "logs", msg(n("log_warnings"), " log lines at warning level")),
        (n("discarded_duplicates") > 0, "critical", "episodes", msg(n("discarded_duplicates"), " titles dropped as duplicates on a source that gives no proof")),
        (n("contested") > 0, "warning", "episodes", msg(n("contested"), " match decisions: contested")),
        (n("ambiguous") > 0, "info", "episodes", msg(n("ambiguous"), " match decisions: ambiguous")),
        (n("decisive") > 0, "info", "episodes", msg(n("decisive"), " match decisions: decisive, low similarity")),
        (n("subtitle_skips") > 0, "warning", "subtitles", msg(n("subtitle_skips"), " titles finished without a subtitle")),
        (n("review_episodes") > 0, "warning", "episodes", msg(n("review_episodes"), " episodes carry a review flag")),
        (gate & (prov == "missing"), "warning", "episodes", msg("provenance: missing")),
        (gate & (prov == "incomplete"), "warning", "episodes", msg("provenance: incomplete")),
        (gate & (prov == "inconsistent"), "warning", "episodes", msg("provenance: contradicts itself")),
        (early, "info", "episodes", msg(n("unresolved"), " episodes are still placeholders")),
        (~early & (n("unresolved") > 0), "critical", "episodes", msg(n("unresolved"), " episodes have no number")),
        (n("below_070") > 0, "critical", "episodes", msg(n("below_070"), " episodes of confidence under 0.70")),
        (only80 > 0, "warning", "episodes", msg(only80, " episodes of confidence 0.70 to 0.80")),
        (only90 > 0, "info", "episodes", F.when(n("decisive_in_band") == only90, msg(only90, " episodes of confidence 0.80 to 0.90, all decisive"))
         .otherwise(msg(only90, " episodes of confidence 0.80 to 0.90"))),
        ((n("matched") > 0) & ~b("contiguous"), "warning", "episodes", msg("gap in the numbers ", s("range"))),
        (b("encoding_invalid"), "critical", "encoding", msg("encoder output is not valid")),
        (s("encoding_error") != "", "critical", "encoding", msg("encoder reports: ", s("encoding_error"))),
        (s("encoding_warning") != "", "warning", "encoding", msg("encoder warns: ", s("encoding_warning"))),
        *[(n(f"failed_{k}") > 0, "critical", "assets", msg(n(f"failed_{k}"), f" assets failed: {k}")) for k in KINDS],
        (b("phase_subtitles") & (n("extra_subtitle_files") > 0), "warning", "subtitles", msg(n("extra_subtitle_files"), " outputs with several subtitle streams")),
        (b("phase_subtitles") & (n("forced_subtitle_files") > 0), "warning", "subtitles", msg(n("forced_subtitle_files"), " outputs with a forced subtitle stream")),
        (n("deviating_episodes") > 0, "warning", "consistency", msg(n("deviating_episodes"), " episodes unlike the usual profile")),
        (n("probe_errors") > 0, "warning", "media", msg(n("probe_errors"), " files could not be probed")),
        (n("av_failed") > 0, "critical", "av_sync", msg(n("av_failed"), " outputs with shifted audio", F.when(n("av_max_drift_ms") != 0, msg(", largest shift ", n("av_max_drift_ms"), " ms")).otherwise(""))),
        (s("default_language") != "", "warning", "media", msg("default audio is ", s("default_language"), " although English exists")),
        (n("clean_in_review") > 0, F.when(s("clean_in_review_severity") == "critical", "critical").otherwise("warning"), "organization", msg(n("clean_in_review"), " clean episodes lie in review")),
        (n("review_in_library") > 0, "critical", "organization", msg(n("review_in_library"), " episodes for review lie in the library")),
        (n("missing_final") > 0, "warning", "organization", msg(n("missing_final"), " episodes lack a final file")),
    ]
    found = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(i).alias("rule"), (F.lit(sev) if isinstance(sev, str) else sev).alias("severity"),
                              F.lit(cat).alias("category"), text.alias("message")))
        for i, (cond, sev, cat, text) in enumerate(rules)]))
    return summary.select("item_id", F.inline(found))
