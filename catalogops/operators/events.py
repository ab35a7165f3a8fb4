"""Pipeline-log events: filters, attribution, kinds, decision groups, timings, paging, downsampling, waits.

Event columns: seq (unique, growing), ts, item_id (0 = none), level, msg, event_type, component, lane, request,
stage, duration, decision_type, decision_result, decision_reason, fields map<string,string>.  Operators only use
the columns they name.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.operators.skew import int_slice, sliced_window
from catalogops.session import cut_lineage

# Decision types worth showing in a digest.
NOTABLE_DECISIONS = (
    "asset_mapping", "audio_refinement", "audio_remux", "audio_selection", "commentary_classification",
    "commentary_disposition", "commentary_remapping", "commentary_stereo_filter", "contentid_candidates",
    "contentid_matches", "crop_detection", "encoding_validation", "episode_id_skip", "episode_match",
    "episode_placeholders", "file_probe", "reference_search", "source_stage_selection", "srt_validation",
    "subtitle_source", "title_resolution", "title_selection", "tmdb_match", "tmdb_match_preference",
    "transcription_asset", "validation_failure_route",
)
# Keys that are columns or appear on every line; everything else is an extra.
KNOWN_KEYS = ("time", "level", "msg", "decision_type", "decision_result", "decision_reason", "event_type",
              "error_hint", "error", "stage", "stage_duration", "item_id")
TITLE_KEYS = ("disc_title", "label", "volume_id", "raw_title")
LEVELS = {"DEBUG": 0, "INFO": 1, "WARN": 2, "WARNING": 2, "ERROR": 3}
PROGRESS_ROWS = 20
LIFETIME_GRACE_MINUTES = 2


def level_rank(level: Column) -> Column:
    """Rank of a level name in any case; unknown levels rank -1."""
    up = F.upper(level)
    rank = F.lit(-1)
    for name, value in LEVELS.items():
        rank = F.when(up == name, value).otherwise(rank)
    return rank


def filter_events(events: DataFrame, *, item_id: int = 0, itemless: bool = False, component: str = "", lane: str = "",
                  request: str = "", level: str = "", min_time: datetime | Column | None = None) -> DataFrame:
    """Rows passing every given test; an unknown requested level disables the level test."""
    keep = F.lit(True)
    if item_id > 0:
        keep &= F.col("item_id") == item_id
    if itemless:
        keep &= F.coalesce("item_id", F.lit(0)) == 0
    for name, wanted in (("component", component), ("lane", lane), ("request", request)):
        if wanted:
            keep &= F.lower(name) == wanted.lower()
    floor = LEVELS.get(level.upper(), -1)
    if floor >= 0:
        keep &= level_rank(F.col("level")) >= floor
    if min_time is not None:
        keep &= F.coalesce(F.col("ts") >= (min_time if isinstance(min_time, Column) else F.lit(min_time)), F.lit(False))
    return events.filter(keep)


def attribute_events(events: DataFrame, items: DataFrame) -> DataFrame:
    """(seq, item_id) pairs: an explicit id decides alone, else the fingerprint or one of four title fields.

    `events` (seq, item_id nullable, fields), `items` (item_id, fingerprint, title).  Three keyed joins, unioned;
    an OR in one join condition would compare every event with every item.
    """
    def key(c: str | Column) -> Column:
        return F.lower(F.trim(c))

    explicit = (events.filter("item_id is not null").select("seq", "item_id")
                .join(items.select("item_id"), "item_id", "left_semi").select("seq", "item_id"))
    rest = events.filter("item_id is null")
    by_print = rest.select("seq", key(F.col("fields")["fingerprint"]).alias("k")).filter("k <> ''")
    prints = items.select("item_id", key("fingerprint").alias("k")).filter("k <> ''")
    names = F.array(*[key(F.col("fields")[k]) for k in TITLE_KEYS])
    by_title = (rest.select("seq", F.explode(F.array_distinct(F.array_compact(names))).alias("k")).filter("k <> ''"))
    titles = items.select("item_id", key("title").alias("k")).filter("k <> ''")
    matched = by_print.join(prints, "k").unionByName(by_title.join(titles, "k")).select("seq", "item_id").distinct()
    return explicit.unionByName(matched)


def clamp_lifetime(events: DataFrame, items: DataFrame, minutes: int = LIFETIME_GRACE_MINUTES) -> DataFrame:
    """Drops events older than their item's creation less a grace; untimed events and items pass."""
    created = items.select("item_id", F.col("created_at").alias("_created"))
    old = F.col("ts") < F.col("_created") - F.expr(f"INTERVAL {minutes} MINUTES")
    return events.join(created, "item_id").filter(~F.coalesce(old, F.lit(False))).drop("_created")


def lifetime_only(events: DataFrame, items: DataFrame) -> DataFrame:
    """The strict clamp: rows before the item's creation and rows without a time are dropped.

    Works on a stream of events against a static item table as well.
    """
    created = items.select("item_id", F.col("created_at").alias("_created"))
    return (events.join(created, "item_id", "left")
            .filter(F.coalesce((F.col("ts") >= F.col("_created")) | F.col("_created").isNull() & F.col("ts").isNotNull(),
                               F.lit(False))).drop("_created"))


def split_kinds(events: DataFrame) -> DataFrame:
    """Adds is_decision, is_warning, is_error, is_stage and is_event flags in one pass."""
    kind = F.coalesce("event_type", F.lit(""))
    decision = F.coalesce("decision_type", F.lit("")) != ""
    level = F.upper("level")
    stage = kind.startswith("stage_")
    return events.select("*", decision.alias("is_decision"), (level == "WARN").alias("is_warning"),
                         (level == "ERROR").alias("is_error"), stage.alias("is_stage"),
                         ((level == "INFO") & (kind != "") & ~decision & ~stage).alias("is_event"))


def notable_decisions(events: DataFrame, types: tuple[str, ...] = NOTABLE_DECISIONS) -> DataFrame:
    return events.filter(F.col("decision_type").isin(*types))


def event_extras(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, v: ~k.isin(*KNOWN_KEYS))


def first_hint(events: DataFrame, hint: Column, name: str) -> DataFrame:
    """Hint of the earliest event of each item that yields one."""
    h = events.select("item_id", "seq", hint.alias(name))
    return h.groupBy("item_id").agg(F.min_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name))


def source_hint() -> Column:
    """Disc source named by an event, or NULL."""
    disc = F.lower(F.trim(F.col("fields")["disc_type"]))
    result = F.lower(F.trim("decision_result"))
    text = F.lower(F.concat_ws(" ", "decision_reason", "msg", F.col("fields")["device"]))
    probe = F.col("decision_type") == "bdinfo_availability"
    return (F.when(disc.isin("blu-ray", "bluray", "bd"), "bluray").when(disc == "dvd", "dvd")
            .when(probe & result.isin("bluray", "dvd", "unknown"), result)
            .when(text.contains("video_ts"), "dvd"))


def media_hint() -> Column:
    result = F.lower(F.trim("decision_result"))
    return F.when((F.col("decision_type") == "tmdb_search") & result.isin("tv", "movie"), result)


DECISION_KEY = ("item_id", "decision_type", "decision_result", "decision_reason")


def decision_groups(decisions: DataFrame) -> DataFrame:
    """Per (type, result, reason): count, first position and whether messages or extras vary.

    Members stay rows (`decision_entries`); gathering them would put a whole group into one task.
    """
    extras = F.to_json(F.array_sort(F.map_entries(event_extras(F.col("fields")))))
    d = decisions.select(*DECISION_KEY, "seq", F.coalesce("msg", F.lit("")).alias("m"), F.coalesce(extras, F.lit("")).alias("x"))
    return d.groupBy(*DECISION_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        ((F.min("m") != F.max("m")) | (F.min("x") != F.max("x"))).alias("varies"))


def decision_entries(decisions: DataFrame) -> DataFrame:
    """Every decision with the position of its group, in group order then entry order by (first_seq, seq)."""
    g = decisions.groupBy(*DECISION_KEY).agg(F.min("seq").alias("first_seq"))
    cond = [decisions[k].eqNullSafe(g[k]) for k in DECISION_KEY]
    return decisions.join(g, cond).select(decisions["*"], g["first_seq"])


def stage_timings(events: DataFrame) -> DataFrame:
    """Per item and stage: starts, completions, first start, last completion, last positive duration."""
    start, done = F.col("event_type") == "stage_start", F.col("event_type") == "stage_complete"
    return events.filter(F.coalesce("stage", F.lit("")) != "").groupBy("item_id", "stage").agg(
        F.count_if(start).alias("starts"), F.count_if(done).alias("completions"),
        F.min_by("ts", F.when(start, F.col("seq"))).alias("started_at"),
        F.max_by("ts", F.when(done, F.col("seq"))).alias("completed_at"),
        F.coalesce(F.max_by("duration", F.when(done & (F.col("duration") > 0), F.col("seq"))), F.lit(0.0)).alias("duration"))


def histogram(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count and percent of every sampled value of a key."""
    counted = values.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counted.join(total, keys).withColumn("percent", F.col("n") * 100.0 / F.col("total")).drop("total")


def histogram_vote(values: DataFrame, keys: list[str], value: str, source: str | None = None) -> DataFrame:
    """Winner per key by count, then lowest value; several-values flag and, with `source`, a differs flag."""
    counted = values.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    out = counted.groupBy(*keys).agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("winner"), F.max("n").alias("winner_n"),
        F.sum("n").alias("total"), (F.count(F.lit(1)) > 1).alias("several"))
    if source:
        base = values.groupBy(*keys).agg(F.max(source).alias("_source"))
        out = out.join(base, keys).withColumn("differs", F.col("winner") != F.col("_source")).drop("_source")
    return out


def count_string(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`a=1,b=2` per key, `none` when no name is known.  The list holds distinct names, never rows."""
    known = rows.filter(F.coalesce(name, F.lit("")) != "").groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(name), F.col("n").cast("string")))), ",")
    out = known.groupBy(*keys).agg(text.alias("counts"))
    return (rows.select(*keys).distinct().join(out, keys, "left")
            .select(*keys, F.coalesce("counts", F.lit("none")).alias("counts")))


def downsample_progress(events: DataFrame, keep: int = PROGRESS_ROWS) -> DataFrame:
    """Every ceil(n/keep)-th and the last row of `*_progress` types with more than `keep` rows; others untouched."""
    ticks = events.filter(F.col("event_type").endswith("_progress"))
    rest = events.filter(~F.coalesce(F.col("event_type").endswith("_progress"), F.lit(False)))
    d = sliced_window(ticks, ["item_id", "event_type"], ["seq"], int_slice("seq"), number="_i", total="_n")
    stride = F.ceil(F.col("_n") / keep)
    kept = d.filter((F.col("_n") <= keep) | ((F.col("_i") - 1) % stride == 0) | (F.col("_i") == F.col("_n")))
    return rest.unionByName(kept.drop("_i", "_n"))


def omitted_counts(events: DataFrame, kept: DataFrame) -> DataFrame:
    a = events.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    b = kept.groupBy("item_id").agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, "item_id", "left").select("item_id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("omitted"))


def tail_or_page(events: DataFrame, since: int = 0, limit: int = 200) -> DataFrame:
    """The newest `limit` rows without a cursor, the oldest `limit` rows at or after the cursor otherwise."""
    limit = limit if limit > 0 else 200
    if since > 0:
        return events.filter(F.col("seq") >= since).orderBy("seq").limit(limit)
    return events.orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def next_cursor(page: DataFrame, events: DataFrame) -> DataFrame:
    """One row: the last sequence of the page + 1, or the head of the log when the page is empty."""
    both = page.select("seq", F.lit(True).alias("p")).unionByName(events.select("seq", F.lit(False).alias("p")))
    return both.agg((F.coalesce(F.max(F.when(F.col("p"), F.col("seq"))), F.max("seq"), F.lit(0)) + 1).alias("next"))


def blocked_waits(events: DataFrame, keys: list[str]) -> DataFrame:
    """First "blocked" of a run paired with the next "granted" per task; repeats and unpaired grants are silent.

    `events` (keys, seq, ts, kind in blocked / granted).
    """
    e = sliced_window(events, keys, ["seq"], int_slice("seq"), lags={"_prev": "kind"})
    blocked, prev_blocked = F.col("kind") == "blocked", F.coalesce(F.col("_prev") == "blocked", F.lit(False))
    e = e.withColumn("_opened", F.when(blocked & ~prev_blocked, F.struct("seq", "ts")))
    e = sliced_window(e, keys, ["seq"], int_slice("seq"), last_known={"_since": "_opened"})
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_since.ts").cast("timestamp"))
    return (e.filter((F.col("kind") == "granted") & prev_blocked)
            .select(*keys, "seq", F.col("_since.seq").alias("blocked_seq"), micros.alias("waited_micros")))


def throttle(events: DataFrame, keys: list[str], gap_micros: int) -> DataFrame:
    """Greedy thinning: a row is emitted when at least `gap_micros` have passed since the last emitted row of its key.

    `events` (keys, seq, at) with `at` in microseconds.  Every row points to the first row at or after at + gap;
    the emitted rows are those reached from a key's first row.  The reach is found by pointer doubling: a number
    of joins that grows with the logarithm of the longest chain, and no key is folded in one task.
    """
    rows = events.select(*keys, "seq", "at")
    marks = (rows.select(*keys, (-F.col("at")).alias("neg"), F.lit(0).alias("probe"), (-F.col("seq")).alias("tie"),
                         F.struct("at", "seq").alias("hit"), F.lit(None).cast("long").alias("origin"))
             .unionByName(rows.select(*keys, (-F.col("at") - gap_micros).alias("neg"), F.lit(1).alias("probe"),
                                      (-F.col("seq")).alias("tie"), F.lit(None).cast("struct<at:bigint,seq:bigint>").alias("hit"),
                                      F.col("seq").alias("origin"))))
    near = sliced_window(marks, keys, ["neg", "probe", "tie"], "neg",
                         last_known={"next": "hit"})
    jump = cut_lineage(near.filter("probe = 1 and next is not null").select(*keys, F.col("origin").alias("seq"),
                                                                           F.col("next.seq").alias("to")))
    first = rows.groupBy(*keys).agg(F.min_by("seq", F.struct("at", "seq")).alias("seq"))
    reached = cut_lineage(first.select(*keys, "seq"))
    while not jump.isEmpty():
        stepped = reached.join(jump, [*keys, "seq"]).select(*keys, F.col("to").alias("seq"))
        reached = cut_lineage(reached.unionByName(stepped).distinct())
        second = jump.select(*keys, F.col("seq").alias("to"), F.col("to").alias("far"))
        jump = cut_lineage(jump.join(second, [*keys, "to"]).select(*keys, "seq", F.col("far").alias("to")))
    return events.join(reached, [*keys, "seq"], "left_semi")


def log_files_for_lifetime(files: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, file_name): the file active at each item's creation and every later one.

    The time stamp in the file name decides; an item older than all files starts with the earliest.  The as-of
    step is one ordered pass over files and items cut into days, the expansion an equi-join on months.
    """
    stamp = F.to_timestamp(F.concat(F.regexp_extract("file_name", r"(\d{8})T(\d{6})", 1),
                                    F.regexp_extract("file_name", r"(\d{8})T(\d{6})", 2)), "yyyyMMddHHmmss")
    f = files.select("file_name", stamp.alias("ts")).filter("ts is not null")
    created = F.date_trunc("second", F.col("created_at").cast("timestamp"))
    both = (f.select(F.unix_seconds("ts").alias("at"), F.lit(0).alias("probe"), F.lit(0).cast("long").alias("item_id"),
                     F.col("ts").alias("start"))
            .unionByName(items.select(F.unix_seconds(created).alias("at"), F.lit(1).alias("probe"), F.col("item_id").cast("long"),
                                      F.lit(None).cast("timestamp").alias("start"))))
    near = sliced_window(both, [], ["at", "probe", "item_id"], "at", last_known={"active": "start"})
    ends = f.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    start = near.filter("probe = 1").join(F.broadcast(ends)).select(
        "item_id", F.coalesce("active", "lo").alias("start"), "hi")
    months = F.sequence(F.trunc("start", "month"), F.trunc("hi", "month"), F.expr("INTERVAL 1 MONTH"))
    spans = start.select("item_id", "start", F.explode(months).alias("month"))
    return (spans.join(f.withColumn("month", F.trunc("ts", "month")), "month").filter("ts >= start")
            .select("item_id", "file_name"))
