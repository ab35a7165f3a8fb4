"""Queue items and their task graphs: readiness, reach, stages, durations, and set-based snapshot transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.session import store

# Pipeline stages in order, and the template of dependencies between them.
STAGES = ("identification", "ripping", "episode_identification", "encoding", "analysis", "subtitling", "apply", "organizing")
TERMINAL = ("failed", "completed")
TEMPLATE: dict[str, tuple[str, ...]] = {
    "identification": (),
    "ripping": ("identification",),
    "episode_identification": ("ripping",),
    "encoding": ("identification",),
    "analysis": ("episode_identification",),
    "subtitling": ("analysis",),
    "apply": ("subtitling", "encoding"),
    "organizing": ("apply",),
}
STOP_REASON = "Stop requested by user"
IDS_PER_ITEM = 100


def stage_ordinal(stage: Column) -> Column:
    """0-based position of a stage, NULL outside the pipeline."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage), F.lit(0)) - 1


def list_items(items: DataFrame, stages: Sequence[str] = ()) -> DataFrame:
    """Items in creation order, optionally of some stages only."""
    return (items.filter(F.col("stage").isin(*stages)) if stages else items).orderBy("created_at", "item_id")


def ready_tasks(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Pending tasks of live items whose dependencies are all done; a missing dependency is not done."""
    live = items.filter(~F.col("user_stopped") & ~F.col("stage").isin(*TERMINAL)).select("item_id", "created_at")
    cand = tasks.filter("state = 'pending'").join(live, "item_id")
    done = tasks.filter("state = 'done'").select(F.col("task_id").alias("dep"))
    waiting = (cand.select("task_id", F.explode("deps").alias("dep")).join(done, "dep", "left_anti")
               .select("task_id").distinct())
    return cand.join(waiting, "task_id", "left_anti").orderBy("created_at", "task_id")


def reached_tasks(tasks: DataFrame) -> DataFrame:
    """Task ids that left pending or that a started task depends on, directly or not."""
    return _reached(store(tasks.select("task_id", "state", "deps"), "tasks")).distinct()


def _reached(tasks: DataFrame) -> DataFrame:
    """The same of stored tasks, with repeats.

    Started tasks are reached already, so only edges to other tasks are kept; one join of these per level of the graph over the newly
    reached ids only.
    """
    started = tasks.filter("state <> 'pending'").select("task_id")
    edges = tasks.filter(F.size("deps") > 0).select("task_id", F.explode("deps").alias("dep"))
    edges = store(edges.join(started.withColumnRenamed("task_id", "dep"), "dep", "left_anti").select("task_id", "dep"), "open-edges")
    reached = frontier = started
    while True:
        step = edges.join(frontier, "task_id", "left_semi").select(F.col("dep").alias("task_id")).distinct()
        # started ids are no ends of open edges, so they need no look-up
        frontier = store(step if frontier is started else step.join(later, "task_id", "left_anti"), "newly-reached")
        if frontier.isEmpty():
            return reached
        later = frontier if reached is started else later.unionByName(frontier)
        reached = started.unionByName(later)


def stage_gate(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Furthest stage and phase flags per item; the stage ordinal decides where tasks carry no edges.

    `items` (item_id, stage, failed_at_stage, media_type, disc_source).  The tasks are written once; what they tell of an item is one
    small row, with the stages that it has reached as the bits of a number.
    """
    tasks = store(tasks.select("item_id", "task_id", "type", "state", "deps"), "tasks")
    bit = F.get(F.array(*[F.lit(1 << i) for i in range(len(STAGES))]), stage_ordinal(F.col("type")).cast("int"))
    started = F.col("state") != "pending"
    told = tasks.select("item_id", F.when(started, bit).alias("bits"), (F.size("deps") > 0).alias("edges"), F.when(started, stage_ordinal(F.col("type"))).alias("t_ord"))
    waiting = (tasks.filter(~F.coalesce(started, F.lit(False))).select("item_id", "task_id", "type").join(_reached(tasks), "task_id", "left_semi")
               .select("item_id", bit.alias("bits")))
    t = (told.unionByName(waiting, allowMissingColumns=True).groupBy("item_id")
         .agg(F.bit_or("bits").alias("bits"), F.bool_or("edges").alias("edges"), F.max("t_ord").alias("t_ord")))
    own = F.when((F.col("stage") == "failed") & (F.coalesce("failed_at_stage", F.lit("")) != ""), F.col("failed_at_stage")).otherwise(F.col("stage"))
    g = (items.join(t, "item_id", "left")
         .withColumn("own", own).withColumn("own_ord", F.coalesce(stage_ordinal(F.col("own")), F.lit(0))))
    ahead = F.coalesce(F.col("t_ord") > F.col("own_ord"), F.lit(False))
    names = F.array(*[F.lit(s) for s in STAGES])
    g = g.withColumn("furthest", F.when(ahead, F.element_at(names, (F.col("t_ord") + 1).cast("int"))).otherwise(F.col("own")))
    g = g.withColumn("ord", F.greatest(F.col("own_ord"), F.coalesce("t_ord", F.lit(0))))

    def phase(stage: str) -> Column:
        by_edge = F.coalesce("bits", F.lit(0)).bitwiseAND(F.lit(1 << STAGES.index(stage))) != 0
        return F.when(F.coalesce("edges", F.lit(False)), by_edge).otherwise(F.col("ord") >= STAGES.index(stage))

    return g.select(
        "item_id", "furthest", F.lit(True).alias("phase_logs"), phase("ripping").alias("phase_rip_cache"),
        ((F.col("media_type") == "tv") & phase("episode_identification")).alias("phase_episode_id"),
        phase("encoding").alias("phase_encoded"), phase("encoding").alias("phase_crop"),
        phase("subtitling").alias("phase_subtitles"), phase("analysis").alias("phase_commentary"),
        (phase("encoding") & (F.col("disc_source") != "dvd")).alias("phase_external_validation"))


def stage_stats(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Items per displayed stage: terminal stage, else earliest running task, else the item's own stage."""
    run = tasks.groupBy("item_id").agg(F.min_by("type", F.when(F.col("state") == "running", F.col("task_id"))).alias("run"))
    shown = F.when(F.col("stage").isin(*TERMINAL), F.col("stage")).otherwise(F.coalesce("run", "stage"))
    return items.join(run, "item_id", "left").groupBy(shown.alias("display_stage")).agg(F.count(F.lit(1)).alias("n"))


def derive_stage(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """(item_id, old stage, derived stage): earliest task not done, else completed, for idle open items with tasks."""
    t = tasks.groupBy("item_id").agg(
        F.bool_or(F.col("state") == "running").alias("busy"),
        F.min_by("type", F.when(F.col("state") != "done", F.col("task_id"))).alias("next_type"))
    openly = ~F.col("busy") & ~F.col("user_stopped") & ~F.col("stage").isin(*TERMINAL)
    return (items.join(t, "item_id").filter(openly)
            .select("item_id", "stage", F.coalesce("next_type", F.lit("completed")).alias("derived")))


def duration_seconds(start: str, end: str) -> Column:
    """Elapsed seconds, NULL when a side is missing or they are inverted."""
    span = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6
    return F.when(span >= 0, span)


def task_durations(tasks: DataFrame) -> DataFrame:
    return tasks.select("item_id", "task_id", "type", duration_seconds("started_at", "finished_at").alias("seconds"))


def item_wall_time(tasks: DataFrame) -> DataFrame:
    g = tasks.groupBy("item_id").agg(F.min("started_at").alias("first_start"), F.max("finished_at").alias("last_finish"))
    return g.select("item_id", duration_seconds("first_start", "last_finish").alias("seconds"))


def overall_progress(tasks: DataFrame) -> DataFrame:
    """(completed + current percent) / total per item, clamped; `percent` of running tasks is the current one."""
    g = tasks.groupBy("item_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "done").alias("done"),
                                     F.coalesce(F.min_by("percent", F.when(F.col("state") == "running", F.col("task_id"))), F.lit(0.0)).alias("now"))
    now = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("now")))
    progress = F.least(F.col("done") + now / 100, F.col("total"))
    return g.select("item_id", "done", "total", (progress / F.col("total") * 100).alias("progress"))


def item_overview(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Item row with totals of its tasks, pre-aggregated before the join."""
    t = tasks.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(F.col("state") == "done").alias("done"),
        F.count_if(F.col("state") == "running").alias("running"), F.min_by("type", "task_id").alias("first_type"),
        F.count_if(F.col("number") > 0).alias("identified"), F.count_if(F.col("skipped")).alias("skipped"))

    def z(c: str) -> Column:
        return F.coalesce(c, F.lit(0)).alias(c)

    return items.join(t, "item_id", "left").select("item_id", "stage", z("planned"), z("done"), z("running"),
                                                   z("identified"), z("skipped"), "first_type")


def pending_work(keys: DataFrame, inputs: DataFrame, outputs: DataFrame, by: list[str]) -> DataFrame:
    """Keys with a completed input and no completed output; completed outputs are listed as skipped."""
    done = outputs.filter("completed").select(*by).distinct()
    have = inputs.filter("completed").select(*by).distinct()
    todo = keys.join(done, by, "left_anti").join(have, by, "left_semi").withColumn("status", F.lit("pending"))
    skipped = keys.join(done, by, "left_semi").withColumn("status", F.lit("skipped"))
    return todo.unionByName(skipped)


# --- snapshot transitions: item columns item_id, stage, in_progress, failed_at_stage, error_message,
# --- needs_review, review_reasons array<string>, user_stopped


def _commanded(items: DataFrame, ids: DataFrame | None, name: str = "_hit") -> DataFrame:
    if ids is None:
        return items.withColumn(name, F.lit(True))
    marked = ids.select("item_id").distinct().withColumn(name, F.lit(True))
    return items.join(marked, "item_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _set(df: DataFrame, hit: Column, **values: Column) -> DataFrame:
    return df.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def resume_stage() -> Column:
    """The recorded failure stage when it is a real stage, else the first."""
    return F.when(F.col("failed_at_stage").isin(*STAGES), F.col("failed_at_stage")).otherwise(F.lit(STAGES[0]))


def retry_failed(items: DataFrame, tasks: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Failed items (all, or the given ids) return to their resume stage; their tasks disappear."""
    d = _commanded(items, ids).withColumn("_hit", F.col("_hit") & (F.col("stage") == "failed"))
    hit, null = F.col("_hit"), F.lit(None).cast("string")
    gone = d.filter("_hit").select("item_id")
    out = _set(d.withColumn("_to", resume_stage()), hit, stage=F.col("_to"), in_progress=F.lit(False), failed_at_stage=null,
               error_message=null, needs_review=F.lit(False), review_reasons=F.array().cast("array<string>"), user_stopped=F.lit(False))
    return out.drop("_hit", "_to"), tasks.join(gone, "item_id", "left_anti")


def stop_items(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Failed and stopped, remembering a non-terminal stage, with the stop reason appended."""
    d = _commanded(items, ids)
    hit, live = F.col("_hit"), ~F.col("stage").isin(*TERMINAL)
    d = _set(d, hit & live, failed_at_stage=F.col("stage"))
    return _set(d, hit, stage=F.lit("failed"), in_progress=F.lit(False), user_stopped=F.lit(True), needs_review=F.lit(True),
                review_reasons=F.array_append(F.coalesce("review_reasons", F.array().cast("array<string>")), F.lit(STOP_REASON))).drop("_hit")


def complete_stage(items: DataFrame, moves: DataFrame) -> DataFrame:
    """`moves` (item_id, next_stage): advance items unless the user stopped them."""
    d = items.join(moves.select("item_id", "next_stage"), "item_id", "left")
    hit = F.col("next_stage").isNotNull() & ~F.col("user_stopped")
    return _set(d, hit, stage=F.col("next_stage"), in_progress=F.lit(False)).drop("next_stage")


def fail_stage(items: DataFrame, failures: DataFrame) -> DataFrame:
    """`failures` (item_id, failed_at, error): mark items failed unless the user stopped them."""
    d = items.join(failures.select("item_id", "failed_at", "error"), "item_id", "left")
    hit = F.col("failed_at").isNotNull() & ~F.col("user_stopped")
    return _set(d, hit, stage=F.lit("failed"), in_progress=F.lit(False), failed_at_stage=F.col("failed_at"),
                error_message=F.col("error")).drop("failed_at", "error")


def save_work(items: DataFrame, updates: DataFrame) -> DataFrame:
    """`updates` (item_id and new work columns): replace the work columns of items that are not stopped."""
    cols = [c for c in updates.columns if c != "item_id"]
    u = updates.select("item_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    d = items.join(u, "item_id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & ~F.col("user_stopped")
    return _set(d, hit, **{c: F.col(f"_new_{c}") for c in cols}).select(*items.columns)


def clear_completed(items: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = items.filter("stage = 'completed'").select("item_id")
    return items.filter("stage <> 'completed'"), tasks.join(gone, "item_id", "left_anti")


def clear_all(items: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Everything goes but what is in progress, with its tasks."""
    stay = items.filter(F.coalesce("in_progress", F.lit(False)))
    return stay, tasks.join(stay.select("item_id"), "item_id", "left_semi")


def recover_running(items: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a restart nothing is in progress and running tasks are pending again."""
    return items.withColumn("in_progress", F.lit(False)), _set(tasks, F.col("state") == "running", state=F.lit("pending"))


def expected_work(items: DataFrame, tasks: DataFrame, template: dict[str, tuple[str, ...]] = TEMPLATE) -> DataFrame:
    """Template tasks for items without any; those before the item's stage are done, others pending."""
    order = list(template)
    if len(order) >= IDS_PER_ITEM:
        raise ValueError(f"task ids leave room for {IDS_PER_ITEM - 1} stages per item")
    for i, (stage, deps) in enumerate(template.items()):
        if any(d not in order[:i] for d in deps):
            raise ValueError(f"{stage} depends on a stage that is not declared earlier")
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("type"),
                              F.array(*[F.lit(order.index(d)) for d in deps]).cast("array<int>").alias("dep_ords"))
                     for i, (s, deps) in enumerate(template.items())])
    position = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage")), F.lit(0)) - 1, F.lit(len(order)))
    missing = items.join(tasks.select("item_id").distinct(), "item_id", "left_anti")
    e = missing.select("item_id", position.alias("pos"), F.explode(rows).alias("t"))
    base = F.col("item_id") * IDS_PER_ITEM
    return e.select("item_id", (base + F.col("t.ord") + 1).alias("task_id"), F.col("t.type").alias("type"),
                    F.when(F.col("t.ord") < F.col("pos"), "done").otherwise("pending").alias("state"),
                    F.transform("t.dep_ords", lambda o: base + o + 1).alias("deps"))


def upsert_by_key(existing: DataFrame, changes: DataFrame, keys: list[str], name: str, version: str) -> DataFrame:
    """Latest row per (keys, name in any case); an aggregate, so a hot key is reduced before the shuffle."""
    both = existing.unionByName(changes)
    row = F.struct(*both.columns)
    newest = both.groupBy(*keys, F.lower(name).alias("_k")).agg(F.max_by(row, version).alias("r"))
    return newest.select("r.*")


def retry_member(items: DataFrame, episodes: DataFrame, assets: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcome per command, assets after): retry one episode of failed items.

    The assets of the three later kinds with the command's key are reset whether failed or not.
    """
    have = episodes.select("item_id", F.lower("key").alias("_k")).distinct().withColumn("found", F.lit(True))
    c = (commands.select("item_id", "key", F.lower("key").alias("_k"))
         .join(items.select("item_id", "stage"), "item_id", "left").join(have, ["item_id", "_k"], "left"))
    outcome = (F.when(F.col("stage").isNull(), "not_found").when(F.col("stage") != "failed", "not_failed")
               .when(F.col("found").isNull(), "episode_not_found").otherwise("retried"))
    c = c.withColumn("outcome", outcome)
    hits = c.filter("outcome = 'retried'").select("item_id", "_k").distinct().withColumn("_reset", F.lit(True))
    a = (assets.withColumn("_k", F.lower("key")).join(hits, ["item_id", "_k"], "left")
         .withColumn("_reset", F.coalesce("_reset", F.lit(False)) & F.col("kind").isin("encoded", "subtitled", "final")))
    out = _set(a, F.col("_reset"), status=F.lit(""), path=F.lit(""), error=F.lit(""))
    return c.select("item_id", "key", "outcome"), out.select(*assets.columns)


# --- review reasons and display titles


def review_reasons(text: Column) -> Column:
    """Parsed JSON reasons; blank or invalid text gives NULL."""
    return F.when(F.trim(text) != "", F.from_json(text, "array<string>"))


def review_summary(reasons: Column, limit: int) -> Column:
    n = F.size(reasons)
    full = F.array_join(reasons, "; ")
    if limit <= 0:
        return F.coalesce(full, F.lit(""))
    capped = F.concat(F.array_join(F.slice(reasons, 1, limit), "; "), F.lit("; +"), (n - limit).cast("string"), F.lit(" more"))
    return F.coalesce(F.when(n > limit, capped).otherwise(full), F.lit(""))


def summarise_reviews(items: DataFrame, limit: int = 2) -> DataFrame:
    r = review_reasons(F.col("review_reason"))
    return items.select("item_id", display_title().alias("display_title"), F.coalesce(F.get(r, 0), F.lit("")).alias("primary_reason"),
                        review_summary(r, limit).alias("summary"),
                        F.when(F.trim("review_reason") == "", "none").when(r.isNull(), "invalid").otherwise("parsed").alias("status"))


def reason_counts(items: DataFrame) -> DataFrame:
    return (items.select(F.explode(review_reasons(F.col("review_reason"))).alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


def display_title() -> Column:
    """Own title, else catalogue display title with year, show with season, title with year, item number."""
    def j(path: str) -> Column:
        return F.nullif(F.trim(F.get_json_object("metadata", path)), F.lit(""))

    year = F.nullif(F.get_json_object("metadata", "$.year"), F.lit(""))
    with_year = F.concat(F.lit(" ("), year, F.lit(")"))
    shown, show, title = j("$.display_title"), j("$.show_title"), j("$.title")
    season = F.get_json_object("metadata", "$.season_number").try_cast("int")
    return F.coalesce(
        F.nullif(F.trim("title"), F.lit("")),
        F.when(~shown.contains("("), F.concat(shown, with_year)), shown,
        F.when(season > 0, F.concat(show, F.lit(" Season "), F.lpad(season.cast("string"), 2, "0"))), show,
        F.concat(title, with_year), title,
        F.when(F.col("item_id") > 0, F.concat(F.lit("Item "), F.col("item_id").cast("string"))), F.lit("Unknown Item"))
