"""Queries of queue items and task graphs: orders as items, order lines as tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.operators import tasks as K
from catalogops.plans import views as V
from catalogops.plans.registry import query
from catalogops.plans.views import STAGE_LIST, stamp, stamp_sql, with_views

BOTH = with_views("v_items", "v_tasks")
ITEMS = with_views("v_items")
TASKS = with_views("v_tasks")
TERM = "('failed', 'completed')"


@query("list_items", f"{ITEMS} SELECT item_id, stage, {stamp_sql('created_at')} FROM v_items WHERE stage NOT IN {TERM}")
def list_items(t):
    return K.list_items(V.items(t), K.STAGES).select("item_id", "stage", stamp("created_at"))


@query("list_tasks", f"{TASKS} SELECT item_id, task_id, type, state, {stamp_sql('started_at')}, {stamp_sql('finished_at')} FROM v_tasks")
def list_tasks(t):
    return V.tasks(t).select("item_id", "task_id", "type", "state", stamp("started_at"), stamp("finished_at"))


@query("ready_tasks", f"""{BOTH} SELECT t.item_id, task_id, type FROM v_tasks t JOIN v_items i USING (item_id)
WHERE state = 'pending' AND NOT user_stopped AND stage NOT IN {TERM}
  AND NOT EXISTS (SELECT 1 FROM (SELECT task_id, unnest(deps) AS dep FROM v_tasks) d LEFT JOIN v_tasks s ON s.task_id = d.dep AND s.state = 'done'
    WHERE d.task_id = t.task_id AND s.task_id IS NULL)""")
def ready(t):
    return K.ready_tasks(V.items(t), V.tasks(t)).select("item_id", "task_id", "type")


GATE = f"""WITH RECURSIVE v_items AS ({V.SQL['v_items']}), v_members AS ({V.SQL['v_members']}), v_tasks AS MATERIALIZED ({V.SQL['v_tasks']}),
reach AS (SELECT task_id FROM v_tasks WHERE state <> 'pending' UNION SELECT unnest(t.deps) FROM reach r JOIN v_tasks t USING (task_id)),
per AS (SELECT item_id, list(DISTINCT type) AS hit FROM v_tasks WHERE task_id IN (SELECT task_id FROM reach) GROUP BY item_id),
tt AS (SELECT item_id, bool_or(len(deps) > 0) AS edges, max(list_position({STAGE_LIST}, type) - 1) FILTER (state <> 'pending') AS t_ord FROM v_tasks GROUP BY item_id),
g AS (SELECT i.*, edges, t_ord, coalesce(hit, []) AS hit, CASE WHEN stage = 'failed' AND failed_at_stage <> '' THEN failed_at_stage ELSE stage END AS own
  FROM v_items i LEFT JOIN tt USING (item_id) LEFT JOIN per USING (item_id)),
h AS (SELECT *, coalesce(list_position({STAGE_LIST}, own) - 1, 0) AS own_ord, greatest(coalesce(list_position({STAGE_LIST}, own) - 1, 0), coalesce(t_ord, 0)) AS ord FROM g)"""


def phase_sql(stage: str) -> str:
    return f"CASE WHEN coalesce(edges, false) THEN list_contains(hit, '{stage}') ELSE ord >= {K.STAGES.index(stage)} END"


@query("reached_stages", f"""{GATE} SELECT item_id, CASE WHEN t_ord > own_ord THEN {STAGE_LIST}[t_ord + 1] ELSE own END AS furthest, true AS phase_logs,
  {phase_sql('ripping')} AS phase_rip_cache, media_type = 'tv' AND {phase_sql('episode_identification')} AS phase_episode_id,
  {phase_sql('encoding')} AS phase_encoded, {phase_sql('encoding')} AS phase_crop, {phase_sql('subtitling')} AS phase_subtitles,
  {phase_sql('analysis')} AS phase_commentary, {phase_sql('encoding')} AND disc_source <> 'dvd' AS phase_external_validation FROM h""")
def reached(t):
    return K.stage_gate(V.items(t), V.tasks(t))


@query("stage_stats", f"""{BOTH} SELECT CASE WHEN stage IN {TERM} THEN stage ELSE coalesce(run, stage) END AS display_stage, count(*) AS n
FROM v_items LEFT JOIN (SELECT item_id, min_by(type, task_id) AS run FROM v_tasks WHERE state = 'running' GROUP BY item_id) USING (item_id) GROUP BY 1""")
def stage_stats(t):
    return K.stage_stats(V.items(t), V.tasks(t))


@query("derive_stage", f"""{BOTH} SELECT item_id, stage, coalesce(nx, 'completed') AS derived FROM v_items JOIN (
  SELECT item_id, bool_or(state = 'running') AS busy, min_by(type, task_id) FILTER (state <> 'done') AS nx FROM v_tasks GROUP BY item_id) USING (item_id)
WHERE NOT busy AND NOT user_stopped AND stage NOT IN {TERM}""")
def derive(t):
    return K.derive_stage(V.items(t), V.tasks(t))


@query("task_durations", f"""{TASKS} SELECT item_id, task_id, type,
  CASE WHEN finished_at >= started_at THEN (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 END AS seconds FROM v_tasks""")
def durations(t):
    return K.task_durations(V.tasks(t))


@query("item_wall_time", f"""{TASKS} SELECT item_id, CASE WHEN f >= s THEN (epoch_us(f) - epoch_us(s)) / 1e6 END AS seconds
FROM (SELECT item_id, min(started_at) AS s, max(finished_at) AS f FROM v_tasks GROUP BY item_id)""")
def wall_time(t):
    return K.item_wall_time(V.tasks(t))


@query("overall_progress", f"""{TASKS} SELECT item_id, done, total, round(least(done + least(100, now) / 100, total) / total * 100, 6) AS progress FROM (
  SELECT item_id, count(*) AS total, count(*) FILTER (state = 'done') AS done, coalesce(min_by(percent, task_id) FILTER (state = 'running'), 0) AS now FROM v_tasks GROUP BY item_id)""")
def progress(t):
    return K.overall_progress(V.tasks(t)).withColumn("progress", F.round("progress", 6))


@query("item_overview", f"""{BOTH} SELECT item_id, stage, coalesce(planned, 0) AS planned, coalesce(done, 0) AS done, coalesce(running, 0) AS running,
  coalesce(identified, 0) AS identified, coalesce(skipped, 0) AS skipped, first_type FROM v_items LEFT JOIN (SELECT item_id, count(*) AS planned,
  count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'running') AS running, count(*) FILTER (number > 0) AS identified,
  count(*) FILTER (skipped) AS skipped, min_by(type, task_id) AS first_type FROM v_tasks GROUP BY item_id) USING (item_id)""")
def overview(t):
    return K.item_overview(V.items(t), V.tasks(t))


@query("pending_work", """SELECT doc_id, 'pending' AS status FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT doc_id, 'skipped' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def pending_work(t):
    d = t.documents
    return K.pending_work(d.select("doc_id"), d.select("doc_id", (F.col("n_chars") > 500).alias("completed")),
                          t.labels.select("doc_id", (F.col("quality") == 1).alias("completed")), ["doc_id"])


def _snap(t):
    return V.items(t).withColumn("review_reasons", F.coalesce(K.review_reasons(F.col("review_reason")), F.array().cast("array<string>")))


def _show(df):
    return df.select("item_id", "stage", "in_progress", F.coalesce("failed_at_stage", F.lit("-")).alias("failed_at_stage"),
                     F.coalesce("error_message", F.lit("-")).alias("error_message"), "needs_review", "user_stopped",
                     F.array_join("review_reasons", "|").alias("reasons"))


SNAP = ITEMS + """, s AS (SELECT *, CASE item_id % 5 WHEN 0 THEN 'Low confidence|' || (review_reason->>'$[1]') || '|Gap'
  WHEN 1 THEN review_reason->>'$[0]' ELSE '' END AS reasons FROM (SELECT * REPLACE (CASE WHEN item_id % 5 < 2 THEN review_reason END AS review_reason) FROM v_items))"""
IDS = "needs_review"


@query("retry_failed_items", f"""{SNAP}, h AS (SELECT *, stage = 'failed' AND {IDS} AS hit FROM s)
SELECT item_id, CASE WHEN hit THEN CASE WHEN failed_at_stage = 'encoding' THEN 'encoding' ELSE 'identification' END ELSE stage END AS stage,
  in_progress AND NOT hit AS in_progress, CASE WHEN hit THEN '-' ELSE failed_at_stage END AS failed_at_stage,
  CASE WHEN hit THEN '-' ELSE error_message END AS error_message, needs_review AND NOT hit AS needs_review,
  user_stopped AND NOT hit AS user_stopped, CASE WHEN hit THEN '' ELSE reasons END AS reasons FROM h""")
def retry_items(t):
    i = _snap(t)
    return _show(K.retry_failed(i, V.tasks(t), i.filter(IDS).select("item_id"))[0])


@query("retry_failed_tasks", f"{BOTH} SELECT task_id FROM v_tasks WHERE item_id NOT IN (SELECT item_id FROM v_items WHERE stage = 'failed')")
def retry_tasks(t):
    return K.retry_failed(_snap(t), V.tasks(t))[1].select("task_id")


@query("stop_items", f"""{SNAP}, h AS (SELECT *, {IDS} AS hit FROM s)
SELECT item_id, CASE WHEN hit THEN 'failed' ELSE stage END AS stage, in_progress AND NOT hit AS in_progress,
  CASE WHEN hit AND stage NOT IN {TERM} THEN stage ELSE failed_at_stage END AS failed_at_stage, error_message,
  needs_review OR hit AS needs_review, user_stopped OR hit AS user_stopped,
  CASE WHEN hit THEN CASE WHEN reasons = '' THEN '' ELSE reasons || '|' END || 'Stop requested by user' ELSE reasons END AS reasons FROM h""")
def stop(t):
    i = _snap(t)
    return _show(K.stop_items(i, i.filter(IDS).select("item_id")))


@query("complete_stage", f"""{SNAP}, h AS (SELECT *, {IDS} AND NOT user_stopped AS hit FROM s)
SELECT item_id, CASE WHEN hit THEN 'apply' ELSE stage END AS stage, in_progress AND NOT hit AS in_progress, failed_at_stage, error_message,
  needs_review, user_stopped, reasons FROM h""")
def complete(t):
    i = _snap(t)
    return _show(K.complete_stage(i, i.filter(IDS).select("item_id", F.lit("apply").alias("next_stage"))))


@query("fail_stage", f"""{SNAP}, h AS (SELECT *, {IDS} AND NOT user_stopped AS hit FROM s)
SELECT item_id, CASE WHEN hit THEN 'failed' ELSE stage END AS stage, in_progress AND NOT hit AS in_progress,
  CASE WHEN hit THEN 'ripping' ELSE failed_at_stage END AS failed_at_stage, CASE WHEN hit THEN 'disc error' ELSE error_message END AS error_message,
  needs_review, user_stopped, reasons FROM h""")
def fail(t):
    i = _snap(t)
    f = i.filter(IDS).select("item_id", F.lit("ripping").alias("failed_at"), F.lit("disc error").alias("error"))
    return _show(K.fail_stage(i, f))


@query("save_work", f"""{ITEMS} SELECT item_id, CASE WHEN {IDS} AND NOT user_stopped THEN 'Saved ' || item_id ELSE title END AS title FROM v_items""")
def save(t):
    i = V.items(t)
    u = i.filter(IDS).select("item_id", F.concat(F.lit("Saved "), F.col("item_id").cast("string")).alias("title"))
    return K.save_work(i, u).select("item_id", "title")


@query("clear_completed", f"""{BOTH} SELECT task_id FROM v_tasks WHERE item_id NOT IN (SELECT item_id FROM v_items WHERE stage = 'completed')""")
def clear(t):
    return K.clear_completed(V.items(t), V.tasks(t))[1].select("task_id")


@query("clear_all", f"""{BOTH} SELECT task_id FROM v_tasks WHERE item_id IN (SELECT item_id FROM v_items WHERE in_progress)""")
def clear_everything(t):
    return K.clear_all(V.items(t), V.tasks(t))[1].select("task_id")


@query("recover_running", f"{TASKS} SELECT task_id, CASE WHEN state = 'running' THEN 'pending' ELSE state END AS state FROM v_tasks")
def recover(t):
    return K.recover_running(V.items(t), V.tasks(t))[1].select("task_id", "state")


TEMPLATE_SQL = "(VALUES " + ", ".join(
    f"({i}, '{s}', {[list(K.TEMPLATE).index(d) for d in deps]}::INT[])" for i, (s, deps) in enumerate(K.TEMPLATE.items())) + ") x(ord, type, deps)"


@query("expected_work", f"""{BOTH} SELECT item_id, item_id * 100 + ord + 1 AS task_id, type,
  CASE WHEN ord < coalesce(list_position({STAGE_LIST}, stage) - 1, 8) THEN 'done' ELSE 'pending' END AS state,
  array_to_string(list_transform(x.deps, lambda d: item_id * 100 + d + 1), ',') AS deps
FROM v_items, {TEMPLATE_SQL} WHERE item_id NOT IN (SELECT item_id FROM v_tasks WHERE state <> 'done')""")
def expected(t):
    """Items whose open tasks are missing count as having none."""
    return K.expected_work(V.items(t), V.tasks(t).filter("state <> 'done'")).withColumn("deps", F.array_join("deps", ","))


@query("upsert_by_key", """SELECT user_id, upper(event_type) AS name, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def upsert(t):
    e = t.events.select("user_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("name"), "event_id", "value")
    out = K.upsert_by_key(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "name", "event_id")
    return out.withColumn("name", F.upper("name"))


REVIEW = SNAP + """, w AS (SELECT s.item_id, v.title, v.metadata, reasons, v.review_reason AS txt FROM s JOIN v_items v USING (item_id))"""


@query("summarise_reviews", f"""{REVIEW} SELECT item_id,
  CASE item_id % 6 WHEN 0 THEN trim(title) WHEN 1 THEN (metadata->>'$.display_title') || ' (1999)' WHEN 2 THEN 'Film (2001)'
    WHEN 3 THEN (metadata->>'$.show_title') || ' Season 02' WHEN 4 THEN 'Plain' ELSE 'Item ' || item_id END AS display_title,
  split_part(reasons, '|', 1) AS primary_reason,
  CASE WHEN item_id % 5 = 0 THEN split_part(reasons, '|', 1) || '; ' || split_part(reasons, '|', 2) || '; +1 more' ELSE reasons END AS summary,
  CASE WHEN txt = '' THEN 'none' WHEN txt = 'not json' THEN 'invalid' ELSE 'parsed' END AS status
FROM (SELECT item_id, title, CASE WHEN metadata = '' THEN NULL ELSE metadata END AS metadata, reasons, txt FROM w)""")
def reviews(t):
    return K.summarise_reviews(V.items(t))


@query("reason_counts", f"{SNAP} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '|')) AS reason FROM s WHERE reasons <> '') GROUP BY reason")
def reason_counts(t):
    return K.reason_counts(V.items(t))
