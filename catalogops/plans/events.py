"""Queries of the log-event operators over the `events` table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalogops.operators import events as E
from catalogops.plans.registry import query
from catalogops.plans.views import SQL, log, stage_log, stamp, stamp_sql, with_views

LOG = with_views("v_log")


@query("filter_events_level", f"""{LOG} SELECT seq, item_id, level, event_type FROM v_log
WHERE level IN ('WARN', 'ERROR') AND ts >= TIMESTAMP '2024-01-05 00:00:00'""")
def filter_level(t):
    return E.filter_events(log(t), level="warning", min_time=datetime(2024, 1, 5)).select("seq", "item_id", "level", "event_type")


@query("filter_events_item", f"{LOG} SELECT seq, item_id, level FROM v_log WHERE item_id = 8")
def filter_item(t):
    return E.filter_events(log(t), item_id=8, level="no such level").select("seq", "item_id", "level")


ATTR_SQL = """WITH ev AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN user_id END AS item_id,
  CASE WHEN event_id % 3 = 1 THEN ' fp' || user_id END AS fingerprint,
  CASE WHEN event_id % 3 = 2 THEN 'TITLE ' || (user_id // 2) END AS disc_title FROM events),
it AS (SELECT c_custkey AS item_id, 'FP' || c_custkey AS fingerprint, 'Title ' || (c_custkey // 3) AS title FROM customer)
SELECT seq, it.item_id FROM ev JOIN it ON ev.item_id = it.item_id
UNION ALL SELECT DISTINCT seq, it.item_id FROM ev JOIN it ON ev.item_id IS NULL
  AND (lower(trim(ev.fingerprint)) = lower(it.fingerprint) OR lower(ev.disc_title) = lower(it.title))"""


@query("attribute_events", ATTR_SQL)
def attribute(t):
    ev = t.events.selectExpr(
        "event_id AS seq", "CASE WHEN event_id % 3 = 0 THEN user_id END AS item_id",
        "map('fingerprint', CASE WHEN event_id % 3 = 1 THEN ' fp' || user_id END, 'disc_title', CASE WHEN event_id % 3 = 2 THEN 'TITLE ' || (user_id div 2) END) AS fields")
    it = t.customer.selectExpr("c_custkey AS item_id", "'FP' || c_custkey AS fingerprint", "'Title ' || (c_custkey div 3) AS title")
    return E.attribute_events(ev, it)


CREATED = "created AS (SELECT item_id, min(ts) + INTERVAL 3 DAY AS created_at FROM v_log GROUP BY item_id)"


def created(t):
    """Each user's creation: three days after the first event, so that some events are stale."""
    return log(t).groupBy("item_id").agg((F.min("ts") + F.expr("INTERVAL 3 DAYS")).alias("created_at"))


@query("clamp_lifetime", f"""{LOG}, {CREATED} SELECT seq, item_id FROM v_log JOIN created USING (item_id)
WHERE NOT coalesce(ts < created_at - INTERVAL 2 MINUTE, false)""")
def clamp(t):
    return E.clamp_lifetime(log(t), created(t)).select("seq", "item_id")


@query("lifetime_only", f"{LOG}, {CREATED} SELECT seq, item_id FROM v_log JOIN created USING (item_id) WHERE ts >= created_at")
def lifetime_only(t):
    return E.lifetime_only(log(t), created(t)).select("seq", "item_id")


@query("split_event_kinds", f"""{with_views('v_stage_log')}, l AS (SELECT s.*, CASE e.event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS level,
  CASE WHEN s.seq % 5 = 0 THEN s.event_type ELSE '' END AS decision_type FROM v_stage_log s JOIN events e ON e.event_id = s.seq)
SELECT seq, decision_type <> '' AS is_decision, level = 'WARN' AS is_warning, level = 'ERROR' AS is_error,
  starts_with(event_type, 'stage_') AS is_stage,
  level = 'INFO' AND decision_type = '' AND NOT starts_with(event_type, 'stage_') AS is_event FROM l""")
def kinds(t):
    level = (F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN")
             .when(F.col("event_type") == "click", "DEBUG").otherwise("INFO"))
    s = stage_log(t).withColumn("level", level).withColumn("decision_type", F.when(F.col("seq") % 5 == 0, F.col("event_type")).otherwise(""))
    return E.split_kinds(s).select("seq", "is_decision", "is_warning", "is_error", "is_stage", "is_event")


@query("notable_decisions", f"""{LOG} SELECT seq, CASE event_type WHEN 'purchase' THEN 'title_selection' WHEN 'view' THEN 'episode_match' END AS decision_type
FROM v_log WHERE event_type IN ('purchase', 'view')""")
def notable(t):
    kind = (F.when(F.col("event_type") == "purchase", "title_selection").when(F.col("event_type") == "view", "episode_match")
            .otherwise(F.col("event_type")))
    return E.notable_decisions(log(t).withColumn("decision_type", kind)).select("seq", "decision_type")


@query("event_extras", f"{LOG} SELECT seq, 'k=' || (props->>'$.k') AS extras FROM v_log")
def extras(t):
    f = F.map_concat("fields", F.create_map(F.lit("level"), F.col("level"), F.lit("msg"), F.col("msg")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(E.event_extras(f))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return log(t).select("seq", text.alias("extras"))


@query("first_hint", f"""{LOG} SELECT item_id, min_by(h, seq) AS hint FROM (
  SELECT item_id, seq, CASE WHEN event_type = 'purchase' THEN 'dvd' WHEN event_type = 'signup' THEN 'bluray' END AS h FROM v_log) WHERE h IS NOT NULL GROUP BY item_id
UNION ALL SELECT item_id, NULL FROM v_log GROUP BY item_id HAVING count(*) FILTER (event_type IN ('purchase', 'signup')) = 0""")
def first_hint(t):
    e = log(t).withColumn("fields", F.create_map(F.lit("disc_type"), F.when(F.col("event_type") == "purchase", " DVD ").when(F.col("event_type") == "signup", "BD")))
    return E.first_hint(e, E.source_hint(), "hint")


@query("decision_groups", f"""{LOG} SELECT item_id, decision_type, decision_result, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq,
  count(DISTINCT props) > 1 AS varies FROM v_log GROUP BY ALL""")
def decision_groups(t):
    return E.decision_groups(log(t)).drop("decision_reason")


@query("decision_entries", f"""{LOG} SELECT seq, min(seq) OVER (PARTITION BY item_id, decision_type, decision_result) AS first_seq FROM v_log""")
def decision_entries(t):
    return E.decision_entries(log(t)).select("seq", "first_seq")


@query("stage_timings", f"""{with_views('v_stage_log')} SELECT item_id, stage, count(*) FILTER (event_type = 'stage_start') AS starts,
  count(*) FILTER (event_type = 'stage_complete') AS completions,
  {stamp_sql("min_by(ts, seq) FILTER (event_type = 'stage_start')", 'started_at')},
  {stamp_sql("max_by(ts, seq) FILTER (event_type = 'stage_complete')", 'completed_at')},
  round(coalesce(max_by(duration, seq) FILTER (event_type = 'stage_complete' AND duration > 0), 0), 6) AS duration FROM v_stage_log GROUP BY ALL""")
def stage_timings(t):
    return E.stage_timings(stage_log(t)).select("item_id", "stage", "starts", "completions", stamp("started_at"), stamp("completed_at"),
                                                F.round("duration", 6).alias("duration"))


@query("value_histogram", """SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY user_id), 6) AS percent
FROM (SELECT user_id, event_type AS value, count(*) AS n FROM events GROUP BY ALL)""")
def value_histogram(t):
    return E.histogram(t.events, ["user_id"], "event_type").withColumn("percent", F.round("percent", 6))


@query("value_histogram_vote", """WITH c AS (SELECT user_id, event_type AS value, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, value) AS rn, sum(n) OVER (PARTITION BY user_id)::BIGINT AS total,
  count(*) OVER (PARTITION BY user_id) > 1 AS several FROM c)
SELECT user_id, value AS winner, n AS winner_n, total, several, value <> 'view' AS differs FROM r WHERE rn = 1""")
def value_vote(t):
    return E.histogram_vote(t.events.withColumn("source", F.lit("view")), ["user_id"], "event_type", "source")


@query("count_string", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL)
SELECT u.user_id, coalesce(string_agg(event_type || '=' || n, ',' ORDER BY event_type), 'none') AS counts
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c USING (user_id) GROUP BY u.user_id""")
def count_string(t):
    e = t.events.withColumn("event_type", F.when(F.col("event_type") != "view", F.col("event_type")))
    return E.count_string(e, ["user_id"], "event_type")


PROGRESS = """WITH p AS (SELECT event_id AS seq, user_id % 8 AS item_id, CASE WHEN event_type IN ('view', 'click') THEN event_type || '_progress' ELSE event_type END AS event_type FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, event_type ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY item_id, event_type) AS n FROM p),
kept AS (SELECT seq, item_id, event_type FROM r WHERE NOT ends_with(event_type, '_progress') OR n <= 20 OR i % ((n + 19) // 20) = 0 OR i = n - 1)"""


def _progress(t):
    kind = F.when(F.col("event_type").isin("view", "click"), F.concat("event_type", F.lit("_progress"))).otherwise(F.col("event_type"))
    return t.events.select(F.col("event_id").alias("seq"), (F.col("user_id") % 8).alias("item_id"), kind.alias("event_type"))


@query("downsample_progress", f"{PROGRESS} SELECT * FROM kept")
def downsample(t):
    return E.downsample_progress(_progress(t))


@query("downsample_omitted", f"""{PROGRESS} SELECT p.item_id, count(*) - any_value(k.n) AS omitted FROM p JOIN (SELECT item_id, count(*) AS n FROM kept GROUP BY ALL) k USING (item_id) GROUP BY p.item_id""")
def downsample_omitted(t):
    p = _progress(t)
    return E.omitted_counts(p, E.downsample_progress(p))


@query("tail_events", f"{LOG} SELECT seq, item_id, event_type FROM v_log ORDER BY seq DESC LIMIT 200")
def tail(t):
    return E.tail_or_page(log(t)).select("seq", "item_id", "event_type")


@query("page_events", f"{LOG} SELECT seq, item_id FROM v_log WHERE level = 'ERROR' AND seq >= 500 ORDER BY seq LIMIT 50")
def page(t):
    return E.tail_or_page(E.filter_events(log(t), level="error"), since=500, limit=50).select("seq", "item_id")


@query("next_cursor", f"{LOG} SELECT max(seq) + 1 AS next FROM (SELECT seq FROM v_log WHERE level = 'ERROR' AND seq >= 500 ORDER BY seq LIMIT 50)")
def next_cursor(t):
    e = log(t)
    return E.next_cursor(E.tail_or_page(E.filter_events(e, level="error"), since=500, limit=50), e)


@query("blocked_waits", """WITH w AS (SELECT user_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'blocked' ELSE 'granted' END AS kind
  FROM events WHERE event_type IN ('view', 'purchase')),
p AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY seq) AS prev FROM w),
o AS (SELECT *, max(CASE WHEN kind = 'blocked' AND prev IS DISTINCT FROM 'blocked' THEN seq END) OVER (PARTITION BY user_id ORDER BY seq) AS blocked_seq FROM p)
SELECT o.user_id, o.seq, o.blocked_seq, epoch_us(o.ts) - epoch_us(b.ts) AS waited_micros FROM o JOIN w b ON b.seq = o.blocked_seq
WHERE o.kind = 'granted' AND o.prev = 'blocked'""")
def blocked_waits(t):
    w = (t.events.filter(F.col("event_type").isin("view", "purchase"))
         .select("user_id", F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "view", "blocked").otherwise("granted").alias("kind")))
    return E.blocked_waits(w, ["user_id"])


@query("throttle", """WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, epoch_us(ts) AS us FROM events),
n AS (SELECT a.user_id, a.seq, (SELECT min_by(b.seq, row(b.us, b.seq)) FROM e b WHERE b.user_id = a.user_id AND b.us >= a.us + 10800000000) AS nx FROM e a),
r AS (SELECT user_id, min_by(seq, row(us, seq)) AS seq FROM e GROUP BY user_id UNION ALL SELECT n.user_id, n.nx FROM r JOIN n ON n.user_id = r.user_id AND n.seq = r.seq WHERE n.nx IS NOT NULL)
SELECT user_id, seq FROM r""")
def throttle(t):
    """At most one row per user within three hours."""
    e = t.events.select("user_id", F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return E.throttle(e, ["user_id"], 3 * 3600 * 1_000_000).select("user_id", "seq")


@query("log_files_for_lifetime", """WITH files AS (SELECT DISTINCT 'pipeline-' || strftime(date_trunc('day', ts), '%Y%m%d') || 'T060000.000Z.log' AS file_name,
  date_trunc('day', ts) + INTERVAL 6 HOUR AS ts FROM events),
items AS (SELECT user_id AS item_id, date_trunc('second', min(ts)) AS created_at FROM events GROUP BY user_id),
s AS (SELECT item_id, coalesce((SELECT max(ts) FROM files f WHERE f.ts <= i.created_at), (SELECT min(ts) FROM files)) AS start FROM items i)
SELECT item_id, file_name FROM s JOIN files ON ts >= start""")
def log_files(t):
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    files = t.events.select(F.concat(F.lit("pipeline-"), F.date_format(day, "yyyyMMdd"), F.lit("T060000.000Z.log")).alias("file_name")).distinct()
    items = t.events.groupBy(F.col("user_id").alias("item_id")).agg(F.min("ts").alias("created_at"))
    return E.log_files_for_lifetime(files, items)
