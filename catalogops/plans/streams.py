"""Streaming queries over the `events` file, each run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.plans import events as E
from catalogops.plans import sources as S
from catalogops.plans import views as V
from catalogops.plans.registry import ORACLES, Tables, query
from catalogops.plans.views import stamp
from catalogops.session import work_folder
from catalogops.streaming import pipeline as P


class StreamTables(Tables):
    """The same tables with `events` as a stream of files."""

    @property
    def events(self):
        schema = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(self.sf_dir)


def live(t) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir)


def stamped(df):
    """Event time as an instant, which watermarks need."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_follow_events", "SELECT event_id AS seq FROM events WHERE event_id % 7 <> 0 AND event_type IN ('error', 'signup')")
def follow(t):
    """Log files written once, then followed at level warn."""
    folder = work_folder(t.spark, "follow")
    lines = S.log_lines(t)
    lines.select(F.concat(F.regexp_replace("value", r"\}$", ""), F.when(F.col("value").endswith("}"), F.concat(F.lit(',"seq":'), F.col("seq").cast("string"), F.lit("}"))).otherwise("")).alias("value")).write.text(f"{folder}/logs")
    ev = P.follow_events(t.spark, f"{folder}/logs", level="warn").select(F.col("fields")["seq"].cast("long").alias("seq"))
    return P.run_available(ev, folder)


@query("stream_dedup_arrivals", """WITH i AS (SELECT c_custkey AS item_id, CASE c_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' ELSE 'ripping' END AS stage, c_custkey % 8 = 0 AS stopped FROM customer WHERE c_custkey % 3 <> 0)
SELECT u AS fingerprint, CASE WHEN item_id IS NULL THEN 'created' ELSE 'skipped' END AS result, CASE WHEN item_id IS NULL THEN 'new fingerprint' WHEN stage = 'failed' AND stopped THEN 'item was intentionally stopped by user'
  WHEN stage IN ('failed', 'completed') THEN 'already in terminal stage' ELSE 'identical fingerprint already in workflow' END AS reason FROM (SELECT DISTINCT user_id AS u FROM events) LEFT JOIN i ON item_id = u""")
def dedup(t):
    k = F.col("c_custkey")
    items = t.customer.filter("c_custkey % 3 <> 0").select(k.alias("fingerprint"), k.alias("item_id"), F.when(k % 4 == 0, "failed").when(k % 4 == 1, "completed").otherwise("ripping").alias("stage"), (k % 8 == 0).alias("user_stopped"))
    a = stamped(live(t).events).select("ts", F.col("user_id").alias("fingerprint"))
    return P.run_available(P.dedup_arrivals(a, items, "400 days"), work_folder(t.spark, "dedup")).select("fingerprint", "result", "reason")


@query("stream_throttle", ORACLES["throttle"])
def throttle(t):
    e = stamped(live(t).events).select("user_id", F.col("event_id").alias("seq"), "ts")
    return P.run_available(P.throttle_stream(e, "user_id", 3 * 3600 * 1_000_000), work_folder(t.spark, "throttle")).select("user_id", "seq")


@query("stream_blocked_waits", ORACLES["blocked_waits"])
def waits(t):
    w = (stamped(live(t).events).filter(F.col("event_type").isin("view", "purchase"))
         .select("user_id", F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "view", "blocked").otherwise("granted").alias("kind")))
    return P.run_available(P.blocked_waits_stream(w, "user_id"), work_folder(t.spark, "waits"))


@query("stream_stage_timings", ORACLES["stage_timings"])
def timings(t):
    out = P.run_available(P.streaming_stage_timings(stamped(V.stage_log(live(t)))), work_folder(t.spark, "timings"), "update")
    last = out.groupBy("item_id", "stage").agg(F.max_by(F.struct("starts", "completions", "started_at", "completed_at", "duration"), "batch_id").alias("r")).select("item_id", "stage", "r.*")
    return last.select("item_id", "stage", "starts", "completions", stamp("started_at"), stamp("completed_at"), F.round("duration", 6).alias("duration"))


@query("stream_lifetime_clamp", ORACLES["lifetime_only"])
def clamp(t):
    c = E.created(t).withColumn("created_at", F.col("created_at").cast("timestamp"))
    ev = stamped(V.log(live(t))).select("seq", "item_id", "ts")
    return P.run_available(P.clamp_stream(ev, c), work_folder(t.spark, "clamp")).select("seq", "item_id")


@query("stream_bounded_latest", "SELECT event_id AS seq, user_id AS item_id FROM events ORDER BY event_id DESC LIMIT 10000")
def latest(t):
    folder = work_folder(t.spark, "latest")
    ev = V.log(live(t)).select("seq", "item_id")
    q = ev.writeStream.foreachBatch(P.keep_latest(f"{folder}/snapshots")).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(f"{folder}/snapshots/v{q.lastProgress['batchId']}")
