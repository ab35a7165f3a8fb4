"""Structured Streaming forms of the log and task operators; each has a batch twin in `operators`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from catalogops.operators.events import filter_events, lifetime_only, stage_timings
from catalogops.operators.tasks import TERMINAL
from catalogops.sources.logs import parse_log_lines

SNAPSHOT_ROWS = 10_000


def follow_events(spark: SparkSession, path: str, **filters) -> DataFrame:
    """New log lines below `path` as filtered events; checkpointed offsets take the place of the sequence cursor."""
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").load(path)
    return filter_events(parse_log_lines(lines), **filters)


def arrival_decision(known: DataFrame) -> DataFrame:
    """Outcome of an arrival joined with the known item of its fingerprint (item_id NULL when new)."""
    result = F.when(F.col("item_id").isNull(), "created").otherwise("skipped")
    reason = (F.when(F.col("item_id").isNull(), "new fingerprint")
              .when((F.col("stage") == "failed") & F.col("user_stopped"), "item was intentionally stopped by user")
              .when(F.col("stage").isin(*TERMINAL), "already in terminal stage").otherwise("identical fingerprint already in workflow"))
    return known.withColumns({"result": result, "reason": reason})


def dedup_arrivals(arrivals: DataFrame, items: DataFrame, late: str = "10 minutes") -> DataFrame:
    """First arrival of each fingerprint within the watermark, decided against the static item table.

    `arrivals` (ts, fingerprint, ...), `items` (fingerprint, item_id, stage, user_stopped).
    """
    fresh = arrivals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])
    return arrival_decision(fresh.join(items.select("fingerprint", "item_id", "stage", "user_stopped"), "fingerprint", "left"))


def _expire(state: GroupState, at_micros: int, idle_ms: int) -> None:
    state.setTimeoutTimestamp(max(at_micros // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))


def _in_order(chunks: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch, without the key and time columns, sorted across chunks."""
    parts = [c[[n for n in ("seq", "at", "blocked") if n in c.columns]] for c in chunks]
    return pd.concat(parts).sort_values(order, kind="stable") if parts else pd.DataFrame(columns=["seq", "at", "blocked"])


def throttle_stream(events: DataFrame, key: str, gap_micros: int, late: str = "1 day") -> DataFrame:
    """At most one row per key and gap; `events` (key, seq, ts).  State is the time of the last emitted row.

    A key's rows of one micro-batch are put in the order of (at, seq) whatever the size of the Arrow chunks, as two numbers per row;
    the source's trigger limits bound a micro-batch.  State goes once the watermark has passed the gap.
    """
    def step(keys: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        keep = []
        for row in _in_order(chunks, ["at", "seq"]).itertuples(index=False):
            if last is None or row.at - last >= gap_micros:
                last = row.at
                keep.append((keys[0], row.seq, row.at))
        if keep:
            yield pd.DataFrame(keep, columns=[key, "seq", "at"])
        if last is not None:
            state.update((int(last),))
            _expire(state, int(last), gap_micros // 1000)

    kind = dict(events.dtypes)[key]
    timed = events.withWatermark("ts", late).select(key, "seq", "ts", F.unix_micros("ts").alias("at"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq bigint, at bigint", "last bigint", "append",
                                                     GroupStateTimeout.EventTimeTimeout)


def blocked_waits_stream(events: DataFrame, key: str, late: str = "1 day", idle_days: int = 30) -> DataFrame:
    """First "blocked" of a task paired with its next "granted"; `events` (key, seq, ts, kind).

    State is the open block; it goes when granted, or `idle_days` after the block when the task never returns.
    """
    def step(keys: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since = tuple(state.get) if state.exists else None
        out = []
        for row in _in_order(chunks, ["seq"]).itertuples(index=False):
            if row.blocked:
                since = since or (int(row.seq), int(row.at))
            elif since is not None:
                out.append((keys[0], row.seq, since[0], row.at - since[1]))
                since = None
        if out:
            yield pd.DataFrame(out, columns=[key, "seq", "blocked_seq", "waited_micros"])
        if since is not None:
            state.update(since)
            _expire(state, since[1], idle_days * 86_400_000)
        elif state.exists:
            state.remove()

    kind = dict(events.dtypes)[key]
    timed = events.withWatermark("ts", late).select(key, "seq", "ts", F.unix_micros("ts").alias("at"), (F.col("kind") == "blocked").alias("blocked"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq bigint, blocked_seq bigint, waited_micros bigint", "seq bigint, at bigint", "append",
                                                     GroupStateTimeout.EventTimeTimeout)


def streaming_stage_timings(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Stage timings kept up to date; write with output mode `update`."""
    return stage_timings(events.withWatermark("ts", late))


def clamp_stream(events: DataFrame, items: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Rows before their item's creation and rows without a time are dropped."""
    return lifetime_only(events.withWatermark("ts", late), items)


def keep_latest(path: str, limit: int = SNAPSHOT_ROWS):
    """A foreachBatch function that keeps the newest `limit` events in versioned snapshots below `path`.

    Every batch writes its own version from the one before, so a repeated batch gives the same table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merged = batch
        if batch_id > 0:
            merged = spark.read.parquet(f"{path}/v{batch_id - 1}").unionByName(batch)
        merged.orderBy(F.desc("seq")).limit(limit).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return write


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into Parquet below `folder` and returns the written table."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    else:
        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/b{batch_id}")

        q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    reader = stream.sparkSession.read.schema(stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())]))
    return reader.parquet(f"{folder}/out" if mode == "append" else f"{folder}/out/*")
