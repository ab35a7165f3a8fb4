import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from catalogops.operators import events as E
from catalogops.operators import tasks as K
from catalogops.sources import logs as LG

LINES = [
    '{"time":"2026-03-01T10:00:00.5Z","level":"INFO","msg":"start","item_id":7,"event_type":"stage_start","stage":"ripping","percent":12.5}',
    '{"time":"not a time","level":"WARN","msg":"odd","item_id":"7"}',
    '{"time":"2026-03-01T10:00:02+02:00","level":"ERROR","msg":"nested","detail":{"a":1},"stage_duration":"1m2.5s"}',
    '{"broken', "", "plain text", '{"level":"INFO","stage_duration":2500000000}',
]


def test_log_lines(spark):
    ev = LG.parse_log_lines(spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "seq long, value string"))
    got = {r.seq: r for r in ev.collect()}
    assert sorted(got) == [0, 1, 2, 6]
    assert got[0].item_id == 7 and got[1].item_id is None and got[1].ts is None
    assert got[2].ts == datetime(2026, 3, 1, 8, 0, 2) or str(got[2].ts).endswith("08:00:02")
    assert got[2].fields["detail"] == '{"a":1}' and got[2].duration == 62.5 and got[6].duration == 2.5
    assert got[0].fields == {"event_type": "stage_start", "percent": "12.5"}


def test_read_log_events(spark, tmp_path):
    (tmp_path / "pipeline-20260301T090000.000Z.log").write_text("\n".join(LINES))
    assert LG.read_log_events(spark, str(tmp_path)).count() == 4


def test_levels_and_clamps(spark, rows):
    t = datetime(2026, 1, 1)
    df = spark.createDataFrame([(1, 5, "debug", t), (2, 5, "weird", t), (3, 0, "Warn", None), (4, 6, "ERROR", t - timedelta(days=1))], "seq long, item_id long, level string, ts timestamp")
    assert rows(E.filter_events(df, level="info"), "seq") == [(3,), (4,)]
    assert len(rows(E.filter_events(df, level="nonsense"), "seq")) == 4
    assert rows(E.filter_events(df, min_time=t), "seq") == [(1,), (2,)]
    assert rows(E.filter_events(df, itemless=True), "seq") == [(3,)]
    items = spark.createDataFrame([(5, t + timedelta(minutes=1)), (0, t), (6, t)], "item_id long, created_at timestamp")
    assert rows(E.clamp_lifetime(df, items), "seq") == [(1,), (2,), (3,)]
    assert rows(E.lifetime_only(df, items), "seq") == []


def test_downsampling_keeps_first_and_last(spark):
    df = spark.createDataFrame([(i, 1, "encode_progress" if i % 2 else "note") for i in range(200)], "seq long, item_id long, event_type string")
    got = sorted(r.seq for r in E.downsample_progress(df).filter("event_type = 'encode_progress'").collect())
    ticks = [i for i in range(200) if i % 2]
    assert got == sorted(set(ticks[::5]) | {ticks[-1]})
    assert E.downsample_progress(df).filter("event_type = 'note'").count() == 100


def test_cursor_never_skips(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("seq"))
    seen, cursor = [], 1
    while len(seen) < 1000:
        page = E.tail_or_page(df, since=cursor, limit=300)
        seen += [r.seq for r in page.collect()]
        cursor = E.next_cursor(page, df).first().next
    assert seen == list(range(1, 1001)) and cursor == 1001


def test_throttle_equals_greedy_rule(spark):
    rnd = random.Random(4)
    data, at = [], 0
    for i in range(300):
        at += rnd.choice([0, 1, 2, 7])
        data.append(("hot" if i % 3 else "cold", i, at))
    got = {r.seq for r in E.throttle(spark.createDataFrame(data, "k string, seq long, at long"), ["k"], 5).collect()}
    want, last = set(), {}
    for k, s, a in data:
        if k not in last or a - last[k] >= 5:
            last[k] = a
            want.add(s)
    assert got == want


def test_log_files_for_lifetime(spark, rows):
    names = ["pipeline-20260101T000000.000Z.log", "pipeline-20260105T120000.000Z.log", "pipeline-20260210T000000.000Z.log"]
    files = spark.createDataFrame([(n,) for n in names], "file_name string")
    items = spark.createDataFrame([(1, datetime(2025, 1, 1)), (2, datetime(2026, 1, 5, 12)), (3, datetime(2026, 3, 1))], "item_id long, created_at timestamp")
    assert rows(E.log_files_for_lifetime(files, items), "item_id", "file_name") == [(1, n) for n in names] + [(2, n) for n in names[1:]] + [(3, names[2])]


ITEM = "item_id long, stage string, failed_at_stage string, user_stopped boolean, in_progress boolean, error_message string, needs_review boolean, review_reasons array<string>, created_at int"
TASK = "task_id long, item_id long, type string, state string, deps array<long>"


def test_ready_tasks(spark, rows):
    items = spark.createDataFrame([(1, "ripping", "", False, True, "", False, [], 2), (2, "failed", "", False, False, "", False, [], 1), (3, "encoding", "", True, False, "", False, [], 3)], ITEM)
    tasks = spark.createDataFrame([(1, 1, "identification", "done", []), (2, 1, "ripping", "done", [1]), (3, 1, "encoding", "pending", [1]), (4, 1, "apply", "pending", [2, 3]),
                                   (5, 1, "analysis", "pending", [99]), (6, 2, "ripping", "pending", []), (7, 3, "ripping", "pending", [])], TASK)
    assert rows(K.ready_tasks(items, tasks), "task_id") == [(3,)]


def test_reach_follows_edges(spark, rows):
    tasks = spark.createDataFrame([(1, 1, "identification", "pending", []), (2, 1, "ripping", "pending", [1]), (3, 1, "encoding", "running", [1]), (4, 1, "apply", "pending", [2, 3])], TASK)
    assert rows(K.reached_tasks(tasks), "task_id") == [(1,), (3,)]


def test_retry_and_stop(spark):
    items = spark.createDataFrame([(1, "failed", "encoding", True, False, "x", True, ["a"], 1), (2, "failed", "nowhere", False, False, "y", False, [], 1), (3, "ripping", "", False, True, "", False, [], 1)], ITEM)
    tasks = spark.createDataFrame([(1, 1, "encoding", "failed", []), (3, 3, "ripping", "running", [])], TASK)
    after, left = K.retry_failed(items, tasks)
    got = {r.item_id: r for r in after.collect()}
    assert (got[1].stage, got[1].user_stopped, got[1].review_reasons) == ("encoding", False, []) and got[2].stage == "identification" and got[3].stage == "ripping"
    assert [r.task_id for r in left.collect()] == [3]
    stopped = {r.item_id: r for r in K.stop_items(items, items.select("item_id")).collect()}
    assert (stopped[3].stage, stopped[3].failed_at_stage, stopped[3].review_reasons) == ("failed", "ripping", [K.STOP_REASON])
    assert stopped[1].failed_at_stage == "encoding" and stopped[1].review_reasons == ["a", K.STOP_REASON]


def test_expected_work(spark):
    items = spark.createDataFrame([(1, "encoding", "", False, False, "", False, [], 1), (2, "completed", "", False, False, "", False, [], 1)], ITEM)
    got = K.expected_work(items, spark.createDataFrame([], TASK)).collect()
    one = {r.type: r for r in got if r.item_id == 1}
    assert [t for t in K.STAGES if one[t].state == "done"] == ["identification", "ripping", "episode_identification"]
    assert sorted(one["apply"].deps) == sorted([one["subtitling"].task_id, one["encoding"].task_id])
    assert {r.state for r in got if r.item_id == 2} == {"done"}


def test_durations_missing_or_inverted(spark):
    df = spark.createDataFrame([(1, "2026-01-01 00:00:00", "2026-01-01 00:01:30"), (2, "2026-01-01 00:01:00", "2026-01-01 00:00:00"), (3, None, "2026-01-01 00:00:00")], "id long, a string, b string")
    got = [r.s for r in df.orderBy("id").select(K.duration_seconds("a", "b").alias("s")).collect()]
    assert got == [90.0, None, None]


def test_stage_gate_reads_tasks_once(spark, rows):
    """Reach over several levels, across items and round a cycle, from one pass over the tasks; a repeated and a stateless task count like any other."""
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    names = list(K.STAGES)
    given = [(1, 10 + i, names[i], "running" if i == 3 else "pending", [10 + i - 1] if i else []) for i in range(5)]
    given += [(2, 20, "encoding", "pending", [21]), (2, 21, "ripping", "pending", [20, 99]), (3, 30, "apply", "done", [20]), (3, 31, "subtitling", None, []),
              (4, 40, "analysis", "pending", [41]), (4, 41, "ripping", "pending", []), (5, 12, "subtitling", "pending", [13])]
    schema = "item_id long, task_id long, type string, state string, deps array<long>"
    tasks = spark.createDataFrame(given, schema)
    items = spark.createDataFrame([(i, "identification", "", "tv", "bluray") for i in range(1, 7)], "item_id long, stage string, failed_at_stage string, media_type string, disc_source string")
    got = K.stage_gate(items, tasks.mapInArrow(count, schema)).select("item_id", "furthest", "phase_rip_cache", "phase_episode_id", "phase_encoded", "phase_subtitles", "phase_commentary")
    assert rows(got) == [(1, "encoding", True, True, True, False, False), (2, "identification", True, False, True, False, False), (3, "apply", False, False, False, False, False),
                         (4, "identification", False, False, False, False, False), (5, "identification", False, False, False, True, False), (6, "identification", False, False, False, False, False)]
    assert passed.value == len(given)
    assert rows(K.reached_tasks(tasks)) == [(10,), (11,), (12,), (13,), (20,), (21,), (30,), (99,)]
