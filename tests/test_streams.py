"""Streams fed in several batches and restarted in between give what one batch gives."""

from pyspark.sql import functions as F

from catalogops.functions.titles import catalogue_title
from catalogops.streaming.pipeline import blocked_waits_stream, throttle_stream

FILES = [[(40, "blocked"), (0, "blocked"), (15, "granted"), (31, "blocked")], [(61, "granted"), (55, "blocked"), (70, "granted")], [(200, "granted"), (90, "blocked"), (95, "granted"), (110, "blocked")]]


def batches(spark, folder, build, restart):
    """The stream over FILES, one file a batch, stopped and started again before the last file."""
    def write(k):
        df = spark.createDataFrame([(key, 100 * k + sorted(FILES[k]).index(r), *r) for r in FILES[k] for key in (1, 2)], "k int, seq long, t int, kind string")
        df.select("k", "seq", F.timestamp_seconds(F.col("t") + 1_000_000).alias("ts"), "kind").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        stream = spark.readStream.schema("k int, seq long, ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        build(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()

    for k in range(len(FILES)):
        write(k)
        if restart or k == len(FILES) - 1:
            run()
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect())


def test_throttle_in_batches(spark, tmp_path):
    rows = sorted((t, 100 * k + sorted(f).index((t, kind))) for k, f in enumerate(FILES) for t, kind in f)
    want, last = [], None
    for t, seq in rows:
        if last is None or t - last >= 15:
            want.append(seq)
            last = t
    for restart in (True, False):
        got = batches(spark, str(tmp_path / str(restart)), lambda s: throttle_stream(s.select("k", "seq", "ts"), "k", 15_000_000), restart)
        assert [(k, seq) for k, seq, _ in got] == [(k, seq) for k in (1, 2) for seq in sorted(want)]


def test_waits_in_batches(spark, tmp_path):
    rows = sorted((100 * k + sorted(f).index(r), *r) for k, f in enumerate(FILES) for r in f)
    want, since = [], None
    for seq, t, kind in rows:
        if kind == "blocked":
            since = since or (seq, t)
        elif since:
            want.append((seq, since[0], (t - since[1]) * 1_000_000))
            since = None
    got = batches(spark, str(tmp_path), lambda s: blocked_waits_stream(s, "k"), True)
    assert got == sorted((k, *w) for k in (1, 2) for w in want)


def test_titles_in_nested_parentheses(spark):
    raw = ["Film (Film)", "A (b (c)) (A (b (c)))", "X ((y) z (q(r))) (X ((y) z (q(r))))", "VOLUME_1(The Name)", "No (Pair", "()", "a)", ""]
    got = [r.t for r in spark.createDataFrame([(x,) for x in raw], "raw string").select(catalogue_title(F.col("raw")).alias("t")).collect()]
    assert got == ["Film", "A (b (c))", "X ((y) z (q(r)))", "The Name", "No (Pair", "()", "a)", ""]
