"""Rows with null keys stay, loops end, and streams do not depend on the size of Arrow chunks."""

from pyspark.sql import functions as F

from catalogops.operators import linkage
from catalogops.operators.skew import int_slice, sliced_window
from catalogops.streaming.pipeline import throttle_stream


def test_windows_keep_null_keys(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 1_500_000), (7, 1), (7, None)], "k int, o int")
    got = rows(sliced_window(df, ["k"], ["o"], int_slice("o"), number="n", total="t"), "k", "o", "n", "t")
    assert got == sorted([(None, 1, 1, 3), (None, 2, 2, 3), (None, 1_500_000, 3, 3), (7, None, 1, 2), (7, 1, 2, 2)], key=repr)


def test_assignment_ends_on_null_rows(spark):
    c = spark.createDataFrame([(None, 1, 1, 0.9), (1, 1, 1, 0.5), (1, None, 2, 0.7), (1, 2, None, 0.7)], "grp int, key int, number int, strength double")
    got = linkage.assign_greedy(c, lambda: F.struct(-F.col("strength"), F.col("number"), F.col("key"))).collect()
    assert [(r.grp, r.key, r.number) for r in got] == [(1, 1, 1)]


def test_throttle_does_not_depend_on_chunks(spark, tmp_path):
    times = [70, 0, 15, 40, 5, 31, 16, 90]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "k int, seq long, t int")
    df.select("k", "seq", F.timestamp_seconds(F.col("t") + 1_000_000).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    for n in ("2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            stream = spark.readStream.schema("k int, seq long, ts timestamp").parquet(str(tmp_path / "in"))
            q = (throttle_stream(stream, "k", 15_000_000).writeStream.format("parquet").option("path", str(tmp_path / f"out{n}"))
                 .option("checkpointLocation", str(tmp_path / f"cp{n}")).trigger(availableNow=True).start())
            q.awaitTermination()
            seen.append(sorted(r.seq for r in spark.read.parquet(str(tmp_path / f"out{n}")).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen[0] == seen[1] == [0, 1, 2, 5, 7]
