"""JSON-lines pipeline logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogops.functions.times import log_duration_seconds, log_time

# Keys that become columns; all other keys stay in the string map.
COLUMNS = ("time", "level", "msg", "component", "stage", "lane", "request")


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """(value, more columns) to typed events; malformed lines are dropped, a bad time stays as NULL.

    An item id counts only when the line carries it as a number.  Nested values stay JSON text.
    """
    rest = [c for c in lines.columns if c != "value"]
    d = lines.withColumn("_m", F.from_json("value", "map<string,string>")).filter(F.trim("value").startswith("{") & F.col("_m").isNotNull())
    numeric = F.col("value").rlike(r'(?:^|[^\\])"item_id"\s*:\s*-?\d')
    item = F.when(numeric, F.col("_m")["item_id"].try_cast("double").cast("long"))
    m = F.col("_m")
    fields = F.map_filter(m, lambda k, v: ~k.isin(*COLUMNS, "item_id"))
    return d.select(*rest, log_time(m["time"]).alias("ts"), *[F.coalesce(m[c], F.lit("")).alias(c) for c in COLUMNS], item.alias("item_id"),
                    *[F.coalesce(m[c], F.lit("")).alias(c) for c in ("event_type", "decision_type", "decision_result", "decision_reason", "error_hint")],
                    log_duration_seconds(F.coalesce(m["stage_duration"], F.lit(""))).alias("duration"), fields.alias("fields"))


def read_log_events(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the files below `path` with `seq`, which follows file name and position.

    A line of a block lies before the next block's start even if lines were one byte long, so a file's rank, its block's start and
    the row's place in the task order all lines.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    meta = raw.select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file_name"),
                      F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(F.col("path").alias("_path"), (F.row_number().over(Window.orderBy(F.substring_index("path", "/", -1), "path")) - 1).alias("_file")))  # one row per file
    key = F.regexp_replace("_path", "^file:/+", "/")
    ranked = meta.withColumn("_path", key).join(files.withColumn("_path", key), "_path")
    seq = F.col("_file") * F.lit(1 << 44) + F.col("block") + F.col("row")
    return parse_log_lines(ranked.select("value", "file_name", "block", "row", seq.alias("seq")))


def unparsable_report(lines: DataFrame, events: DataFrame) -> DataFrame:
    """One row: lines read, events, events without a usable time."""
    a = lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit("lines").alias("what"), "n")
    b = events.agg(F.count(F.lit(1)).alias("n")).select(F.lit("events").alias("what"), "n")
    c = events.filter("ts is null").agg(F.count(F.lit(1)).alias("n")).select(F.lit("untimed").alias("what"), "n")
    return a.unionByName(b).unionByName(c)
