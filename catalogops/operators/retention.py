"""Retention and capacity: pruning by cumulative size, stale directories, space plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.operators.skew import sliced_window

SPACE_MARGIN = 1.1
PROTECTED_PREFIX = "queue-"


def prune_plan(entries: DataFrame, limit_bytes: int) -> DataFrame:
    """Oldest entries to remove until the rest fits: those before which the remaining total still exceeds the limit.

    `entries` (name, bytes, cached_at), cached_at a number.  The running sum over the whole table works per slice, with borders at
    quantiles of cached_at, so no task sees all entries; name breaks ties on time.
    """
    d = sliced_window(entries, [], ["cached_at", "name"], "cached_at", sums={"_upto": "bytes"}, group_sums={"_total": "bytes"})
    return d.filter(F.col("_total") - (F.col("_upto") - F.col("bytes")) > limit_bytes).select("name", "bytes", "cached_at")


def stale_entries(dirs: DataFrame, active: DataFrame, cutoff: Column) -> DataFrame:
    """A plan that deletes nothing: preserved (protected or recent) or removed (stale) with the reason."""
    a = active.select("name").distinct().withColumn("_active", F.lit(True))
    d = dirs.join(a, "name", "left")
    safe = F.col("name").startswith(PROTECTED_PREFIX) | F.coalesce("_active", F.lit(False))
    reason = F.when(safe, "protected").when(F.col("modified") > cutoff, "recent").otherwise("stale")
    return d.select(*dirs.columns, reason.alias("reason")).withColumn("result", F.when(F.col("reason") == "stale", "removed").otherwise("preserved"))


def capacity_plan(targets: DataFrame, capacity: DataFrame, margin: float = SPACE_MARGIN) -> DataFrame:
    """Per destination: known sizes times a margin against the free space; no known size skips the check."""
    known = F.when(F.col("bytes") > 0, F.col("bytes"))
    g = targets.groupBy("destination").agg(F.count(F.lit(1)).alias("titles"), F.count_if(known.isNull()).alias("unsized"), F.coalesce(F.sum(known), F.lit(0)).alias("estimated"))
    d = g.join(capacity.select("destination", "free"), "destination", "left").withColumn("required", F.floor(F.col("estimated") * margin))
    state = F.when((F.col("estimated") == 0) | F.col("free").isNull(), "skipped").when(F.col("free") < F.col("required"), "insufficient").otherwise("passed")
    return d.withColumn("status", state)
