"""Aspect labels of encode snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Standard aspect ratios and the matching tolerance.
RATIOS = ((1.333, "1.33:1"), (1.778, "1.78:1"), (1.850, "1.85:1"), (2.000, "2.00:1"), (2.200, "2.20:1"), (2.350, "2.35:1"), (2.390, "2.39:1"), (2.400, "2.40:1"))
TOLERANCE = 0.02


def crop_size(text: Column) -> tuple[Column, Column]:
    """Width and height of `[crop=]W:H:X:Y`; NULL when malformed or not positive."""
    p = r"^\s*(?:crop=)?(\d+):(\d+):\d+:\d+"
    w, h = [F.nullif(F.regexp_extract(text, p, i), F.lit("")).try_cast("int") for i in (1, 2)]
    ok = (w > 0) & (h > 0)
    return F.when(ok, w), F.when(ok, h)


def aspect_label(ratio: Column) -> Column:
    """Nearest standard within two percent, else the ratio itself; the first of equals wins."""
    devs = F.array(*[F.struct((F.abs(ratio - r) / r).alias("d"), F.lit(i).alias("i"), F.lit(label).alias("label")) for i, (r, label) in enumerate(RATIOS)])
    best = F.array_min(F.filter(devs, lambda x: x["d"] <= TOLERANCE))
    return F.coalesce(best["label"], F.format_string("%.2f:1", ratio))


def aspect_report(snapshots: DataFrame, column: str = "crop_filter") -> DataFrame:
    w, h = crop_size(F.col(column))
    ratio = F.round(w / h, 2)
    return snapshots.select("*", w.alias("width"), h.alias("height"), F.when(ratio.isNotNull(), aspect_label(ratio)).alias("aspect"),
                            F.when(w.isNull(), "malformed").otherwise("ok").alias("status"))
