"""Row-sequence operators that never put a whole group into one task.

A plain window pulls all rows of a key into one task, which fails when one key holds a third of the table.
Here every key is cut into *slices* by a value that grows with the order column.  Windows run per (key, slice);
one small row per slice carries counts, sums and edge values to the later slices of the same key.  Without a key these rows are
carried in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"

#: Characters of text that one task takes apart into words or lines: some 200 MB of memory.
TASK_CHARS = 4_000_000

#: Rows that one task sorts: some 20 MB for each sort.
TASK_ROWS = 100_000


def dealt_by_text(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """`df` dealt out by `keys` into so many partitions that each holds about TASK_CHARS characters of `text`, however large the table is.

    What a task makes of its rows is many times larger than the rows, so a number of partitions that Spark derives from the bytes it
    shuffles lets the memory of a task grow.
    """
    return df.repartition(parts_by_text(df, text), *keys)


def parts_by_text(df: DataFrame, text: str) -> int:
    """The number of partitions of about TASK_CHARS characters of `text`."""
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    return max(1, math.ceil(chars / TASK_CHARS))


def parts_by_rows(table: DataFrame, rows: int | None = None) -> int:
    """The number of partitions of about `rows` or TASK_ROWS rows of a stored table."""
    return max(1, math.ceil(table.count() / (rows or TASK_ROWS)))


def int_slice(column: str | Column, width: int = 1_000_000) -> Column:
    """Slice of a dense integer order column: at most `width` distinct positions per slice."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c / F.lit(width))


def quantile_slices(df: DataFrame, column: str, side: int | None = None) -> DataFrame:
    """`df` with SLICE from a numeric order column: borders are quantiles of all rows, so a slice has about 1 / side^2 of the rows whatever the
    values are.

    The borders come from one mergeable summary (`percentile_approx`) inside the same plan, as a scalar subquery, so a shuffle below `df` is
    shared.  A row finds its slice in two steps of at most `side` comparisons.  Rows of one value share a slice; null stays null.  Without
    `side`, there are at least as many slices as shuffle partitions, from 256 to 4096.
    """
    side = side or min(64, max(16, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1))
    parts = side * side
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    every = F.array_sort(F.array_distinct(F.percentile_approx(column, at, 4 * parts)))
    coarse = F.filter("every", lambda b, i: (i > 0) & (i % side == 0))
    borders = df.agg(every.alias("every")).select(F.struct("every", coarse.alias("coarse")).alias("borders")).scalar()

    def below(values: Column) -> Column:
        return F.coalesce(F.size(F.filter(values, lambda b: b <= F.col(column))), F.lit(0))

    d = df.withColumn("_borders", borders).withColumn("_group", below(F.col("_borders.coarse")))
    fine = below(F.slice("_borders.every", F.col("_group") * side + 1, side))
    return d.withColumn(SLICE, F.when(F.col(column).isNotNull(), F.col("_group") * (side + 1) + fine)).drop("_borders", "_group")


def sliced_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column | str,
    *,
    number: str | None = None,
    total: str | None = None,
    sums: Mapping[str, str] = {},
    group_sums: Mapping[str, str] = {},
    running_max: Mapping[str, str] = {},
    lags: Mapping[str, str] = {},
    leads: Mapping[str, str] = {},
    last_known: Mapping[str, str] = {},
) -> DataFrame:
    """Windows over (keys, order) in two levels.

    `number` 1-based position, `total` rows per key, `sums` running sum, `group_sums` sum per key, `running_max`,
    `lags`/`leads` neighbouring value, `last_known` latest non-null value up to and including the row.  Mappings
    are output name -> input column.  `order` must be unique within the keys and `slice_by` non-decreasing in it; the name
    of a numeric column means slices at the quantiles of that column.
    A null key is a key like any other; a null slice comes first.
    """
    keys = list(keys)
    d = quantile_slices(df, slice_by) if isinstance(slice_by, str) else df.withColumn(SLICE, slice_by)
    pos = F.struct(*order)
    # what a slice gets from the others comes as a row before its first one, so rows are not dealt again for a join
    local = Window.partitionBy(*keys, SLICE).orderBy("_row", *order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)

    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(c).alias(f"_s_{o}") for o, c in {**sums, **group_sums}.items()]
    aggs += [F.max(c).alias(f"_m_{o}") for o, c in running_max.items()]
    aggs += [F.max_by(c, pos).alias(f"_l_{o}") for o, c in lags.items()]
    aggs += [F.min_by(c, pos).alias(f"_f_{o}") for o, c in leads.items()]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), pos)).alias(f"_k_{o}") for o, c in last_known.items()]
    summary = d.groupBy(*keys, SLICE).agg(*aggs)

    carry = _scan_of_slices if keys else _tree_scan
    carried = carry(summary, keys, sums, group_sums, running_max, lags, leads, last_known)

    inner = [(F.row_number().over(local) - 1).alias("_rn")]
    inner += [F.sum(c).over(upto).alias(f"_ws_{o}") for o, c in sums.items()]
    inner += [F.max(c).over(upto).alias(f"_wm_{o}") for o, c in running_max.items()]
    inner += [F.lag(c).over(local).alias(f"_wl_{o}") for o, c in lags.items()]
    inner += [F.lead(c).over(local).alias(f"_wf_{o}") for o, c in leads.items()]
    inner += [F.last(c, ignorenulls=True).over(upto).alias(f"_wk_{o}") for o, c in last_known.items()]
    if leads:
        inner.append(F.lead(F.lit(1)).over(local).alias("_more"))
    names = [c for c in carried.columns if c not in (*keys, SLICE)]
    inner += [F.first(c).over(upto).alias(c) for c in names]
    both = d.withColumn("_row", F.lit(True)).unionByName(carried.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    j = both.select(*d.columns, "_row", *inner).filter("_row")

    out = [F.col(c) for c in df.columns]
    if number:
        out.append((F.col("_rn") + F.col("_cn")).alias(number))
    if total:
        out.append(F.col("_tn").alias(total))
    for o, c in sums.items():
        dtype = df.schema[c].dataType.simpleString()
        zero = F.lit(0.0) if dtype in ("double", "float") else F.lit(0)
        out.append((F.coalesce(F.col(f"_ws_{o}"), zero) + F.coalesce(F.col(f"_cs_{o}"), zero)).alias(o))
    out += [F.col(f"_cg_{o}").alias(o) for o in group_sums]
    out += [F.greatest(f"_wm_{o}", f"_cm_{o}").alias(o) for o in running_max]
    out += [F.when(F.col("_rn") > 1, F.col(f"_wl_{o}")).otherwise(F.col(f"_cl_{o}")).alias(o) for o in lags]
    out += [F.when(F.col("_more").isNotNull(), F.col(f"_wf_{o}")).otherwise(F.col(f"_cf_{o}")).alias(o)
            for o in leads]
    out += [F.coalesce(f"_wk_{o}", f"_ck_{o}").alias(o) for o in last_known]
    return j.select(*out)


def _scan_of_slices(summary: DataFrame, keys: list[str], sums, group_sums, running_max, lags, leads, last_known) -> DataFrame:
    """What the slices before (and behind) add to each slice: one row per slice of a key."""
    by_key = Window.partitionBy(*keys)
    seq = by_key.orderBy(SLICE)
    before = seq.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_cn"), F.sum("_n").over(by_key).alias("_tn")]
    carry += [F.sum(f"_s_{o}").over(before).alias(f"_cs_{o}") for o in sums]
    carry += [F.sum(f"_s_{o}").over(by_key).alias(f"_cg_{o}") for o in group_sums]
    carry += [F.max(f"_m_{o}").over(before).alias(f"_cm_{o}") for o in running_max]
    carry += [F.lag(f"_l_{o}").over(seq).alias(f"_cl_{o}") for o in lags]
    carry += [F.lead(f"_f_{o}").over(seq).alias(f"_cf_{o}") for o in leads]
    carry += [F.last(f"_k_{o}", ignorenulls=True).over(before).alias(f"_ck_{o}") for o in last_known]
    return summary.select(*keys, SLICE, *carry)


#: Slices that are scanned together where there is no key.
FAN = 32


def _tree_scan(summary: DataFrame, keys: list[str], sums, group_sums, running_max, lags, leads, last_known) -> DataFrame:
    """The same as a tree: FAN slices are scanned in one task, then one row for each such bundle, so without a key no task sees all slices.

    Slices at quantiles are some thousand at most, so the top of the tree is a hundred rows or so.
    """
    bundle = F.floor(F.col(SLICE) / FAN)
    d = summary.withColumn("_bundle", bundle)
    here = Window.partitionBy(*keys, "_bundle")
    seq = here.orderBy(SLICE)
    before = seq.rowsBetween(Window.unboundedPreceding, -1)
    behind = seq.rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0)
    first = [F.coalesce(F.sum("_n").over(before), zero).alias("_cn")]
    first += [F.sum(f"_s_{o}").over(before).alias(f"_cs_{o}") for o in sums]
    first += [F.max(f"_m_{o}").over(before).alias(f"_cm_{o}") for o in running_max]
    first += [F.lag(f"_l_{o}").over(seq).alias(f"_cl_{o}") for o in lags]
    first += [F.lead(f"_f_{o}").over(seq).alias(f"_cf_{o}") for o in leads]
    first += [F.last(f"_k_{o}", ignorenulls=True).over(before).alias(f"_ck_{o}") for o in last_known]
    edges = [F.count(F.lit(1)).over(before).alias("_left"), F.count(F.lit(1)).over(behind).alias("_right")]
    inside = d.select(*keys, SLICE, "_bundle", *first, *edges)

    aggs = [F.sum("_n").alias("_n")]
    aggs += [F.sum(f"_s_{o}").alias(f"_s_{o}") for o in dict.fromkeys([*sums, *group_sums])]
    aggs += [F.max(f"_m_{o}").alias(f"_m_{o}") for o in running_max]
    order = F.struct(SLICE)
    aggs += [F.max_by(f"_l_{o}", order).alias(f"_l_{o}") for o in lags]
    aggs += [F.min_by(f"_f_{o}", order).alias(f"_f_{o}") for o in leads]
    aggs += [F.max_by(f"_k_{o}", F.when(F.col(f"_k_{o}").isNotNull(), order)).alias(f"_k_{o}") for o in last_known]
    bundles = d.groupBy(*keys, "_bundle").agg(*aggs)
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    seq = by_key.orderBy("_bundle")
    before = seq.rowsBetween(Window.unboundedPreceding, -1)
    upper = [F.coalesce(F.sum("_n").over(before), zero).alias("_bn"), F.sum("_n").over(by_key).alias("_tn")]
    upper += [F.sum(f"_s_{o}").over(before).alias(f"_bs_{o}") for o in sums]
    upper += [F.sum(f"_s_{o}").over(by_key).alias(f"_cg_{o}") for o in group_sums]
    upper += [F.max(f"_m_{o}").over(before).alias(f"_bm_{o}") for o in running_max]
    upper += [F.lag(f"_l_{o}").over(seq).alias(f"_bl_{o}") for o in lags]
    upper += [F.lead(f"_f_{o}").over(seq).alias(f"_bf_{o}") for o in leads]
    upper += [F.last(f"_k_{o}", ignorenulls=True).over(before).alias(f"_bk_{o}") for o in last_known]
    held = {c: f"_up{i}" for i, c in enumerate([*keys, "_bundle"])}
    same = [F.col(c).eqNullSafe(F.col(v)) for c, v in held.items()]
    j = inside.join(bundles.select(*keys, "_bundle", *upper).withColumnsRenamed(held), same)

    out = [(F.col("_cn") + F.col("_bn")).alias("_cn"), F.col("_tn")]
    for o in sums:
        both = F.coalesce(f"_cs_{o}", f"_bs_{o}"), F.when(F.col(f"_cs_{o}").isNotNull(), F.col(f"_bs_{o}"))
        out.append(F.when(both[1].isNotNull(), F.col(f"_cs_{o}") + F.col(f"_bs_{o}")).otherwise(both[0]).alias(f"_cs_{o}"))
    out += [F.col(f"_cg_{o}") for o in group_sums]
    out += [F.greatest(f"_cm_{o}", f"_bm_{o}").alias(f"_cm_{o}") for o in running_max]
    out += [F.when(F.col("_left") > 0, F.col(f"_cl_{o}")).otherwise(F.col(f"_bl_{o}")).alias(f"_cl_{o}") for o in lags]
    out += [F.when(F.col("_right") > 0, F.col(f"_cf_{o}")).otherwise(F.col(f"_bf_{o}")).alias(f"_cf_{o}") for o in leads]
    out += [F.coalesce(f"_ck_{o}", f"_bk_{o}").alias(f"_ck_{o}") for o in last_known]
    return j.select(*keys, SLICE, *out)


def value_at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column], extra: Sequence[Column] = ()) -> DataFrame:
    """Exact order statistics per key: output name -> 1-based rank expression over column `n` (rows of the key).

    Rows are first counted per distinct value, so equal values cost one row; the running count is sliced at quantiles of
    these values, so no key is gathered whole.  `extra` are further aggregates per key, over columns
    `value` and `n_value`.
    """
    keys = list(keys)
    counted = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value"))
               .agg(F.count(F.lit(1)).alias("n_value")))
    run = sliced_window(counted, keys, ["value"], "value",
                        sums={"upto": "n_value"}, group_sums={"n": "n_value"})
    return run.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.min(F.when(F.col("upto") >= rank, F.col("value"))).alias(name) for name, rank in ranks.items()],
        *extra,
    )


def median_ranks(mean_name_low: str = "lo", mean_name_high: str = "hi") -> dict[str, Column]:
    """Ranks of the two middle values; their mean is the averaging median."""
    return {mean_name_low: F.floor((F.col("n") + 1) / 2), mean_name_high: F.floor((F.col("n") + 2) / 2)}


def upper_median_rank() -> Column:
    """Element n div 2 of the sorted values, counted from 0."""
    return F.floor(F.col("n") / 2) + 1
