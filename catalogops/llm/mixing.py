"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

Every source gets a target number of words, and so every document of it the same expected number of copies.  The whole part is
taken as it is; the fractions are rounded together.  In a block of some FAN documents of similar size, two at a time meet and words
move from one to the other until one of them is at 0 or 1; the direction is random, such that every expectation stays as it was,
and the words of both together do not change.  What is left of a block, one document with a fraction, goes up to the next level
of a reduction tree, until one is left per source.  That one is rounded, so a source misses its target by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogops.llm.common import keep, with_safe_names

WEIGHTS = (5, 2, 1)
FAN = 64
MOST_COPIES = 3
SLICE = 4096  # repeated rows are numbered in slices of that many
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight): sources by code point, null last; the weights repeat in that order.

    Ranks are counted per range of sources, and one number per range is carried to the later ones.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    ranged = keep(sums.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shuffle partition
    carried = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    rank = ranged.withColumn("_rank", local).join(carried, "_part")
    place = ((F.col("_rank") - 1 + F.col("_before")) % len(weights)).cast("int")
    return rank.select("source", "source_size", F.array(*map(F.lit, weights))[place].cast("long").alias("weight"))


def with_targets(sources: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """`sources` with `target`: all words shared by weight, none above `most` times its size; what is cut off is shared again.

    Each round only needs three sums over all sources; a source once cut stays cut.
    """
    sources = keep(sources, "weights")
    cap = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cut, weight = 0, sources.agg(F.sum("weight")).first()[0] or 0
    above = F.lit(False)
    while weight:
        share = F.col("weight") * F.lit(total - cut) / F.lit(weight)
        now = above | (cap < share)
        row = sources.agg(F.sum(F.when(now, cap)).alias("cut"), F.sum(F.when(~now, F.col("weight"))).alias("weight")).first()
        if (row.weight or 0) == weight:
            break
        above, cut, weight = now, row.cut or 0, row.weight or 0
    # the last sums decide: what is above the level they give is exactly what was cut
    level = F.col("weight") * F.lit(total - cut) / F.lit(max(weight, 1))
    return sources.withColumn("target", F.when(cap < level, cap.cast("double")).otherwise(level.cast("double")) if weight else cap.cast("double"))


def _uniform(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _round_block(entries: str, level: int) -> Column:
    """Sequential pivots over an array of (order, h, p, size, ...): struct(last, left, ones).

    `last` is the position of the entry that stays open with fraction `left`; `ones` are the positions that became 1.
    """
    e = F.col(entries)

    def pivot(s, k):
        x, y = F.get(e, s["last"]), F.get(e, k)
        a, b, wide, high = s["left"], y["p"], x["size"], y["size"]
        gain, loss = F.least(wide * (1 - a), high * b), F.least(wide * a, high * (1 - b))  # words that may move to x, away from x
        to_x = _uniform(F.lit(level), x["h"], y["h"]) * (gain + loss) < loss  # so that nobody's expectation changes
        x_done = F.when(to_x, wide * (1 - a) <= high * b).otherwise(wide * a <= high * (1 - b))
        left = (F.when(to_x & x_done, b - gain / high).when(to_x, a + gain / wide).when(x_done, b + loss / high).otherwise(a - loss / wide))
        one = F.when(to_x & x_done, F.array(s["last"])).when(~to_x & ~x_done, F.array(k)).otherwise(F.array().cast("array<int>"))
        return F.struct(F.when(x_done, k).otherwise(s["last"]).alias("last"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)).alias("left"),
                        F.concat(s["ones"], one).alias("ones"))

    start = F.struct(F.lit(0).alias("last"), F.get(e, F.lit(0))["p"].alias("left"), F.array().cast("array<int>").alias("ones"))
    rest = F.when(F.size(e) > 1, F.sequence(F.lit(1), F.size(e) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, start, pivot)


def rounded(rows: DataFrame, payload: list[str]) -> DataFrame:
    """`rows(source, size, h, p, *payload)` with 0 < p < 1 -> (*payload, h, up): up is 0 or 1, on average p.

    Large documents meet first, so that what stays open at the end is small.
    """
    n = rows.count()
    bucket = F.floor(F.log2(F.col("size") + 1) * 4).cast("int")
    todo = rows.withColumn("bucket", bucket)
    done = []
    entry = F.struct((-F.col("size")).alias("order"), "h", "p", "size", *payload)
    blocks, level = n, 0
    while True:
        level += 1
        last = blocks <= 1
        blocks = -(-blocks // FAN)
        keys = [F.col("source")] if last else [F.col("source"), F.col("bucket"), F.pmod(F.xxhash64("h", F.lit(level)), F.lit(max(blocks, 1))).alias("block")]
        grouped = todo.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("e"))
        if last:
            grouped = grouped.withColumn("bucket", F.lit(0))
        stored = keep(grouped.select("source", "bucket", "e", _round_block("e", level).alias("s")), "rounding")
        decided = stored.select("s", F.posexplode("e").alias("k", "x")).filter("k <> s.last")
        done.append(decided.select(*[f"x.{c}" for c in payload], "x.h", F.array_contains("s.ones", F.col("k")).cast("int").alias("up")))
        left = stored.select("source", "bucket", F.get("e", F.col("s.last")).alias("x"), F.col("s.left").alias("left"))
        if last:
            up = (F.col("left") >= 0.5).cast("int")
            done.append(left.select(*[f"x.{c}" for c in payload], "x.h", up.alias("up")))
            break
        todo = left.select("source", "bucket", "x.size", "x.h", F.col("left").alias("p"), *[f"x.{c}" for c in payload])
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per row of `docs(doc_id, text, source)`: doc_id, h, size, source, source_size, target, copies and taken = copies * size.

    Null and empty texts have size 0 and take nothing.  A null source is a source of its own, the last one.  Repeated rows are rounded one
    by one, each under a number of its own, so that they spread over blocks.  The choice depends on ids and texts only, so reruns agree.
    """
    sized = keep(docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("h"), n_words("text").alias("size")), "sizes")
    sources = keep(with_targets(ranked_sources(sized, weights), most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = sources.select(F.col("source").alias("_source"), "source_size", "target")
    rows = (sized.join(short_list(named), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("whole", F.floor(rate).cast("int")).withColumn("p", rate - F.floor(rate)))
    payload = ["doc_id", "source_size", "target", "whole", "source", "size", F.col("h").alias("name")]
    open_rows = (F.col("p") > 0) & (F.col("size") > 0)
    own = numbered(rows.filter(open_rows)).withColumn("_h", F.when(F.col("_no") > 0, F.xxhash64("h", "_no")).otherwise(F.col("h")))
    up = rounded(own.select("source", "size", F.col("_h").alias("h"), "p", F.struct(*payload).alias("row")), ["row"]).select("row.*", "up").withColumnRenamed("name", "h")
    settled = rows.filter(~open_rows).select(*payload, F.lit(0).alias("up")).withColumnRenamed("name", "h")
    copies = (F.col("whole") + F.col("up")).cast("int")
    return up.union(settled).select("doc_id", "h", "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` with `_no`, which counts equal rows from 0; they are counted first and dealt out again in slices."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / SLICE)))
    dealt = counted.withColumn("_slice", start).repartition("h", "_slice")
    last = F.least(F.col("_n"), (F.col("_slice") + 1) * SLICE) - 1
    return dealt.withColumn("_no", F.explode(F.sequence(F.col("_slice") * SLICE, last))).drop("_n", "_slice")


def short_list(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A broadcast hint for a stored table of at most `limit` short rows, otherwise the table as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: `docs` with `copies`, how often each is taken, and `taken` words; documents taken 0 times are left out.

    A column of `docs` named like a new one gives way to it.  Texts are not multiplied; a reader repeats a row `copies` times.
    Of rows repeated under one id, text and source, which ones are taken once more than the others follows their order in storage.
    """
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per stored partition
    within = Window.partitionBy("_key", "_part").orderBy(F.lit(1))

    def run(d: DataFrame) -> DataFrame:
        key = F.xxhash64("h", "source").alias("_key")
        total = F.sum("copies") - F.count(F.lit(1)) * F.min("copies")
        plan = mix(d, weights, most).groupBy(key).agg(F.min("copies").alias("_least"), total.alias("_more"), F.max("size").alias("_size"))
        plan = keep(plan.filter("_least > 0 or _more > 0"), "mix")
        rows = d.withColumn("_key", F.xxhash64(F.xxhash64("doc_id", "text"), "source"))
        out = rows.join(plan.filter("_more = 0"), "_key").withColumn("copies", F.col("_least"))
        uneven = plan.filter("_more > 0")
        if not uneven.isEmpty():
            stored = keep(rows.join(short_list(uneven), "_key").withColumn("_part", F.spark_partition_id()), "repeated")
            parts = stored.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
            ranked = stored.join(parts, ["_key", "_part"]).withColumn("_no", F.col("_before") + F.row_number().over(within))
            ranked = ranked.withColumn("copies", F.col("_least") + (F.col("_no") <= F.col("_more")).cast("int")).filter("copies > 0")
            out = out.select(*d.columns, "_size", "copies").union(ranked.select(*d.columns, "_size", "copies"))
        return out.select(*d.columns, F.col("copies").cast("int").alias("copies"), (F.col("_size") * F.col("copies")).cast("long").alias("taken"))

    return with_safe_names(docs, ["doc_id", "text", "source"], run)
