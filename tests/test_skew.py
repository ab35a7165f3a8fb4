"""Two-level windows and order statistics against plain computations, with one hot key."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from catalogops.operators import skew
from catalogops.operators.skew import SLICE, int_slice, median_ranks, quantile_slices, sliced_window, upper_median_rank, value_at_ranks


def data(seed=1):
    r = random.Random(seed)
    out = []
    for i in range(600):
        out.append(("hot" if r.random() < 0.5 else f"k{r.randint(0, 20)}", i * 3, r.randint(-5, 30), r.choice([None, "x", "y"])))
    return out


@pytest.mark.parametrize("scan", ["_scan_of_slices", "_tree_scan"])
def test_sliced_window_equals_plain(spark, monkeypatch, scan):
    monkeypatch.setattr(skew, "FAN", 3)
    monkeypatch.setattr(skew, "_scan_of_slices", getattr(skew, scan))
    d = data()
    df = spark.createDataFrame(d, "k string, seq long, v long, t string")
    got = {r.seq: r for r in sliced_window(df, ["k"], ["seq"], int_slice("seq", 50), number="n", total="tot", sums={"cum": "v"}, group_sums={"all": "v"},
                                           running_max={"mx": "v"}, lags={"prev": "v"}, leads={"next": "v"}, last_known={"known": "t"}).collect()}
    assert len(got) == len(d)
    for key in {x[0] for x in d}:
        g = [x for x in d if x[0] == key]
        for i, x in enumerate(g):
            r = got[x[1]]
            assert (r.n, r.tot, r.cum, r["all"]) == (i + 1, len(g), sum(y[2] for y in g[: i + 1]), sum(y[2] for y in g))
            assert r.mx == max(y[2] for y in g[: i + 1])
            assert r.prev == (g[i - 1][2] if i else None) and r.next == (g[i + 1][2] if i + 1 < len(g) else None)
            assert r.known == next((y[3] for y in reversed(g[: i + 1]) if y[3]), None)


def test_order_statistics(spark):
    d = data(2)
    df = spark.createDataFrame(d, "k string, seq long, v long, t string")
    for r in value_at_ranks(df, ["k"], "v", {**median_ranks(), "up": upper_median_rank()}).collect():
        vals = sorted(x[2] for x in d if x[0] == r.k)
        assert r.n == len(vals) and (r.lo + r.hi) / 2 == statistics.median(vals) and r.up == vals[len(vals) // 2]


def test_slices_follow_the_values(spark):
    """A key with half of the rows, on values from seconds to years, with ties and nulls: no slice holds much, order is kept."""
    r = random.Random(4)
    d = [("hot" if i % 2 else f"k{i % 17}", r.choice([None, 0.0, r.expovariate(1), 1e9 * r.random(), -(10 ** r.uniform(0, 12))])) for i in range(4000)]
    df = spark.createDataFrame(d, "k string, v double")
    got = quantile_slices(df, "v", 8).collect()
    assert all((x.v is None) == (x[SLICE] is None) for x in got)
    pairs = sorted((x.v, x[SLICE]) for x in got if x.v is not None)
    assert all(a[1] <= b[1] for a, b in zip(pairs, pairs[1:], strict=False))
    sizes = {}
    for x in got:
        if x.k == "hot" and x.v not in (None, 0.0):
            sizes[x[SLICE]] = sizes.get(x[SLICE], 0) + 1
    assert len(sizes) > 30 and max(sizes.values()) < 120
    none = spark.createDataFrame([], "k string, v double")
    assert quantile_slices(none, "v").count() == 0


def test_hot_key_uses_every_task(spark):
    """Half of the rows under one key, all values different: its ranks are computed by all tasks."""
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"), (F.col("id") * F.col("id")).alias("v"))
    placed = quantile_slices(df, "v").repartition(8, "k", SLICE).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in placed.filter("k = -1").groupBy("task").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_global_window_without_keys(spark):
    df = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("v"))
    last = sliced_window(df, [], ["seq"], int_slice("seq", 9), sums={"cum": "v"}, number="n").orderBy(F.desc("seq")).first()
    assert (last.n, last.cum) == (100, sum(i % 7 for i in range(100)))
