"""What one task holds follows from the rows it gets, not from the size of the table."""

import math

from pyspark.sql import functions as F

from catalogops.operators import linkage as L
from catalogops.operators import skew
from catalogops.operators import vectors as V
from catalogops.plans import linkage as plans
from catalogops.plans import views
from catalogops.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def parts(df, *keys):
    """Number of partitions, and the largest number of partitions that the rows of one key lie in."""
    spread = df.withColumn("_p", F.spark_partition_id()).groupBy(*keys).agg(F.countDistinct("_p").alias("n")).agg(F.max("n")).first()[0]
    return df.rdd.getNumPartitions(), spread


def test_text_is_dealt_by_its_length(spark, monkeypatch):
    """Documents as vectors and as lines: partitions of some TASK_CHARS characters, each document in one of them."""
    monkeypatch.setattr(skew, "TASK_CHARS", 20_000)
    t = Tables(spark, SF)
    chars = t.documents.agg(F.sum(F.length("text"))).first()[0]
    want = (math.ceil(chars / 20_000), 1)
    assert want[0] > 10
    assert parts(V.tf_vectors(t.documents.select(F.col("doc_id").alias("grp"), F.col("doc_id").alias("doc"), "text")), "grp", "doc") == want
    assert parts(views.lines(t), "track") == want


def test_claims_are_dealt_by_their_pairs(spark, monkeypatch):
    """Tasks of some TASK_ROWS pairs, whatever the number of shuffle partitions; all claims of a rip in one of them."""
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    t = Tables(spark, SF)
    r, f = plans.rips(t, plans.SHELVES), plans.refs(t, plans.SHELVES)
    pairs = L.score_pairs(r, f)
    want = (math.ceil(pairs.count() / 50), 1)
    assert want[0] > 4
    assert parts(L.build_claims(pairs, r, f, plans.EASY), "grp", "key") == want


def test_unclaimed_rips_meet_one_row_of_a_claimed_rip(spark, monkeypatch):
    """Tasks of some TASK_ROWS rips, and as many rows of claimed rips as there are claimed rips; rows of null keys and repeated rips stay."""
    monkeypatch.setattr(skew, "TASK_ROWS", 20)
    rips = spark.range(100).selectExpr("id % 3 as grp", "id as key").union(spark.sql("select 1L, 1L union all select 1L, 100L union all select 1L, 100L union all select null, 7L"))
    claims = spark.range(2000).selectExpr("id % 50 % 3 as grp", "id % 50 as key", "id as number")
    out = L.unclaimed(rips, claims)
    assert parts(out, "grp", "key") == (math.ceil(104 / 20), 1)
    want = [(k % 3, k) for k in range(50, 100)] + [(1, 100), (1, 100), (None, 7)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    anti = out._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti")[1]
    assert "Aggregate" in anti


def test_pairs_are_made_in_passes(spark, monkeypatch):
    """Parts of whole documents of some PASS_ROWS terms for each of the 4 shuffle partitions; the same pairs as in one pass."""
    t = Tables(spark, SF)
    rip, ref = L.linked_vectors(plans.rips(t, plans.SHELVES), plans.refs(t, plans.SHELVES))
    want = sorted(map(tuple, V.pair_sums(rip, ref).collect()))
    n = rip.count()
    monkeypatch.setattr(V, "PASS_ROWS", n // 12)
    parts_of = V.passes(rip)
    assert len(parts_of) >= 3 and max(p.count() for p in parts_of) < 0.6 * n
    assert sum(p.select("grp", "doc").distinct().count() for p in parts_of) == rip.select("grp", "doc").distinct().count()
    assert sorted(map(tuple, V.pair_sums(rip, ref).collect())) == want and want


def test_runners_up_are_those_of_joins(spark):
    """Ties, scores of 0, holes and rips of one pair: the windows over a rip find what joins find."""
    scores = {7: {1: 0.5, 2: 0.5, 3: 0.9, 5: 0.2}, 8: {4: 0.0, 5: 0.3}, 9: {6: 0.4}, 10: {2: 0.0, 3: 0.0}}
    rows = [(1, key, number, score) for key, of in scores.items() for number, score in of.items()]
    pairs = spark.createDataFrame(rows, "grp long, key long, number long, score double")
    up = L._runners_up(pairs)
    got = {(r.key, r.number): (r.f1 and tuple(r.f1), r.f2 and tuple(r.f2)) for r in up.collect()}
    for key, of in scores.items():
        best = sorted(((n, s) for n, s in of.items() if s > 0), key=lambda x: (-x[1], x[0])) + [None, None]
        assert all(got[key, n] == (best[0], best[1]) for n in of)
    names = ["grp", "key", "number", "neighbor_number", "neighbor_score"]
    assert sorted(map(tuple, up.select("grp", "key", "number", *L._neighbour()).collect())) == sorted(map(tuple, L.neighbour_scores(pairs, pairs).select(*names).collect()))
