import random
import re

import pytest
from pyspark.sql import functions as F

from catalogops.operators import cosine
from catalogops.operators import linkage as L
from catalogops.operators import vectors as V
from catalogops.policy import MatchPolicy

PLOTS = {1: "castle dragon knight sword princess tower", 2: "spaceship planet alien captain laser orbit", 3: "detective murder clue suspect alibi mansion",
         4: "kitchen recipe chef oven pastry sauce"}


def refs(spark, numbers=(1, 2, 3, 4), suspect=()):
    return spark.createDataFrame([(1, n, n in suspect, PLOTS[n] + " common words here") for n in numbers], "grp long, number long, suspect boolean, text string")


def rips(spark, spec):
    return spark.createDataFrame([(1, k, p, t) for p, (k, t) in enumerate(spec.items())], "grp long, key string, pos long, text string")


def solve(spark, r, f, policy=MatchPolicy()):
    c = L.build_claims(L.score_pairs(r, f), r, f, policy)
    a = L.assign_one_to_one(c)
    return c, a, L.pending_candidates(c, a)


def test_policy_normalises():
    assert MatchPolicy(min_similarity=2).normalized() == MatchPolicy()
    assert MatchPolicy(auto_accept=0.9).normalized().auto_accept == 0.80


def test_shuffled_rips_find_their_references(spark, rows):
    f = refs(spark)
    spec = {"c": PLOTS[3] + " common words", "a": PLOTS[1] + " common", "b": PLOTS[2] + " here"}
    for order in (["a", "b", "c"], ["c", "a", "b"]):
        _, a, _ = solve(spark, rips(spark, {k: spec[k] for k in order}), f)
        assert rows(a, "key", "number") == [("a", 1), ("b", 2), ("c", 3)]


def test_no_claim_is_a_probable_extra(spark, rows):
    r = rips(spark, {"a": PLOTS[1], "x": "completely unrelated menu trailer footage"})
    c, a, _ = solve(spark, r, refs(spark))
    assert rows(L.unclaimed(r, c), "key") == [("x",)]


def test_suspect_reference_is_never_auto_accepted(spark, rows):
    r = rips(spark, {"a": PLOTS[1], "b": PLOTS[2]})
    c, a, p = solve(spark, r, refs(spark, suspect=(2,)))
    assert rows(a, "key") == [("a",)] and rows(p, "key", "number", "quality") == [("b", 2, "contested")]
    assert "suspect_reference" in c.filter("number = 2").first().reasons


def test_single_reference_keeps_raw_weights(spark):
    r = rips(spark, {"a": PLOTS[1] + " common words here"})
    assert L.score_pairs(r, refs(spark, (1,))).first().score == 1.0


def test_idf_drops_terms_of_every_reference(spark):
    v = V.tf_vectors(refs(spark).withColumnRenamed("number", "doc"))
    w = V.tfidf_vectors(v, V.idf(v))
    assert w.filter("term = 'common'").count() == 0 and w.filter("term = 'castle'").count() == 1


def test_raw_lift(spark):
    """Nearly equal texts whose weighted similarity is fair are lifted to the raw cosine."""
    p = L.score_pairs(rips(spark, {"a": PLOTS[1] + " common words here"}), refs(spark))
    top = p.orderBy(F.desc("score")).first()
    assert top.number == 1 and top.raw >= 0.9 and top.score == max(top.raw, top.weighted)


def test_verdict_queue_equals_sequential_processing(spark):
    rnd = random.Random(5)
    for trial in range(3):
        pend, verd = [], {}
        for k in range(8):
            s = round(rnd.random(), 3)
            for rank in (1, 2):
                n = rnd.randint(1, 4) * 2 + rank % 2
                pend.append((1, f"r{k}", n, rank, s - rank * 0.01))
                verd[(f"r{k}", n)] = rnd.choice([True, True, False, None])
        df = spark.createDataFrame(pend, "grp long, key string, number long, rank int, strength double").withColumn("score", F.col("strength"))
        vd = spark.createDataFrame([(1, k, n, v) for (k, n), v in verd.items() if v is not None], "grp long, key string, number long, same boolean")
        got = {(r.key, r.number): r.outcome for r in L.verdict_outcomes(df, vd).collect()}
        want, taken_rip, taken_ref = {}, set(), set()
        heads = {p[1]: p[4] for p in pend if p[3] == 1}
        for _, k, n, rank, _s in sorted(pend, key=lambda p: (-heads[p[1]], p[1], p[3])):
            if k in taken_rip or n in taken_ref:
                want[(k, n)] = "skipped"
            elif verd[(k, n)] is None:
                want[(k, n)] = "failed"
            elif verd[(k, n)]:
                want[(k, n)] = "verified"
                taken_rip.add(k)
                taken_ref.add(n)
            else:
                want[(k, n)] = "rejected"
        assert got == want


def test_assignment_is_greedy_and_one_to_one(spark):
    rnd = random.Random(9)
    cells = [(1, f"r{i}", j, round(rnd.random(), 2)) for i in range(8) for j in range(9)]
    df = spark.createDataFrame(cells, "grp long, key string, number long, strength double").withColumn("score", F.col("strength"))
    got = {(r.key, r.number) for r in L.assign_greedy(df, L._claim_rank).collect()}
    want, a, b = set(), set(), set()
    for _, k, n, _s in sorted(cells, key=lambda c: (-c[3], c[2], c[1])):
        if k not in a and n not in b:
            want.add((k, n))
            a.add(k)
            b.add(n)
    assert got == want


HOLE = "grp long, key string, number long, suspect boolean, score double, confidence double, strength double, rip_margin double, ref_margin double, neighbor_margin double, rank int"


@pytest.mark.parametrize("suspect,best,filled", [(False, (3, 0.70), True), (True, (3, 0.70), False), (False, (9, 0.90), False), (False, (9, 0.71), True)])
def test_single_hole(spark, suspect, best, filled):
    acc = spark.createDataFrame([(1, "a", 2), (1, "b", 4)], "grp long, key string, number long")
    pend = [(1, "c", 3, suspect, 0.70, 0.70, 0.6, 0.0, 0.0, 0.0, 1 if best[0] == 3 else 2)]
    if best[0] != 3:
        pend.append((1, "c", best[0], False, best[1], 0.5, 0.7, 0.0, 0.0, 0.0, 1))
    out = L.single_hole_fill(acc, spark.createDataFrame(pend, HOLE), refs(spark, (1, 2, 3, 4)).select("grp", "number"))
    got = [(r.key, r.number, r.confidence) for r in out.collect()]
    assert got == ([("c", 3, 0.62)] if filled else [])


def test_near_duplicates_lose_no_pair(spark):
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    texts = []
    for i in range(40):
        base = [rnd.choice(words[:30]) for _ in range(20)] if i % 2 == 0 else texts[-1].split()
        texts.append(" ".join(base[:-1] + [rnd.choice(words)] if i % 2 else base))
    texts += [texts[0]] * 5
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "grp long, doc long, text string")
    got = {(r.a, r.b) for r in V.near_duplicates(df, 0.9).collect()}
    first = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts) if texts.index(t) == i], "grp long, doc long, text string")
    v = V.tf_vectors(first)
    want = {(r.a, r.b) for r in V.cosine(v, v).filter("a < b and score >= 0.9").collect()}
    assert got == want and want


def test_near_duplicates_write_no_candidates(spark, rows, monkeypatch):
    """Blocks of ten documents, a coarse bound and small look-ups against all pairs; no exchange is dealt by pairs of documents."""
    for name, value in (("BLOCK_DOCS", 10), ("OWN", 6), ("SHARED", 4), ("ROWS", 3), ("LOOK_UP", 40)):
        monkeypatch.setattr(cosine, name, value)
    rnd = random.Random(7)
    words = [f"word{i}" for i in range(50)]
    texts = [" ".join(rnd.choices(words[:12] if i % 3 else words, k=3 + i % 40)) for i in range(60)] + ["", "a b", None]
    docs = spark.createDataFrame([(i % 2, f"d{i:02d}", t) for i, t in enumerate(texts)] + [(0, "e", texts[0]), (0, "f", texts[0])], "grp long, doc string, text string")
    d = V.near_duplicates(docs, 0.8)
    assert not re.search(r"hashpartitioning\([^)]*\ba#[^)]*\bb#", d._jdf.queryExecution().toString())
    v = V.tf_vectors(docs.filter("doc not in ('e', 'f')"))
    want = V.cosine(v, v).filter("a < b and score >= 0.8").select("grp", "a", "b", F.round("score", 8))
    assert rows(d.select("grp", "a", "b", F.round("score", 8))) == rows(want) and want.count() > 20


def test_claim_pairs_lose_nothing_that_claims_see(spark, rows):
    """Bounded search against all pairs: same claims, far fewer pairs; equal scores, single terms and empty texts included."""
    rnd = random.Random(11)
    vocab = [f"word{i:03d}" for i in range(120)]
    plots = {n: " ".join(rnd.choices(vocab, weights=[1 / (i + 1) for i in range(120)], k=60)) for n in range(1, 41)}
    f = spark.createDataFrame([(1 + n % 2, n, n % 9 == 0, t) for n, t in plots.items()] + [(1, 50, False, plots[2]), (1, 51, False, "")], "grp long, number long, suspect boolean, text string")
    texts = [" ".join(w for w in plots[1 + k % 40].split() if rnd.random() > k % 10 / 12) + " " + " ".join(rnd.choices(vocab, k=k % 7)) for k in range(120)] + ["", "word000", "none of these"]
    r = spark.createDataFrame([(1 + k % 2, f"k{k:03d}", k, t) for k, t in enumerate(texts)], "grp long, key string, pos long, text string")
    for policy in (MatchPolicy(), MatchPolicy(min_similarity=0.3)):
        every, some = L.score_pairs(r, f), L.claim_pairs(r, f, policy)
        shown = [c for c in L.build_claims(every, r, f, policy).columns]
        assert rows(L.build_claims(some, r, f, policy), *shown) == rows(L.build_claims(every, r, f, policy), *shown)
        assert some.count() < every.count() and some.exceptAll(every).isEmpty()
        base = every.filter(F.col("score") >= policy.min_similarity)
        assert rows(L.neighbour_scores(base, some)) == rows(L.neighbour_scores(base, every))


def test_best_partners_keep_ties(spark):
    v = spark.createDataFrame([(1, d, t, w, w) for d, t, w in [(1, "a", 0.8), (1, "b", 0.6), (2, "a", 0.6), (2, "c", 0.8), (3, "b", 1.0)]], "grp long, doc long, term string, raw double, weight double")
    c = spark.createDataFrame([(1, d, t, w, w) for d, t, w in [(10, "a", 1.0), (11, "a", 1.0), (12, "b", 1.0), (13, "c", 0.1)]], "grp long, doc long, term string, raw double, weight double")
    got = {(r.a, r.b) for r in V.best_partners(v, c, V.list_bounds(c), 1).collect()}
    assert {(1, 10), (1, 11), (2, 10), (2, 11), (3, 12)} <= got and (2, 13) not in got
