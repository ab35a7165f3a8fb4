"""Timed text is dealt by its track once: what follows needs no shuffle."""

import re

from pyspark.sql import functions as F

from catalogops import plans
from catalogops.operators import cues as C
from catalogops.plans import cues as queries
from catalogops.plans import views
from catalogops.plans.registry import Tables
from catalogops.sources import subtitles as S

SF = "/root/testdata/sf0.001"


def shuffles(df):
    """Exchanges of the plan as it ran, without those that deal out the text."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"Exchange (?:hash|range)partitioning[^\n]*", plan) if "REPARTITION_BY_NUM" not in x]


def test_snapping_moves_text_only_by_track(spark):
    t = Tables(spark, SF)
    assert shuffles(C.snap_shifts(views.lines(t), queries.words(t))) == []


def test_snapping_reaches_over_blocks(spark):
    """A cue of more words than a block has, and a hit whose words go on in the next block; repeated cues each keep their hit."""
    words = [("t", f"w{i}", i * 0.4, i * 0.4 + 0.3) for i in range(200)] + [("u", "a", 5.0, 5.1)]
    w = S.number_words(spark.createDataFrame(words, "track string, text string, start double, end double"))
    long, edge = " ".join(f"w{i}" for i in range(10, 190)), "w62 w63 w64 w66"
    rows = [("t", 1, 3.5, 80.0, long), ("t", 2, 24.0, 30.0, edge), ("t", 3, 50.0, 60.0, edge), ("v", 1, 5.0, 6.0, "a b"), ("u", 1, 5.0, 6.0, "b a")]
    cues = spark.createDataFrame(rows, "track string, idx long, start double, end double, text string")
    got = {(r.track, r.idx): (r.matched, round(r["shift"], 6)) for r in C.snap_shifts(cues, w).collect()}
    assert got == {("t", 1): (180, 0.5), ("t", 2): (4, 0.8)}
    moved = {(r.track, r.idx): round(r.start, 6) for r in C.snap_to_words(cues, w).collect()}
    assert moved == {("t", 1): 4.0, ("t", 2): 24.8, ("t", 3): 50.0}


def test_snapped_cues_are_written_without_text(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(C, "store", lambda df, name, f=C.store: kept.append(df.columns) or f(df, name))
    plans.queries()["snap_to_words"](spark, SF).agg(F.count("*")).collect()
    assert kept and not any("text" in c for c in kept)


def test_adoption_compares_texts_once(spark, monkeypatch):
    """Repair and snapping move cues and keep their texts, so texts are compared for the first gate alone; texts are dealt by track in tables."""
    calls, dealt = [], []
    monkeypatch.setattr(C, "text_similarity", lambda a, b, f=C.text_similarity: calls.append(1) or f(a, b))
    monkeypatch.setattr(C, "store_dealt", lambda df, *a, f=C.store_dealt: dealt.append(a[0]) or f(df, *a))
    out = plans.queries()["adopt_first_passing"](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.count() == n and len(calls) == 1 and dealt == ["track", "track"]


def test_anchors_similarity_and_overlap_of_odd_tracks(spark):
    """Tracks of one side, null tracks, repeated texts, empty and reversed intervals."""
    cue = "track string, idx long, start double, end double, text string"
    a = spark.createDataFrame([("t", 1, 0.0, 40.0, "one two three four"), ("t", 2, 35.0, 50.0, "same words said twice"), ("t", 3, 61.0, 60.0, "same words said twice"), ("t", 4, 70.0, 70.0, "a b c d"),
                               ("u", 1, 0.0, 1.0, "only on this side"), (None, 1, 0.0, 9.0, "one two three four")], cue)
    b = spark.createDataFrame([("t", 7, 2.0, 30.0, "One, two three: four!"), ("t", 8, 38.0, 45.0, "same words said twice"), ("t", 9, 71.0, 72.0, "A b c d"), ("t", 10, 80.0, 81.0, "a b c d"),
                               ("v", 1, 0.0, 1.0, "other"), (None, 1, 0.0, 9.0, "one two three four")], cue)
    assert [tuple(r) for r in C.text_anchors(a, b).collect()] == [("t", 1, 0.0, -2.0)]
    # 28 + 2 of the first interval, 7 of the second; lengths 55 and 37
    assert [(r.track, round(r.overlap, 9)) for r in C.interval_overlap(a, b).collect()] == [("t", 1.0)]
    words = {"one": (1, 1), "two": (1, 1), "three": (1, 1), "four": (1, 1), "same": (2, 1), "words": (2, 1), "said": (2, 1), "twice": (2, 1)}
    want = sum(x * y for x, y in words.values()) / (sum(x * x for x, _ in words.values()) * sum(y * y for _, y in words.values())) ** 0.5
    assert [(r.track, r.similarity) for r in C.text_similarity(a, b).collect()] == [("t", round(want, 9))]
