"""Samples hold their limits whatever the ids are."""

from collections import Counter

from catalogops.llm import langid, mixing, neardup, toxicity


def test_language_sample_is_bounded(spark):
    """One id on half of the rows, and one row repeated: at most so many texts a language, no copy twice."""
    rows = [(i if i % 2 else 7, ("en", "de")[i % 4 // 2], f"some words of text {i}") for i in range(1, 1200)] + [(5, "en", "the same row")] * 500
    x, y, languages = langid.sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"), 10, 4)
    assert languages == ["de", "en"] and 8 <= len(y) <= 80


def test_toxicity_sample_does_not_grow(spark, monkeypatch):
    kept, keep = {}, toxicity.keep
    monkeypatch.setattr(toxicity, "keep", lambda df, name: kept.setdefault(name, keep(df, name)))
    rows = [(i if i % 2 else 8, f"number {i} " + " ".join(f"w{(i * 7 + k) % 60}" for k in range(20)) + (" grolbix" if i % 3 == 0 else "")) for i in range(800)] + [(9, "the same row")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(800)] * 2, "doc_id long, label int")
    toxicity.fit(docs, labels, per_class=50)
    sizes = {r.label: r["count"] for r in kept["toxicity-sample"].groupBy("label").count().collect()}
    assert set(sizes) == {0, 1} and all(10 <= n <= 50 for n in sizes.values())


def test_one_id_with_several_texts(spark):
    """Each text of an id is judged on its own: only texts that no smaller id has stay."""
    a, b, c = (" ".join(f"{t}{k}" for k in range(20)) for t in "abc")
    docs = spark.createDataFrame([(1, a), (5, b), (5, a), (None, a), (None, c), (7, None), (7, ""), (7, "")], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in neardup.one_per_group(docs).collect())
    assert got == Counter([(1, a), (5, b), (None, c), (7, None), (7, "")])


def test_blocks_of_repeated_rows(spark, monkeypatch):
    """3,000 equal rows are rounded in blocks near the fan, each source still near its target."""
    kept, keep = [], mixing.keep
    monkeypatch.setattr(mixing, "keep", lambda df, name: kept.append(keep(df, name)) or kept[-1] if name == "rounding" else keep(df, name))
    docs = spark.createDataFrame([(1, "the same row here", "a")] * 3000 + [(i, f"word {i}", "b") for i in range(2, 40)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 3038 and max(d.selectExpr("max(size(e))").first()[0] for d in kept) <= 3 * mixing.FAN
    for s in "ab":
        rows = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
    assert Counter(map(repr, got)) == Counter(map(repr, mixing.mix(docs).collect()))


def test_mixed_documents_of_repeated_rows(spark):
    """The rows of the mix are those of its plan, also where one row is repeated and only some of its copies are taken."""
    docs = spark.createDataFrame([(1, "the same row here", "a", i) for i in range(700)] + [(1, "the same row here", None, 0)] * 30 + [(i, f"word {i}", "b", i) for i in range(2, 40)],
                                 "doc_id long, text string, source string, extra int")
    plan = Counter((r.doc_id, r.source, r.copies, r.taken) for r in mixing.mix(docs).collect() if r.copies)
    assert plan and Counter((r.doc_id, r.source, r.copies, r.taken) for r in mixing.mixed_documents(docs).collect()) == plan
