"""Registered corpus queries: shape on the smallest tables, and the pipeline against a brute-force version."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from catalogops.llm import queries
from test_operators import brute_components, brute_contamination

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_table(spark, name):
    df = entry.queries()[name](spark, SF)
    source = "pages" if name.startswith("op1_") else "conversations" if name.startswith("op5_") else "documents"
    if source != "conversations":
        assert df.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns == columns + (["copies", "taken"] if k == 4 else []), name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r for r in docs.collect()})
    first = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good, lines, single, clean, mixed = kept
    assert set(good) < set(first) and set(lines) <= set(good)
    assert all(set(r.text.split("\n")) <= set(good[i].text.split("\n")) for i, r in lines.items())
    groups = brute_components([(i, r.text) for i, r in lines.items()], 5, 80)
    assert set(single) == {c for _, _, c in groups}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == {d for d, _, _, _, bad in brute_contamination([(i, r.text) for i, r in single.items()], items) if not bad}
    assert set(mixed) <= set(clean) and all(1 <= r.copies <= 3 for r in mixed.values())


def test_run_is_repeatable(spark):
    a, b = (sorted(map(repr, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert a == b and a
