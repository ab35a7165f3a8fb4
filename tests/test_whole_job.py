"""Near duplicates of all documents: nothing is left out by a shelf."""

import duckdb

from catalogops import plans
from catalogops.plans.linkage import vec_sql

SF = "/root/testdata/sf0.001"


def test_near_duplicates_of_all_documents(spark):
    """Against all pairs in SQL, in one group; the pairs cross the shelves of other queries."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(f"""WITH d AS (SELECT 1 AS grp, min(doc_id) AS doc, text FROM documents GROUP BY text), {vec_sql('d', 'v')}
        SELECT * FROM (SELECT a.doc AS a, b.doc AS b, round(sum(a.weight * b.weight), 9) AS score
        FROM v a JOIN v b ON a.term = b.term AND a.doc < b.doc GROUP BY ALL) WHERE score >= 0.92""").fetchall()
    got = [tuple(r) for r in plans.queries()["near_duplicate_documents"](spark, SF).select("a", "b", "score").collect()]
    assert sorted(got) == sorted(want) and any(a % 128 != b % 128 for a, b, _ in got)
