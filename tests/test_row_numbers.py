"""A selector of digits is a row number; one in scientific notation is a prefix, in the query and in its SQL."""

import hashlib

import duckdb

from catalogops import plans
from catalogops.operators import ranking as R


def test_exponents_are_prefixes(spark, tmp_path):
    """Supplier 361 selects by 52720E00, which DuckDB's cast takes for the number of part 52720."""
    md5 = lambda n: hashlib.md5(str(n).encode()).hexdigest()
    assert md5(361).upper().startswith("52720E00")
    spark.createDataFrame([(1,), (361,), (52720,), (1083,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(361,), (4,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = plans.queries()["resolve_by_prefix"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(plans.oracle_sql()["resolve_by_prefix"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert dict((r[0], r[3]) for r in want)[361] == md5(361)


def test_fractions_are_prefixes(spark):
    e = spark.createDataFrame([(1, "abc"), (2, "1.5x")], "number long, fingerprint string")
    s = spark.createDataFrame([(0, "1.5"), (1, "+1")], "sel_pos long, selector string")
    assert {r.sel_pos: r.fingerprint for r in R.resolve_by_prefix(e, s).collect()} == {0: "1.5x", 1: "abc"}
