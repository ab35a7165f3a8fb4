"""What steps leave on disk: rows are dealt once for a window, and title steps are Parquet, not checkpoints."""

from catalogops import plans
from catalogops.operators import titles as T
from catalogops.operators.skew import int_slice, sliced_window

SF = "/root/testdata/sf0.001"


def test_windows_deal_rows_once(spark, rows):
    """Edges of slices come as rows of the window, not through a join that deals all rows again; null keys, null values and all outputs stay."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = [(k, i, None if i % 3 == 0 else float(i * 7 % 5)) for k in ("a", None) for i in range(23)]
        df = spark.createDataFrame(data, "k string, o long, v double").repartition(3)
        got = sliced_window(df, ["k"], ["o"], int_slice("o", 4), number="n", total="t", sums={"s": "v"}, group_sums={"g": "v"}, running_max={"m": "v"}, lags={"l": "o"}, leads={"f": "o"},
                            last_known={"x": "v"})
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = []
        for k in ("a", None):
            seen = []
            for _, i, v in (r for r in data if r[0] == k):
                seen.append(v)
                known = [x for x in seen if x is not None]
                want.append((k, i, v, i + 1, 23, sum(known), sum(r[2] or 0.0 for r in data if r[0] == k), max(known, default=None), i - 1 if i else None, i + 1 if i < 22 else None,
                             known[-1] if known else None))
        assert rows(got) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_title_steps_are_not_checkpointed(spark, monkeypatch):
    def checkpoint(df):
        raise AssertionError("checkpoint")

    monkeypatch.setattr(T, "cut_lineage", checkpoint)
    assert plans.queries()["select_group_titles"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
