"""A JSON document is written and parsed once for each row, in tasks of a bounded number of rows."""

import math
import re

from pyspark.sql import functions as F

from catalogops.operators import audit as A
from catalogops.operators import media as M
from catalogops.plans import audit as queries
from catalogops.plans import views
from catalogops.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_documents_are_written_and_parsed_once(spark, monkeypatch):
    """Filters, also those Spark adds for explode, stay above the document; they were moved to the tasks that read the table."""
    monkeypatch.setattr(views, "DOCUMENT_ROWS", 50)
    t = Tables(spark, SF)
    want = math.ceil(t.orders.count() / 50)
    for d in (A.explode_episodes(queries.parsed(t)), A.explode_assets(queries.parsed(t)), A.quarantine(queries.parsed(t)), M.parse_probes(views.probes(t)).filter("item_id > 5")):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall("StructsToJsonEvaluator", plan)) == 1 and len(re.findall(r"from_json\(", plan)) <= 1
        assert d.rdd.getNumPartitions() == want > 10


def test_status_of_odd_documents(spark):
    texts = [None, " ", "{", "junk", "[1]", '{"version":1}', ' {"version":1,"episodes":[{"key":"x"}]} ', '{"version":"1"}', '{"version":1.0}', '{"version":2}', '{"version":null}',
             '{"a":1}', '{"version":1', '{"version":1,"ep', '{"version":1,"episodes":[{"ke', '{"version":1,"episodes":3}', '{"version":1} x', '{"version":2,"version":1}', '{"version":1,"version":2}']
    d = spark.createDataFrame(list(enumerate(texts)), "item_id int, rip_spec_data string")
    text = F.trim("rip_spec_data")
    version = F.get_json_object(text, "$.version")
    status = (F.when(F.coalesce(text, F.lit("")) == "", "blank").when(version.isNull(), "malformed")
              .when(version.try_cast("int") == A.ENVELOPE_VERSION, "parsed").otherwise("version"))
    plain = d.select("item_id", status.alias("s"), F.from_json(text, A.ENVELOPE).alias("e"))
    want = {r.item_id: (r.s, r.e if r.s == "parsed" else None) for r in plain.collect()}
    assert {r.item_id: (r.env_status, r.env) for r in A.parse_envelopes(d).collect()} == want
    some = A.parse_envelopes(d, parts=("episodes",))
    assert {r.item_id: (r.env_status, r.env and r.env.episodes) for r in some.collect()} == {k: (s, e and e.episodes) for k, (s, e) in want.items()}
