"""Scan lines are cut once; odd lines and repeated attributes keep their rules."""

from catalogops.plans.registry import Tables
from catalogops.plans.sources import scan_lines
from catalogops.sources import scans as S

LINES = ['TINFO:1,2,0,"Title, 1"', "TINFO: 1 ,9,0,0:01:05", "TINFO:1,2,0", "SINFO:1,x,1,6201,a", 'CINFO:2,0,"', 'CINFO:2,0,""', 'CINFO:2,0,"a"b"', 'CINFO:2,0,"a', "CINFO:x,0,a",
         "MSG:1005,0,1,s", "no prefix", "TINFO", 'CINFO:2,0,"a"\r', "CINFO:2,0,a\nb", "CINFO:2,0,a:b,c", " TINFO:1,2,0,z", None, "SINFO:1,2,3,0,"]


def test_a_line_is_cut_once(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(LINES)], "disc_id string, pos int, line string")
    got = [tuple(r)[1:] for r in S.split_scan_lines(lines).orderBy("pos").collect()]
    assert got == [(0, "TINFO", 1, None, 2, "Title, 1"), (1, "TINFO", 1, None, 9, "0:01:05"), (4, "CINFO", None, None, 2, '"'), (5, "CINFO", None, None, 2, ""),
                   (6, "CINFO", None, None, 2, 'a"b'), (7, "CINFO", None, None, 2, '"a'), (12, "CINFO", None, None, 2, "a"), (14, "CINFO", None, None, 2, "a:b,c"),
                   (17, "SINFO", 1, 2, 3, "")]
    plan = S.split_scan_lines(scan_lines(Tables(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_extract(") == 1


def test_streams_from_their_lines(spark):
    rows = [(5, 1, 0, 1, "Audio"), (6, 1, 0, 30, "old"), (7, 1, 0, 30, ""), (8, 1, 0, 3, ""), (9, 1, 0, 28, "ENG"), (10, 1, 0, 3, "fra"), (11, 1, 0, 14, "6"), (12, 1, 0, 14, "x"),
            (1, 1, 4, 1, "Video"), (2, 1, 4, 5, ""), (3, 2, 0, 5, "")]
    d = spark.createDataFrame([("d", p, "SINFO", t, s, a, v) for p, t, s, a, v in rows], "disc_id string, pos int, kind string, title_id int, stream_id int, attr int, value string")
    tracks = S.scan_tracks(d)
    got = {(r.title_id, r.stream_id): (r.ord, r.type, r.name, r.language, r.channels, r.attributes) for r in tracks.collect()}
    assert got == {(1, 0): (1, "audio", "", "eng", 6, {1: "Audio", 3: "fra", 14: "x", 28: "ENG", 30: "old"}), (1, 4): (0, "video", "", "", 0, {1: "Video"}), (2, 0): (0, "unknown", "", "", 0, None)}
    assert tracks._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
