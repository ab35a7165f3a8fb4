"""Queries of the source parsers: their text inputs are written from the tables inside each row."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.functions import aspect, paths, times
from catalogops.functions import titles as X
from catalogops.plans import views as V
from catalogops.plans.registry import query
from catalogops.plans.views import with_views
from catalogops.sources import catalogues as C
from catalogops.sources import files as FS
from catalogops.sources import logs as LG
from catalogops.sources import scans as S
from catalogops.session import work_folder

LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END"


def log_lines(t):
    """One JSON line per event; every seventh is cut off, some times are bad, some ids are text."""
    iso = F.when(F.col("event_id") % 11 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    doc = F.to_json(F.struct(iso.alias("time"), F.expr(LEVEL).alias("level"), F.lit("m").alias("msg"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("item_id"),
                             F.col("event_type"), F.when(F.col("event_id") % 3 == 0, "1m2.5s").otherwise("1500ms").alias("stage_duration"), F.from_json("props", "struct<k:int>").alias("nested")))
    text = F.when(F.col("event_id") % 5 == 0, F.regexp_replace(doc, r"\}$", F.concat(F.lit(',"item_id":"'), F.col("user_id").cast("string"), F.lit('"}')))).otherwise(doc)
    return t.events.repartition("event_id").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value"))


@query("parse_log_lines", f"""SELECT event_id AS seq, CASE WHEN event_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts, {LEVEL} AS level, CASE WHEN event_id % 5 <> 0 THEN user_id END AS item_id, event_type,
  CASE WHEN event_id % 3 = 0 THEN 62.5 ELSE 1.5 END AS duration, '{{"k":' || (props->>'$.k') || '}}' AS nested FROM events WHERE event_id % 7 <> 0""")
def parse_log(t):
    d = LG.parse_log_lines(log_lines(t))
    return d.select("seq", V.stamp("ts"), "level", "item_id", "event_type", "duration", F.col("fields")["nested"].alias("nested"))


@query("unparsable_report", "SELECT 'lines' AS what, count(*) AS n FROM events UNION ALL SELECT 'events', count(*) FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT 'untimed', count(*) FROM events WHERE event_id % 7 <> 0 AND event_id % 11 = 0")
def unparsable(t):
    lines = log_lines(t)
    return LG.unparsable_report(lines, LG.parse_log_lines(lines))


@query("parse_key_catalogue", """WITH l AS (SELECT p_partkey AS pos, sha1(p_name) AS id, CASE p_partkey % 5 WHEN 0 THEN 'Foo [' || p_name || ']' WHEN 1 THEN p_name || ' (' || p_name || ')' WHEN 2 THEN 'BIG_' || upper(replace(p_name, ' ', '_')) || ' (' || p_name || ')' WHEN 3 THEN 'JFK (Cut)' ELSE p_name || ' []' END AS raw,
  CASE p_partkey % 5 WHEN 3 THEN 'JFK (Cut)' ELSE p_name END AS title FROM part WHERE p_partkey % 6 <> 5) SELECT upper(id) AS disc_id, max_by(title, pos) AS title FROM l GROUP BY id""")
def key_catalogue(t):
    n, k = F.col("p_name"), F.col("p_partkey") % 5
    raw = (F.when(k == 0, F.concat(F.lit("Foo ["), n, F.lit("]"))).when(k == 1, F.concat(n, F.lit(" ("), n, F.lit(")")))
           .when(k == 2, F.concat(F.lit("BIG_"), F.upper(F.regexp_replace(n, " ", "_")), F.lit(" ("), n, F.lit(")"))).when(k == 3, "JFK (Cut)").otherwise(F.concat(n, F.lit(" []"))))
    line = F.when(F.col("p_partkey") % 12 == 5, F.concat(F.lit("; "), F.sha1("p_name"), F.lit("|x"))).when(F.col("p_partkey") % 12 == 11, F.concat(F.lit("abc | "), n)).otherwise(
        F.concat(F.lit(" 0x"), F.sha1("p_name"), F.lit(" | "), raw, F.lit(" | extra | more")))
    return C.parse_key_catalogue(t.part.select(F.col("p_partkey").alias("pos"), line.alias("value")))


@query("parse_key_value_reports", """SELECT c_custkey AS report_id, upper(sha1(c_name)) AS disc_id, 'VOL_' || (1990 + c_custkey % 30) AS volume_id, CASE WHEN c_custkey % 3 = 0 THEN 'Film ' || (2000 + c_custkey % 20) || ' cut' ELSE c_name END AS disc_name, c_custkey % 2 = 0 AS is_bluray,
  CASE c_custkey % 4 WHEN 0 THEN 'Sony Home' WHEN 1 THEN 'abc' WHEN 2 THEN c_mktsegment ELSE 'MGM: x' END AS provider, CASE c_custkey % 4 WHEN 0 THEN 'Sony Pictures' WHEN 1 THEN '' WHEN 2 THEN c_mktsegment ELSE 'Metro-Goldwyn-Mayer' END AS studio,
  CASE WHEN c_custkey % 3 = 0 THEN (2000 + c_custkey % 20)::VARCHAR ELSE (1990 + c_custkey % 30)::VARCHAR END AS year FROM customer""")
def reports(t):
    k = F.col("c_custkey")
    prov = F.when(k % 4 == 0, "Sony Home").when(k % 4 == 1, "abc").when(k % 4 == 2, F.col("c_mktsegment")).otherwise("MGM: x")
    name = F.when(k % 3 == 0, F.concat(F.lit("Film "), (k % 20 + 2000).cast("string"), F.lit(" cut"))).otherwise(F.col("c_name"))
    text = F.concat(F.lit("junk\nDisc ID: old\n Disc ID : "), F.sha1("c_name"), F.lit("\nVolume Identifier: VOL_"), (k % 30 + 1990).cast("string"), F.lit("\nDisc Title: first\nDisc Name: "), name,
                    F.lit("\nBluRay detected: "), F.when(k % 2 == 0, "Yes").otherwise("no"), F.lit("\nProvider data: "), prov, F.lit("\n"))
    return C.parse_key_value_reports(t.customer.select(k.alias("report_id"), text.alias("text"))).drop("has_aacs")


@query("flatten_hits", """SELECT p_partkey AS id, p_size AS downloads, p_partkey % 2 = 0 AS hearing_impaired, i AS file_id, CASE WHEN i IS NOT NULL THEN p_name || i END AS file_name FROM part
LEFT JOIN (SELECT p_partkey AS k, unnest(range(1, p_partkey % 3 + 1)) AS i FROM part) ON k = p_partkey""")
def hits(t):
    files = "transform(filter(sequence(0, cast(p_partkey % 3 AS int)), i -> i > 0), i -> named_struct('file_id', cast(i AS bigint), 'file_name', p_name || i))"
    h = t.part.selectExpr("p_partkey AS id", f"named_struct('release', p_name, 'language', 'en', 'download_count', p_size, 'hearing_impaired', p_partkey % 2 = 0, 'foreign_parts_only', false, 'files', {files}) AS attributes")
    return C.flatten_hits(h).select("id", "downloads", "hearing_impaired", "file_id", "file_name")


@query("lookup_identity", """WITH c AS (SELECT sha1(p_name) AS id, min(p_name) AS title FROM part GROUP BY 1) SELECT o_orderkey AS item_id, coalesce(c.title, CASE WHEN o_orderkey % 3 = 0 THEN 'Report ' || o_custkey END, CASE WHEN o_orderkey % 5 = 0 THEN 'Scan ' || o_custkey END, CASE WHEN o_orderkey % 7 = 0 THEN 'Label' END, 'Unknown Disc') AS title,
  CASE WHEN c.title IS NOT NULL THEN 'catalogue' WHEN o_orderkey % 3 = 0 THEN 'report' WHEN o_orderkey % 5 = 0 THEN 'scan' WHEN o_orderkey % 7 = 0 THEN 'label' ELSE 'fallback' END AS source
FROM orders LEFT JOIN part ON p_partkey = o_custkey * 9 LEFT JOIN c ON c.id = sha1(p_name)""")
def lookup(t):
    k = F.col("o_orderkey")
    ids = t.part.select((F.col("p_partkey")).alias("pk"), F.concat(F.lit("0X"), F.sha1("p_name")).alias("disc_id"))
    items = t.orders.join(ids, F.col("pk") == F.col("o_custkey") * 9, "left").select(
        k.alias("item_id"), "disc_id", F.when(k % 3 == 0, F.concat(F.lit("Report "), F.col("o_custkey").cast("string"))).alias("report_name"),
        F.when(k % 5 == 0, F.concat(F.lit("Scan "), F.col("o_custkey").cast("string"))).otherwise("").alias("scan_name"), F.when(k % 7 == 0, "Label").alias("label"))
    cat = t.part.groupBy(F.upper(F.sha1("p_name")).alias("disc_id")).agg(F.min("p_name").alias("title"))
    return C.lookup_identity(items, cat)


def scan_lines(t):
    """Order lines as scan output: title lines, two streams each, a disc line and noise."""
    m = V.members(t)
    i = "item_id"
    lines = F.array(
        F.concat(F.lit('TINFO:'), F.col("ord"), F.lit(',2,0,"Title, '), F.col("ord"), F.lit('"')), F.concat(F.lit("TINFO:"), F.col("ord"), F.lit(',9,0,"0:'), F.lpad(F.col("number").cast("string"), 2, "0"), F.lit(':05"')),
        F.concat(F.lit("TINFO:"), F.col("ord"), F.lit(',8,0,"'), F.col("l_suppkey"), F.lit('"')), F.concat(F.lit("TINFO:"), F.col("ord"), F.lit(',26,0,"1,2,'), F.col("number"), F.lit('"')),
        F.concat(F.lit("SINFO:"), F.col("ord"), F.lit(',0,1,6201,"Video"')), F.concat(F.lit("SINFO:"), F.col("ord"), F.lit(',1,1,6202,"Audio"')), F.concat(F.lit("SINFO:"), F.col("ord"), F.lit(',1,3,0,"ENG"')),
        F.concat(F.lit("SINFO:"), F.col("ord"), F.lit(',1,14,0,"'), F.col("number"), F.lit('"')), F.concat(F.lit('CINFO:2,0,"Disc '), F.col(i), F.lit('"')), F.lit('MSG:1005,0,1,"started"'), F.lit("no prefix"))
    return m.select(F.col(i).alias("disc_id"), (F.col("ord") * 100).alias("base"), F.posexplode(lines).alias("p", "line")).select("disc_id", (F.col("base") + F.col("p")).alias("pos"), "line")


@query("scan_titles", f"""{with_views('v_members')} SELECT item_id AS disc_id, ord AS title_id, 'Title, ' || ord AS name, number * 60 + 5 AS duration, l_suppkey AS chapters, '1,2,' || number AS segment_map FROM v_members""")
def scan_titles(t):
    return S.scan_titles(S.split_scan_lines(scan_lines(t))).select("disc_id", "title_id", "name", "duration", "chapters", "segment_map")


@query("scan_tracks", f"""{with_views('v_members')} SELECT item_id AS disc_id, ord AS title_id, s AS stream_id, s AS ord, CASE s WHEN 0 THEN 'video' ELSE 'audio' END AS type, CASE s WHEN 0 THEN '' ELSE 'eng' END AS language, CASE s WHEN 0 THEN 0 ELSE number END AS channels,
  CASE s WHEN 0 THEN 1 ELSE 3 END AS n_attributes FROM v_members, (VALUES (0), (1)) x(s)""")
def scan_tracks(t):
    return S.scan_tracks(S.split_scan_lines(scan_lines(t))).select("disc_id", "title_id", "stream_id", "ord", "type", "language", "channels", F.size("attributes").alias("n_attributes"))


@query("disc_names", "SELECT l_orderkey AS disc_id, 'Disc ' || l_orderkey AS name FROM lineitem GROUP BY l_orderkey")
def disc_names(t):
    return S.disc_names(S.split_scan_lines(scan_lines(t)))


HASH_SQL = " || chr(0) || ".join(["'title, ' || ord", "(number * 60 + 5)", "'1,2,' || number", "'0'", "'0'", "'video'", "''", "''", "''", "''", "''", "''", "'0'", "''", "''", "'1'", "'video'",
                                   "'1'", "'1'", "'audio'", "''", "''", "''", "'eng'", "''", "''", "number", "''", "''", "'1'", "'audio'", "'3'", "'eng'", "'14'", "number"])


@query("title_hashes", f"""{with_views('v_members')} SELECT item_id AS disc_id, ord AS title_id, sha256({HASH_SQL} || chr(0)) AS title_hash FROM v_members""")
def title_hashes(t):
    s = S.split_scan_lines(scan_lines(t))
    return S.title_hashes(S.scan_titles(s), S.scan_tracks(s)).select("disc_id", "title_id", "title_hash")


def _files(t):
    return t.documents.select("lang", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("size"),
                              F.encode("text", "UTF-8").alias("content"), F.col("doc_id").alias("modified")).withColumnRenamed("lang", "name")


@query("directory_inventory", "SELECT lang AS name, sum(octet_length(encode(text)))::BIGINT AS bytes, max(doc_id) AS modified, count(*) AS files FROM documents GROUP BY lang")
def inventory(t):
    return FS.directory_inventory(_files(t))


@query("manifest_hash", """WITH f AS (SELECT lang AS name, 'docs/' || doc_id || '.txt' AS path, octet_length(encode(text)) AS size, sha256(text) AS h FROM documents),
b AS (SELECT name, substr(md5(path), 1, 3) AS bucket, sha256(string_agg('{"path":"' || path || '","size":' || size || ',"h":"' || h || '"}', chr(10) ORDER BY path)) AS bh, count(*) AS n FROM f GROUP BY ALL)
SELECT name, sha256(string_agg('{"bucket":"' || bucket || '","bh":"' || bh || '"}', chr(10) ORDER BY bucket)) AS manifest, sum(n)::BIGINT AS files FROM b GROUP BY name""")
def manifest(t):
    return FS.manifest_hash(_files(t))


@query("route", """SELECT d.doc_id, CASE WHEN coalesce(quality > 0 AND NOT (toxic = 1), false) THEN 'library' ELSE 'review' END AS destination,
  CASE WHEN NOT coalesce(quality > 0 AND NOT (toxic = 1), false) THEN CASE WHEN quality IS NULL THEN 'manual-review' ELSE 'low-quality-' || source END || '_' || CASE WHEN d.doc_id % 2 = 0 THEN substr(sha256(text), 1, 8) ELSE 'id' || d.doc_id END END AS folder
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def routed(t):
    """Written by destination and read back."""
    d = t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"), F.col("quality").alias("number"), (F.coalesce("toxic", F.lit(0)) == 1).alias("needs_review"),
        F.when(F.col("quality").isNotNull(), F.concat(F.lit("low: quality/"), "source")).alias("reason"), F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise("").alias("fingerprint"))
    folder = work_folder(t.spark, "routed")
    FS.write_routed(d, folder)
    return t.spark.read.parquet(folder).select(F.col("item_id").alias("doc_id"), "destination", "folder")


@query("sanitise_names", r"""SELECT page_id, CASE WHEN d = '' THEN 'manual-import' ELSE d END AS display, CASE WHEN s = '' THEN 'queue' ELSE s END AS segment FROM (SELECT page_id,
  trim(regexp_replace(regexp_replace(regexp_replace(url, '[:/\\]', ' ', 'g'), '[?"<>|*]', '', 'g'), '\s{2,}', ' ', 'g'), ' ') AS d,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[/\\:*]', '-', 'g'), '[?"<>|]', '', 'g'), '\s+', '-', 'g'), '-{2,}', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS s FROM pages)""")
def sanitise(t):
    return t.pages.select("page_id", paths.display_segment(F.col("url")).alias("display"), paths.path_segment(F.col("url")).alias("segment"))


@query("truncate_bytes", "SELECT doc_id, octet_length(encode(cut)) <= 96 AS fits, length(cut) AS chars FROM (SELECT doc_id, CASE WHEN octet_length(encode(s)) <= 96 THEN s ELSE regexp_replace(list_filter(list_transform(range(96, 0, -1), lambda n: substr(s, 1, n)), lambda x: octet_length(encode(x)) <= 96)[1], '^[-_]+|[-_]+$', '', 'g') END AS cut FROM (SELECT doc_id, substr(text, 1, 200) AS s FROM documents))")
def truncate(t):
    """A name of 200 characters cut to the byte limit of review folders."""
    cut = paths.truncate_bytes(F.substring("text", 1, 200), paths.REVIEW_BYTES)
    return t.documents.select("doc_id", (F.octet_length(cut) <= 96).alias("fits"), F.length(cut).alias("chars"))


PATHS = """p AS (SELECT l_orderkey, l_linenumber, '/lib/Show [tmdbid-' || (l_orderkey + 1) || ']/' || CASE WHEN l_linenumber > 5 THEN 'x' ELSE 'Season ' || printf('%02d', l_linenumber) END || '/Show' || CASE WHEN l_orderkey % 5 = 0 THEN ' [tmdbid-1]' ELSE '' END || ' - S' ||
  printf('%02d', CASE WHEN l_orderkey % 7 = 0 THEN 9 ELSE l_linenumber END) || CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE 'E' || printf('%02d', l_orderkey % 20 + 1) || CASE WHEN l_orderkey % 3 = 0 THEN '-E' || printf('%02d', l_orderkey % 20 + 2) ELSE '' END END || '.mkv' AS path
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))"""


@query("parse_library_paths", f"""WITH {PATHS}, e AS (SELECT *, CASE WHEN l_orderkey % 5 = 0 AND l_orderkey <> 0 THEN 'conflicting ids' WHEN l_linenumber <= 5 AND l_orderkey % 11 = 0 THEN 'no episode marker' WHEN l_linenumber <= 5 AND l_orderkey % 7 = 0 THEN 'inconsistent episode marker' END AS error FROM p)
SELECT path, error, CASE WHEN error IS NULL THEN l_orderkey + 1 END AS provider_id, CASE WHEN error IS NULL THEN CASE WHEN l_linenumber <= 5 THEN l_linenumber ELSE 0 END END AS season, CASE WHEN error IS NULL THEN CASE WHEN l_linenumber <= 5 THEN l_orderkey % 20 + 1 ELSE 0 END END AS episode,
  CASE WHEN error IS NULL THEN CASE WHEN l_linenumber <= 5 THEN l_orderkey % 20 + 1 + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END END AS episode_end FROM e""")
def library_paths(t):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    season = F.when(n > 5, "x").otherwise(F.format_string("Season %02d", n))
    marker = F.when(k % 11 == 0, "").otherwise(F.concat(F.format_string("E%02d", k % 20 + 1), F.when(k % 3 == 0, F.format_string("-E%02d", k % 20 + 2)).otherwise("")))
    path = F.concat(F.lit("/lib/Show [tmdbid-"), (k + 1).cast("string"), F.lit("]/"), season, F.lit("/Show"), F.when(k % 5 == 0, " [tmdbid-1]").otherwise(""), F.lit(" - S"),
                    F.format_string("%02d", F.when(k % 7 == 0, 9).otherwise(n)), marker, F.lit(".mkv"))
    return paths.parse_library_paths(t.lineitem.select(k, n).distinct().select(path.alias("path"))).drop("found")


@query("plan_library_layout", """WITH d AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN '/library/movies/Film ' || o_custkey || ' (1999)' || CASE WHEN o_custkey > 0 THEN ' [tmdbid-' || o_custkey || ']' ELSE '' END ELSE '/library/tv/Show ' || o_custkey || ' (1999)' || CASE WHEN o_custkey > 0 THEN ' [tmdbid-' || o_custkey || ']' ELSE '' END || '/Season 01' END AS folder,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Film ' || o_custkey || ' (1999)' || CASE WHEN o_custkey > 0 THEN ' [tmdbid-' || o_custkey || ']' ELSE '' END WHEN o_orderkey % 5 = 1 THEN 'Show ' || o_custkey || ' - s01_001' ELSE 'Show ' || o_custkey || ' - S01E' || printf('%02d', o_orderkey % 5 + 1) || CASE WHEN o_orderkey % 3 = 0 THEN '-E' || printf('%02d', o_orderkey % 5 + 2) ELSE '' END END || '.mkv' AS file FROM orders)
SELECT *, count(*) OVER (PARTITION BY folder, file) AS wanted_by FROM d""")
def layout(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    d = t.orders.select(
        k.alias("item_id"), F.when(k % 2 == 0, "Movie").otherwise("tv").alias("media_type"), F.concat(F.lit("Film: "), c).alias("title"), F.concat(F.lit("Show "), c).alias("show_title"), F.lit("1999").alias("year"),
        F.col("o_custkey").alias("provider_id"), F.lit(1).alias("season"), F.when(k % 5 == 1, 0).otherwise(k % 5 + 1).alias("episode"), F.when(k % 3 == 0, k % 5 + 2).otherwise(0).alias("episode_end"), F.lit("s01_001").alias("key"))
    return paths.plan_library_layout(d)


@query("episode_markers", r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '2x3' WHEN 1 THEN '1x12' WHEN 2 THEN '' ELSE '5x1' END AS markers, CASE WHEN p_partkey % 4 = 3 THEN 7 END AS title_id FROM part""")
def markers(t):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat("p_name", F.lit(".S02E03.mkv"))).when(k == 1, "show 1x12 end").when(k == 2, "as02e03b").otherwise("Show.5.01_t07.mkv")
    text = F.array_join(F.transform(X.episode_markers(name), lambda m: F.concat_ws("x", m["season"].cast("string"), m["episode"].cast("string"))), ",")
    return t.part.select("p_partkey", text.alias("markers"), X.file_title_id(name).alias("title_id"))


@query("aspect_report", """SELECT p_partkey, CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE coalesce(CASE WHEN len(b) > 0 THEN list_sort(b)[1][3] END, printf('%.2f:1', r)) END AS aspect, CASE WHEN p_partkey % 10 = 9 THEN 'malformed' ELSE 'ok' END AS status FROM (
  SELECT p_partkey, r, list_filter(list_transform([(1.333, 0, '1.33:1'), (1.778, 1, '1.78:1'), (1.850, 2, '1.85:1'), (2.000, 3, '2.00:1'), (2.200, 4, '2.20:1'), (2.350, 5, '2.35:1'), (2.390, 6, '2.39:1'), (2.400, 7, '2.40:1')], lambda x: (abs(r - x[1]::DOUBLE) / x[1]::DOUBLE, x[2], x[3])), lambda x: x[1] <= 0.02) AS b
  FROM (SELECT p_partkey, round(1920.0::DOUBLE / (700 + p_size * 10), 2) AS r FROM part))""")
def aspects(t):
    f = F.when(F.col("p_partkey") % 10 == 9, "crop=0:0").otherwise(F.concat(F.when(F.col("p_partkey") % 2 == 0, "crop=").otherwise(""), F.lit("1920:"), (F.col("p_size") * 10 + 700).cast("string"), F.lit(":0:0")))
    return aspect.aspect_report(t.part.select("p_partkey", f.alias("crop_filter"))).select("p_partkey", "aspect", "status")


@query("type_event_fields", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN event_id * 1.0 WHEN 2 THEN 3600.0 + (event_id % 60) * 60 ELSE 0 END AS seconds, CASE WHEN event_id % 3 = 2 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') END AS at FROM events""")
def type_fields(t):
    k = F.col("event_id")
    dur = (F.when(k % 4 == 0, F.concat(F.format_string("%.2f", "value"), F.lit("s"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit("000000000")))
           .when(k % 4 == 2, F.concat(F.lit("1h"), (k % 60).cast("string"), F.lit("m"))).otherwise("soon"))
    when = F.when(k % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("bad")
    d = t.events.select("event_id", F.round(times.log_duration_seconds(dur), 6).alias("seconds"), times.log_time(when).alias("at"))
    return d.select("event_id", "seconds", V.stamp("at"))


@query("canonical_titles", "SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 AND p_size > 0 THEN ' Season ' || printf('%02d', p_size) ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' (1999)' ELSE '' END AS title FROM part")
def canonical(t):
    y = F.when(F.col("p_partkey") % 3 == 0, "1999").otherwise("")
    kind = F.when(F.col("p_partkey") % 2 == 0, "tv").otherwise("movie")
    return t.part.select("p_partkey", X.canonical_title(F.col("p_name"), y, F.col("p_size"), kind).alias("title"))
