"""Views over the driver tables in the columns the operators expect, each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogops.operators.skew import dealt_by_text, parts_by_rows
from catalogops.operators.tasks import STAGES
from catalogops.plans.registry import Tables

STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
STAGE_ARRAY = "array(" + ", ".join(f"'{s}'" for s in STAGES) + ")"

SQL = {
    "v_log": """SELECT event_id AS seq, ts, user_id AS item_id,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS level,
  event_type, event_type AS decision_type, cast(props->>'$.k' AS INTEGER) % 3 AS decision_result, value AS duration, props FROM events""",
    "v_stage_log": f"""SELECT event_id AS seq, ts, user_id AS item_id, {STAGE_LIST}[user_id % 8 + 1] AS stage, value - 20 AS duration,
  CASE event_type WHEN 'view' THEN 'stage_start' WHEN 'purchase' THEN 'stage_complete' ELSE event_type END AS event_type FROM events""",
    "v_items": f"""SELECT o_orderkey AS item_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'completed' ELSE {STAGE_LIST}[o_orderkey % 8 + 1] END AS stage,
  o_orderkey % 7 = 0 AS user_stopped, o_orderkey % 4 = 0 AS in_progress,
  CASE o_orderkey % 3 WHEN 0 THEN 'encoding' WHEN 1 THEN 'unknown text' ELSE '' END AS failed_at_stage,
  CASE WHEN o_orderstatus = 'F' THEN 'broken' ELSE '' END AS error_message, o_orderkey % 5 = 0 AS needs_review,
  CASE o_orderkey % 5 WHEN 0 THEN '["Low confidence","' || o_orderpriority || '","Gap"]' WHEN 1 THEN '["' || o_orderpriority || '"]'
    WHEN 2 THEN 'not json' ELSE '' END AS review_reason,
  CASE WHEN o_orderkey % 6 = 0 THEN ' Disc ' || o_custkey || ' ' ELSE '' END AS title,
  CASE o_orderkey % 6 WHEN 1 THEN '{{"display_title":"Film ' || o_custkey || '","year":"1999"}}' WHEN 2 THEN '{{"display_title":"Film (2001)","year":"2001"}}'
    WHEN 3 THEN '{{"show_title":"Show ' || o_custkey || '","season_number":2}}' WHEN 4 THEN '{{"title":"Plain","year":""}}' ELSE '' END AS metadata,
  CASE WHEN o_orderkey % 2 = 0 THEN 'tv' ELSE 'movie' END AS media_type, CASE WHEN o_orderkey % 3 = 0 THEN 'dvd' ELSE 'bluray' END AS disc_source
  FROM orders""",
    "v_members": """SELECT l_orderkey AS item_id, ord, l_linenumber AS number, l_quantity, l_returnflag, l_linestatus, l_shipdate, l_partkey,
  l_extendedprice, l_tax, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord FROM lineitem)""",
    "v_tasks": f"""SELECT item_id, item_id * 100 + ord AS task_id, ord, {STAGE_LIST}[(ord - 1) % 8 + 1] AS type, number,
  CASE WHEN l_linestatus = 'F' THEN 'done' WHEN l_returnflag = 'R' THEN 'running' ELSE 'pending' END AS state,
  CASE WHEN ord > 1 THEN [item_id * 100 + ord - 1] ELSE [] END AS deps, l_quantity * 2.5 AS percent, l_tax > 0.05 AS skipped,
  l_shipdate AS started_at, CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 1 MINUTE * ((l_quantity - 5)::INT) END AS finished_at FROM v_members""",
}
NEEDS = {"v_tasks": ("v_members",)}


def with_views(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` for the named views and what they build on."""
    todo: list[str] = []
    for name in names:
        for dep in (*NEEDS.get(name, ()), name):
            if dep not in todo:
                todo.append(dep)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in todo)


def log(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    level = (F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN")
             .when(F.col("event_type") == "click", "DEBUG").otherwise("INFO"))
    return t.events.select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("item_id"), level.alias("level"), "event_type",
        F.col("event_type").alias("decision_type"), (k % 3).alias("decision_result"), F.lit("").alias("decision_reason"),
        F.col("value").alias("duration"), F.lit("").alias("msg"), F.from_json("props", "map<string,string>").alias("fields"), "props")


def stage_log(t: Tables) -> DataFrame:
    kind = (F.when(F.col("event_type") == "view", "stage_start").when(F.col("event_type") == "purchase", "stage_complete")
            .otherwise(F.col("event_type")))
    return t.events.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("item_id"),
                           F.expr(f"{STAGE_ARRAY}[user_id % 8]").alias("stage"), (F.col("value") - 20).alias("duration"), kind.alias("event_type"))


def items(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey AS item_id", "o_orderdate AS created_at",
        f"CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'completed' ELSE {STAGE_ARRAY}[cast(o_orderkey % 8 AS int)] END AS stage",
        "o_orderkey % 7 = 0 AS user_stopped", "o_orderkey % 4 = 0 AS in_progress",
        "CASE o_orderkey % 3 WHEN 0 THEN 'encoding' WHEN 1 THEN 'unknown text' ELSE '' END AS failed_at_stage",
        "CASE WHEN o_orderstatus = 'F' THEN 'broken' ELSE '' END AS error_message", "o_orderkey % 5 = 0 AS needs_review",
        """CASE o_orderkey % 5 WHEN 0 THEN '["Low confidence","' || o_orderpriority || '","Gap"]' WHEN 1 THEN '["' || o_orderpriority || '"]'
           WHEN 2 THEN 'not json' ELSE '' END AS review_reason""",
        "CASE WHEN o_orderkey % 6 = 0 THEN ' Disc ' || o_custkey || ' ' ELSE '' END AS title",
        """CASE o_orderkey % 6 WHEN 1 THEN '{"display_title":"Film ' || o_custkey || '","year":"1999"}'
           WHEN 2 THEN '{"display_title":"Film (2001)","year":"2001"}' WHEN 3 THEN '{"show_title":"Show ' || o_custkey || '","season_number":2}'
           WHEN 4 THEN '{"title":"Plain","year":""}' ELSE '' END AS metadata""",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'tv' ELSE 'movie' END AS media_type",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'dvd' ELSE 'bluray' END AS disc_source")


def members(t: Tables) -> DataFrame:
    """Order lines with a position: (order, line number) is not unique in the data, so all columns break ties."""
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return t.lineitem.withColumn("ord", F.row_number().over(w)).select(
        F.col("l_orderkey").alias("item_id"), "ord", F.col("l_linenumber").alias("number"), "l_quantity", "l_returnflag", "l_linestatus",
        "l_shipdate", "l_partkey", "l_extendedprice", "l_tax", "l_suppkey")


def tasks(t: Tables) -> DataFrame:
    return members(t).selectExpr(
        "item_id", "item_id * 100 + ord AS task_id", "ord", f"{STAGE_ARRAY}[cast((ord - 1) % 8 AS int)] AS type", "number",
        "CASE WHEN l_linestatus = 'F' THEN 'done' WHEN l_returnflag = 'R' THEN 'running' ELSE 'pending' END AS state",
        "CASE WHEN ord > 1 THEN array(item_id * 100 + ord - 1) ELSE cast(array() AS array<bigint>) END AS deps",
        "l_quantity * 2.5 AS percent", "l_tax > 0.05 AS skipped", "l_shipdate AS started_at",
        "CASE WHEN l_linestatus = 'F' THEN l_shipdate + make_dt_interval(0, 0, cast(l_quantity - 5 AS int)) END AS finished_at")


def stamp(c: str, name: str | None = None):
    """Timestamp as text, so that both engines show the same value."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or c)


def stamp_sql(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {name or c}"


def cue_end(start, text):
    return start + F.least(F.lit(9.5), F.length(text) / 60.0)


def cues(t: Tables) -> DataFrame:
    """Conversation turns as cues, one every ten seconds."""
    start = F.col("turn") * 10.0
    return t.conversations.select(F.col("conv_id").alias("track"), F.col("turn").alias("idx"), start.alias("start"),
                                  cue_end(start, "text").alias("end"), "text")


def lines(t: Tables) -> DataFrame:
    """Document lines as cues: longer tracks than conversations, with promotional and empty lines."""
    d = dealt_by_text(t.documents.select("doc_id", "text"), "text", "doc_id").select(F.col("doc_id").alias("track"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    start = F.col("idx") * 10.0
    return d.select("track", F.col("idx").cast("long").alias("idx"), start.alias("start"), cue_end(start, "text").alias("end"), "text")


def drifted(cues_df: DataFrame) -> DataFrame:
    """Every fifth cue removed, the others late by 0.3 s and 0.1 %."""
    late = F.lit(0.3) + F.lit(0.001) * F.col("start")
    return (cues_df.filter("idx % 5 <> 4")
            .select("track", "idx", (F.col("start") + late).alias("start"), (F.col("end") + late).alias("end"), "text"))


SQL["v_cues"] = """SELECT conv_id AS track, turn AS idx, turn * 10.0::DOUBLE AS start, turn * 10.0::DOUBLE + least(9.5::DOUBLE, length(text) / 60.0::DOUBLE) AS "end", text FROM conversations"""
SQL["v_lines"] = """SELECT track, idx, idx * 10.0::DOUBLE AS start, idx * 10.0::DOUBLE + least(9.5::DOUBLE, length(text) / 60.0::DOUBLE) AS "end", text FROM (
  SELECT doc_id AS track, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS idx FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
SQL["v_lines_b"] = """SELECT track, idx, start + (0.3::DOUBLE + 0.001::DOUBLE * start) AS start, "end" + (0.3::DOUBLE + 0.001::DOUBLE * start) AS "end", text FROM v_lines WHERE idx % 5 <> 4"""
SQL["v_cues_b"] = SQL["v_lines_b"].replace("v_lines", "v_cues")
NEEDS["v_lines_b"] = ("v_lines",)
NEEDS["v_cues_b"] = ("v_cues",)


def titles(t: Tables) -> DataFrame:
    """Order lines as disc titles: the line number's bits are the segments, the length follows their count."""
    bits = ", ".join(f"CASE WHEN number & {1 << i} <> 0 THEN '{i + 1}' END" for i in range(3))
    return members(t).selectExpr(
        "item_id AS disc", "ord AS title_id", "ord AS pos", "cast(1200 * bit_count(number) + l_quantity AS int) AS duration", "l_suppkey % 5 AS chapters",
        "CASE l_returnflag WHEN 'R' THEN '0080' || number || '.mpls' WHEN 'N' THEN '00123.mpls' ELSE '12.m2ts' END AS playlist",
        "l_suppkey % 4 AS segment_count", f"concat_ws(',', {bits}) AS segment_map", "'h' || (l_suppkey % 3) AS title_hash",
        "CASE WHEN item_id % 2 = 0 THEN 'bluray' ELSE 'dvd' END AS source")


SQL["v_titles"] = """SELECT item_id AS disc, ord AS title_id, ord AS pos, (1200 * bit_count(number) + l_quantity)::INT AS duration, l_suppkey % 5 AS chapters,
  CASE l_returnflag WHEN 'R' THEN '0080' || number || '.mpls' WHEN 'N' THEN '00123.mpls' ELSE '12.m2ts' END AS playlist, l_suppkey % 4 AS segment_count,
  concat_ws(',', CASE WHEN number & 1 <> 0 THEN '1' END, CASE WHEN number & 2 <> 0 THEN '2' END, CASE WHEN number & 4 <> 0 THEN '3' END) AS segment_map,
  'h' || (l_suppkey % 3) AS title_hash, CASE WHEN item_id % 2 = 0 THEN 'bluray' ELSE 'dvd' END AS source FROM v_members"""
NEEDS["v_titles"] = ("v_members",)


def expected_episodes(t: Tables) -> DataFrame:
    """Three to five expected runtimes per disc, from the order's customer and price."""
    return t.orders.select(F.col("o_orderkey").alias("disc"), F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 3).cast("int"))).alias("ord"),
                           (F.col("o_custkey") % 25 + 10).cast("int").alias("base")).select("disc", "ord", (F.col("base") + F.col("ord") * 2).alias("runtime"))


SQL["v_expected"] = """SELECT disc, ord, base + ord * 2 AS runtime FROM (SELECT o_orderkey AS disc, unnest(range(1, o_orderkey % 3 + 4)) AS ord, o_custkey % 25 + 10 AS base FROM orders)"""


#: Rows whose JSON document one task writes: about a second.
DOCUMENT_ROWS = 20_000


def with_document(rows: DataFrame, key: str, column: str, doc: str, *others: str) -> DataFrame:
    """`rows` dealt out by `key`, with `doc` as `column`, written once for each row.

    The document comes out of a generator, so filters on it stay above it; they would else be moved to the few tasks that read the table
    and write it there once more.
    """
    d = rows.repartition(parts_by_rows(rows, DOCUMENT_ROWS), key)
    return d.select("*", F.inline_outer(F.array(F.struct(F.expr(doc).alias(column))))).selectExpr(*others)


def envelopes(t: Tables) -> DataFrame:
    """Orders as items with a version-1 JSON document written inside the row."""
    k = "o_orderkey"
    ep = f"""transform(sequence(1, cast({k} % 4 + 1 AS int)), i -> named_struct('key', if(i = 2, 'S01_002', 's01_' || lpad(i, 3, '0')), 'title_id', i, 'season', 1,
      'episode', CASE WHEN ({k} + i) % 5 = 0 THEN 0 ELSE i + if({k} % 7 = 0 AND i > 1, 1, 0) END, 'runtime_seconds', if(i = 1, 0, 900), 'match_confidence', (({k} * 7 + i * 13) % 100) / 100.0D,
      'needs_review', ({k} + i) % 6 = 0))"""
    ti = f"transform(sequence(1, cast({k} % 4 + 1 AS int)), i -> named_struct('id', i, 'name', 'T' || i, 'duration', 1000 + i))"

    def assets(kind: str, keep: str, fail: str, path: str) -> str:
        return (f"transform(filter(sequence(1, cast({k} % 4 + 1 AS int)), i -> {keep}), i -> named_struct('episode_key', 's01_' || lpad(i, 3, '0'), 'title_id', i, "
                f"'path', {path}, 'status', if({fail}, 'failed', 'completed'), 'error_msg', if({fail}, 'bad {kind}', '')))")

    review = f"if(({k} + i) % 6 = 0 OR {k} % 10 = 3, '/review/', '/library/') || {k} || '/' || i"
    doc = (f"to_json(named_struct('version', if({k} % 50 = 0, 2, 1), 'metadata', named_struct('media_type', if({k} % 2 = 0, 'tv', 'movie')), 'titles', {ti}, 'episodes', {ep}, 'assets', named_struct("
           f"'ripped', {assets('rip', 'true', 'false', f'''{k!s} || '-' || i''')}, 'encoded', {assets('encode', 'i < 4', f'({k} + i) % 9 = 0', f'''{k!s} || '-' || i || '.mkv' ''')}, "
           f"'final', {assets('final', f'({k} + i) % 8 <> 0', 'false', review)})))")
    return with_document(t.orders, k, "rip_spec_data", f"CASE WHEN {k} % 50 = 1 THEN ' ' ELSE {doc} END", "o_orderkey AS item_id", "rip_spec_data", f"{k} % 5 = 0 AS needs_review",
                         "'/review' AS review_dir", "'/library/' AS library_dir", f"if({k} % 2 = 0, 'tv', 'movie') AS media_type")


SQL["v_eps"] = """SELECT k AS item_id, i - 1 AS pos, CASE WHEN i = 2 THEN 'S01_002' ELSE printf('s01_%03d', i) END AS key, i AS title_id, CASE WHEN (k + i) % 5 = 0 THEN 0 ELSE i + CASE WHEN k % 7 = 0 AND i > 1 THEN 1 ELSE 0 END END AS episode,
  ((k * 7 + i * 13) % 100) / 100.0::DOUBLE AS conf, (k + i) % 6 = 0 AS needs_review, CASE WHEN k % 2 = 0 THEN 'tv' ELSE 'movie' END AS media_type
  FROM (SELECT o_orderkey AS k, unnest(range(1, o_orderkey % 4 + 2)) AS i FROM orders WHERE o_orderkey % 50 > 1)"""
SQL["v_assets"] = """SELECT k AS item_id, 'ripped' AS kind, i, printf('s01_%03d', i) AS key, 'completed' AS status, k || '-' || i AS path FROM ki UNION ALL
  SELECT k, 'encoded', i, printf('s01_%03d', i), CASE WHEN (k + i) % 9 = 0 THEN 'failed' ELSE 'completed' END, k || '-' || i || '.mkv' FROM ki WHERE i < 4 UNION ALL
  SELECT k, 'final', i, printf('s01_%03d', i), 'completed', CASE WHEN (k + i) % 6 = 0 OR k % 10 = 3 THEN '/review/' ELSE '/library/' END || k || '/' || i FROM ki WHERE (k + i) % 8 <> 0"""
SQL["ki"] = "SELECT o_orderkey AS k, unnest(range(1, o_orderkey % 4 + 2)) AS i FROM orders WHERE o_orderkey % 50 > 1"
NEEDS["v_assets"] = ("ki",)


def probes(t: Tables) -> DataFrame:
    """Orders as probed files: a JSON probe with video, two audio streams and a subtitle, written inside the row."""
    k = "o_orderkey"
    dur = "o_totalprice / 50"
    doc = f"""to_json(named_struct('format', named_struct('duration', if({k} % 19 = 0, 'N/A', cast({dur} AS string)), 'size', cast(cast(o_totalprice * 100 AS bigint) AS string)), 'streams', filter(array(
      named_struct('index', 0, 'codec_name', if({k} % 2 = 0, 'h264', 'hevc'), 'codec_type', if({k} % 23 = 0, 'data', 'video'), 'start_time', cast(({k} % 5) / 10.0D AS string), 'duration', cast(null AS string), 'width', if({k} % 3 = 0, 3840, 1920), 'height', if({k} % 3 = 0, 2160, 1080),
        'channels', 0, 'channel_layout', '', 'color_transfer', if({k} % 7 = 0, 'SMPTE2084', 'bt709'), 'tags', map('k', 'v'), 'disposition', map('default', 1), 'side_data_list', if({k} % 11 = 0, array(named_struct('side_data_type', 'Mastering display metadata')), null)),
      named_struct('index', 1, 'codec_name', 'ac3', 'codec_type', 'audio', 'start_time', cast(({k} % 5) / 10.0D + ({k} % 13) / 50.0D AS string), 'duration', cast({dur} - {k} % 17 AS string), 'width', 0, 'height', 0, 'channels', 6, 'channel_layout', '5.1(side)', 'color_transfer', '',
        'tags', map('language', if({k} % 4 = 0, 'fre', 'eng')), 'disposition', map('default', cast({k} % 3 = 0 AS int)), 'side_data_list', null),
      named_struct('index', 2, 'codec_name', if({k} % 5 = 0, 'truehd', 'aac'), 'codec_type', 'audio', 'start_time', '0', 'duration', cast({dur} / if({k} % 9 = 0, 3, 1.25D) AS string), 'width', 0, 'height', 0, 'channels', if({k} % 6 = 0, 0, 2), 'channel_layout', '7.1', 'color_transfer', '',
        'tags', map('LANGUAGE', 'English', 'title', if({k} % 8 = 0, 'Director Commentary', '')), 'disposition', map('default', cast({k} % 3 = 1 AS int), 'comment', cast({k} % 16 < 9 AND {k} % 8 = 0 OR {k} % 8 = 1 AS int)), 'side_data_list', null),
      named_struct('index', 3, 'codec_name', 'subrip', 'codec_type', 'subtitle', 'start_time', '0', 'duration', cast(null AS string), 'width', 0, 'height', 0, 'channels', 0, 'channel_layout', '', 'color_transfer', '',
        'tags', map('language', 'eng', 'title', CASE {k} % 3 WHEN 0 THEN 'English' WHEN 1 THEN 'English (Forced)' ELSE '' END), 'disposition', map('forced', cast({k} % 12 < 2 AS int)), 'side_data_list', null)),
      s -> NOT (s.index = 2 AND {k} % 10 = 9) AND NOT (s.index = 3 AND {k} % 2 = 1))))"""
    return with_document(t.orders, k, "probe", doc, "o_orderkey AS item_id", "'main' AS key", f"if({k} % 29 = 0, '', '/m/' || {k}) AS path", "probe")
