"""Queries of envelopes, probes, audits and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.functions import languages as LG
from catalogops.operators import audit as A
from catalogops.operators import events as E
from catalogops.operators import media as M
from catalogops.operators import ranking as R
from catalogops.operators import retention as RT
from catalogops.operators import tasks as K
from catalogops.plans import views as V
from catalogops.plans.registry import query
from catalogops.plans.views import with_views
from catalogops.session import store

EPS, ASSETS, BOTH = with_views("v_eps"), with_views("v_assets"), with_views("v_eps", "v_assets")
MEMBERS = with_views("v_members")


def parsed(t):
    return A.parse_envelopes(V.envelopes(t))


def stored(t, *parts):
    """`parts` of the envelopes, parsed and written once, for queries that read them more than once."""
    return store(A.parse_envelopes(V.envelopes(t), parts=parts).drop("rip_spec_data"), "envelopes")


@query("explode_envelopes_episodes", f"{EPS} SELECT item_id, key, title_id, episode, conf AS match_confidence, needs_review FROM v_eps")
def env_episodes(t):
    return A.explode_episodes(parsed(t)).select("item_id", "key", "title_id", "episode", "match_confidence", "needs_review")


@query("explode_envelopes_assets", f"{ASSETS} SELECT item_id, kind, key, status, path FROM v_assets")
def env_assets(t):
    return A.explode_assets(parsed(t)).select("item_id", "kind", "key", "status", "path")


@query("explode_envelopes_titles", f"{ASSETS} SELECT k AS item_id, i AS id, 'T' || i AS name, 1000 + i AS duration FROM ki")
def env_titles(t):
    return A.explode_titles(parsed(t)).select("item_id", "id", "name", "duration")


@query("envelope_quarantine", "SELECT o_orderkey AS item_id, 'version' AS env_status FROM orders WHERE o_orderkey % 50 = 0")
def quarantine(t):
    return A.quarantine(parsed(t))


STATS = """st AS (SELECT item_id, count(*) AS episodes, count(*) FILTER (episode > 0) AS matched, count(*) FILTER (episode <= 0) AS unresolved, NOT bool_or(episode > 0 OR conf > 0 OR needs_review) AS placeholder_only,
  min(conf) FILTER (conf > 0) AS confidence_min, max(conf) FILTER (conf > 0) AS confidence_max, round(avg(conf) FILTER (conf > 0), 3) AS confidence_mean, count(*) FILTER (conf > 0 AND conf < 0.9) AS below_090,
  count(*) FILTER (conf > 0 AND conf < 0.8) AS below_080, count(*) FILTER (conf > 0 AND conf < 0.7) AS below_070, count(*) FILTER (needs_review) AS review_episodes,
  coalesce(count(*) FILTER (episode > 0) = count(DISTINCT episode) FILTER (episode > 0) AND max(episode) FILTER (episode > 0) - min(episode) FILTER (episode > 0) = count(*) FILTER (episode > 0) - 1, false) AS contiguous,
  coalesce(min(episode) FILTER (episode > 0) || '-' || max(episode) FILTER (episode > 0), '') AS "range" FROM v_eps GROUP BY item_id)"""


@query("episode_stats", f"{EPS}, {STATS} SELECT * FROM st")
def episode_stats(t):
    return A.episode_stats(A.explode_episodes(stored(t, "episodes")))


@query("asset_health", f"{ASSETS} SELECT item_id, kind, count(*) AS total, count(*) FILTER (status <> 'failed') AS ok, count(*) FILTER (status = 'failed') AS failed, 0::BIGINT AS muxed FROM v_assets GROUP BY ALL")
def asset_health(t):
    return A.asset_health(A.explode_assets(parsed(t)))


@query("best_probe", f"{ASSETS} SELECT item_id, key, kind, path FROM (SELECT *, row_number() OVER (PARTITION BY item_id, key ORDER BY kind <> 'final') AS rn FROM v_assets WHERE status <> 'failed' AND kind <> 'ripped') WHERE rn = 1")
def best_probe(t):
    return R.best_probe(A.explode_assets(parsed(t))).select("item_id", "key", "kind", "path")


ROUTE = """fin AS (SELECT e.*, a.path, a.path IS NOT NULL AS has, e.episode <= 0 OR e.needs_review AS want FROM v_eps e LEFT JOIN (SELECT * FROM v_assets WHERE kind = 'final') a ON a.item_id = e.item_id AND a.key = lower(e.key)),
rt AS (SELECT item_id, count(*) FILTER (NOT want) AS clean, count(*) FILTER (has AND NOT want AND starts_with(path, '/review/')) AS clean_in_review,
  count(*) FILTER (has AND want AND NOT starts_with(path, '/review/')) AS review_in_library, CASE WHEN bool_or(has) THEN count(*) FILTER (NOT has) ELSE 0 END AS missing_final FROM fin WHERE media_type = 'tv' GROUP BY item_id)"""


@query("routing_check", f"""{BOTH}, {ROUTE} SELECT item_id, clean, clean_in_review, CASE WHEN clean_in_review > 0 THEN CASE WHEN clean > 0 AND clean_in_review = clean THEN 'critical' ELSE 'warning' END END AS clean_in_review_severity,
  review_in_library, missing_final FROM rt""")
def routing_check(t):
    p = stored(t, "episodes", "assets")
    return A.routing_check(p.select("item_id", "media_type", "review_dir"), A.explode_episodes(p), A.explode_assets(p))


@query("routing_entries", f"""{BOTH} SELECT a.item_id, a.key, CASE WHEN starts_with(a.path, '/review/') THEN 'review' ELSE 'library' END AS destination,
  CASE WHEN a.item_id % 2 = 0 THEN e.episode <= 0 OR e.needs_review ELSE a.item_id % 5 = 0 END AS expected_review,
  CASE WHEN a.item_id % 2 = 0 THEN e.episode <= 0 OR e.needs_review ELSE a.item_id % 5 = 0 END = starts_with(a.path, '/review/') AS matches
FROM v_assets a LEFT JOIN v_eps e ON e.item_id = a.item_id AND lower(e.key) = a.key WHERE a.kind = 'final'""")
def routing_entries(t):
    p = stored(t, "episodes", "assets")
    return A.routing_entries(p.select("item_id", "media_type", "needs_review", "review_dir", "library_dir"), A.explode_episodes(p), A.explode_assets(p)).drop("path")


@query("enrich_episodes", f"""{BOTH}, pv AS (SELECT item_id, key, max(path) FILTER (kind = 'final') AS f, max(path) FILTER (kind = 'encoded' AND status <> 'failed') AS e, bool_or(status = 'failed') AS bad FROM v_assets GROUP BY ALL)
SELECT v.item_id, v.key, 'T' || title_id AS title, CASE WHEN title_id = 1 THEN 1001 ELSE 900 END AS runtime, CASE WHEN f IS NOT NULL THEN 'final' WHEN e IS NOT NULL THEN 'encoded' ELSE 'ripped' END AS stage,
  CASE WHEN bad THEN 'failed' ELSE '' END AS status, CASE WHEN bad THEN 'bad encode' ELSE '' END AS error, f AS final_path FROM v_eps v LEFT JOIN pv ON pv.item_id = v.item_id AND pv.key = lower(v.key)""")
def enrich(t):
    p = stored(t, "episodes", "titles", "assets")
    return A.enrich_episodes(A.explode_episodes(p), A.explode_titles(p), A.explode_assets(p)).select("item_id", "key", "title", "runtime", "stage", "status", "error", "final_path")


RETRY_SQL = """SELECT item_id, key, CASE WHEN s IS NULL THEN 'not_found' WHEN s <> 'F' THEN 'not_failed' WHEN item_id % 50 <= 1 OR n > item_id % 4 + 1 THEN 'episode_not_found' ELSE 'retried' END AS outcome
FROM (SELECT l_orderkey + 1 AS item_id, l_linenumber AS n, 'S01_00' || l_linenumber AS key, o_orderstatus AS s FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) LEFT JOIN orders ON o_orderkey = l_orderkey + 1)"""


def _retried(t):
    p = stored(t, "episodes", "assets")
    c = t.lineitem.select((F.col("l_orderkey") + 1).alias("item_id"), F.concat(F.lit("S01_00"), F.col("l_linenumber").cast("string")).alias("key")).distinct()
    items = t.orders.select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ripping").alias("stage"))
    return K.retry_member(items, A.explode_episodes(p), A.explode_assets(p), c)


@query("retry_member_outcomes", RETRY_SQL)
def retry_member(t):
    return _retried(t)[0]


@query("retry_member_assets", f"""{ASSETS}, h AS (SELECT item_id, lower(key) AS key FROM ({RETRY_SQL}) WHERE outcome = 'retried')
SELECT a.item_id, a.kind, a.key, CASE WHEN h.key IS NOT NULL AND kind <> 'ripped' THEN '' ELSE status END AS status, CASE WHEN h.key IS NOT NULL AND kind <> 'ripped' THEN '' ELSE path END AS path
FROM v_assets a LEFT JOIN h ON h.item_id = a.item_id AND h.key = lower(a.key)""")
def retry_member_assets(t):
    return _retried(t)[1].select("item_id", "kind", "key", "status", "path")


SEQ = f"""{MEMBERS}, d AS (SELECT item_id, number, lead(number) OVER (PARTITION BY item_id ORDER BY number) AS nx FROM (SELECT DISTINCT item_id, number FROM v_members WHERE number > 0)),
g AS (SELECT item_id, count(*) AS dn, min(number) AS lo, max(number) AS hi, count(*) FILTER (nx - number > 1) AS gaps, sum(number) AS s FROM d GROUP BY item_id),
r AS (SELECT item_id, count(*) AS members FROM v_members WHERE number > 0 GROUP BY item_id)"""


@query("sequence_checks", f"""{SEQ} SELECT item_id, members, lo, hi, members = dn AND gaps = 0 AS contiguous, gaps, dn >= 3 AND gaps > 1 AS fragmented,
  (CASE WHEN dn >= 2 AND hi - lo = dn THEN (lo + hi) * (hi - lo + 1) // 2 - s END)::BIGINT AS missing FROM r JOIN g USING (item_id)""")
def sequence_checks(t):
    return A.sequence_checks(V.members(t), ["item_id"])


@query("structural_reasons", f"""{SEQ} SELECT item_id, concat_ws('|', CASE WHEN item_id % 3 + 1 = 1 AND lo > 1 THEN 'disc 1 matched subset starts at episode ' || lo END, CASE WHEN dn >= 3 AND gaps > 1 THEN 'accepted episode subset is fragmented' END) AS reasons FROM r JOIN g USING (item_id)""")
def structural(t):
    d = A.structural_reasons(A.sequence_checks(V.members(t), ["item_id"]).withColumn("disc", F.col("item_id") % 3 + 1), "disc")
    return d.select("item_id", F.array_join("reasons", "|").alias("reasons"))


PROFILE = f"""{MEMBERS}, c AS (SELECT item_id, l_returnflag, l_linestatus, count(*) AS n, min(ord) AS f FROM v_members GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, f) AS rn, sum(n) OVER (PARTITION BY item_id)::BIGINT AS total FROM c) WHERE rn = 1 AND total >= 2),
j AS (SELECT v.item_id, v.ord, v.number, m.n AS majority_count, total, concat_ws('|', CASE WHEN v.l_returnflag <> m.l_returnflag THEN 'flag: ' || v.l_returnflag || ' (expected ' || m.l_returnflag || ')' END,
  CASE WHEN v.l_linestatus <> m.l_linestatus THEN 'status: ' || v.l_linestatus || ' (expected ' || m.l_linestatus || ')' END) AS differences FROM v_members v JOIN m USING (item_id))"""


def _profiles(t):
    return M.majority_profile(V.members(t), ["item_id"], {"flag": "l_returnflag", "status": "l_linestatus"}, "ord", "number")


@query("majority_profile", f"{PROFILE} SELECT item_id, ord, number, majority_count, total, differences <> '' AS deviates, differences FROM j")
def majority(t):
    return _profiles(t).withColumn("differences", F.array_join("differences", "|"))


@query("keep_representative", f"""{PROFILE}, r AS (SELECT item_id, min(ord) FILTER (differences = '') AS rep, count(*) FILTER (differences = '') AS same FROM j GROUP BY item_id)
SELECT item_id, ord, differences = '' AS representative, greatest(same - 1, 0) AS omitted FROM j JOIN r USING (item_id) WHERE differences <> '' OR ord = rep""")
def representative(t):
    return M.keep_representative(_profiles(t), ["item_id"], "ord").select("item_id", "ord", "representative", "omitted")


@query("media_stats", "SELECT lang, count(*) AS files, min(n_chars) FILTER (n_chars > 0) AS duration_min, max(n_chars) FILTER (n_chars > 0) AS duration_max, min(length(text)) FILTER (length(text) > 0) AS size_min, max(length(text)) FILTER (length(text) > 0) AS size_max FROM documents WHERE source <> 'web' GROUP BY lang")
def media_stats(t):
    d = t.documents.select("lang", F.col("n_chars").alias("duration"), F.length("text").alias("size"), F.when(F.col("source") == "web", "unreadable").alias("error"))
    return M.media_stats(d, ["lang"])


def probes(t):
    return M.parse_probes(V.probes(t))


@query("stream_table", """SELECT o_orderkey AS item_id, count(*) AS streams, count(*) FILTER (i = 0 AND o_orderkey % 23 <> 0) AS video, count(*) FILTER (i IN (1, 2)) AS audio, CASE WHEN any_value(o_orderkey) % 19 = 0 THEN 0 ELSE round(any_value(o_totalprice) / 50, 6) END AS duration
FROM orders, range(4) r(i) WHERE NOT (i = 2 AND o_orderkey % 10 = 9) AND NOT (i = 3 AND o_orderkey % 2 = 1) GROUP BY o_orderkey""")
def stream_table(t):
    s = M.stream_table(probes(t))
    return s.groupBy("item_id").agg(F.count(F.lit(1)).alias("streams"), F.count_if(F.col("codec_type") == "video").alias("video"), F.count_if(F.col("codec_type") == "audio").alias("audio"),
                                    F.round(F.max("file_duration"), 6).alias("duration"))


@query("validate_artifacts", "SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 29 = 0 THEN 'empty_path' WHEN o_totalprice * 100 < 10485760 THEN 'too_small' WHEN o_orderkey % 23 = 0 THEN 'no_video' WHEN o_orderkey % 19 = 0 THEN 'invalid_duration' END AS failure FROM orders")
def validate(t):
    return M.validate_artifacts(probes(t)).select("item_id", "failure")


@query("duration_agreement", """SELECT k AS item_id, CASE WHEN k % 19 = 0 THEN NULL WHEN k % 17 > 5 THEN 0 WHEN has2 AND abs(d - d2) > 5 AND NOT (comm AND d2 < d AND d2 >= d / 2) THEN 1 END AS bad_stream
FROM (SELECT o_orderkey AS k, o_totalprice / 50 AS d, o_totalprice / 50 / CASE WHEN o_orderkey % 9 = 0 THEN 3 ELSE 1.25::DOUBLE END AS d2, o_orderkey % 10 <> 9 AS has2, (o_orderkey % 16 < 9 AND o_orderkey % 8 = 0) OR o_orderkey % 8 = 1 AS comm FROM orders)""")
def durations(t):
    return M.duration_agreement(probes(t)).select("item_id", "bad_stream")


@query("best_stream", """SELECT k AS item_id, CASE WHEN b THEN 1 ELSE 0 END AS "primary", CASE WHEN b THEN s2 ELSE s1 END AS score, CASE WHEN NOT has2 THEN '' WHEN b THEN '0' ELSE '1' END AS removed, NOT has2 AND NOT e1 AS fallback FROM (
  SELECT *, has2 AND (NOT e1 OR s2 > s1) AS b FROM (SELECT o_orderkey AS k, o_orderkey % 4 <> 0 AS e1, o_orderkey % 10 <> 9 AS has2, 850.0 + CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 0 END AS s1,
    CASE WHEN o_orderkey % 6 = 0 THEN 1000 ELSE 400 END + CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 50 END + CASE WHEN o_orderkey % 3 = 1 THEN 5 ELSE 0 END - CASE WHEN o_orderkey % 4 <> 0 THEN 0.1 ELSE 0 END AS s2 FROM orders))""")
def best_stream(t):
    return M.best_stream(probes(t)).select("item_id", "primary", "score", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"), "fallback")


@query("item_totals", f"{ASSETS} SELECT item_id, " + ", ".join(f"count(DISTINCT lower(key)) FILTER (kind = '{k}' AND status <> 'failed' AND path <> '') AS {k}" for k in A.KINDS) + " FROM v_assets GROUP BY item_id")
def item_totals(t):
    return A.item_totals(A.explode_assets(parsed(t)))


@query("remap_indices", """SELECT l_orderkey, array_to_string(list_filter([CASE WHEN i = p THEN 0 WHEN i < n THEN 1 + (x <> p AND x < n AND x < i)::INT + (y <> p AND y < n AND y < i AND y <> x)::INT END FOR i IN [x, y, p]], lambda v: v IS NOT NULL), ',') AS places
FROM (SELECT l_orderkey, min(l_linenumber) % 3 AS p, max(l_linenumber) AS n, min(l_suppkey) % 8 AS x, max(l_suppkey) % 8 AS y FROM lineitem GROUP BY l_orderkey)""")
def remapped(t):
    g = t.lineitem.groupBy("l_orderkey").agg((F.min("l_linenumber") % 3).alias("p"), F.max("l_linenumber").alias("n"), (F.min("l_suppkey") % 8).cast("int").alias("x"), (F.max("l_suppkey") % 8).cast("int").alias("y"))
    g = g.withColumn("kept", M.kept_indices(F.col("n"), F.col("p"), F.array("x", "y")))
    return g.select("l_orderkey", F.array_join(F.transform(M.remap_indices(F.array("x", "y", "p"), F.col("kept")), lambda i: i.cast("string")), ",").alias("places"))


@query("kept_indices", """SELECT l_orderkey, array_to_string(list_concat([p], list_sort(list_distinct(list_filter([x, y], lambda i: i < n AND i <> p)))), ',') AS kept FROM (SELECT l_orderkey, min(l_linenumber) % 3 AS p, max(l_linenumber) AS n, min(l_suppkey) % 8 AS x, max(l_suppkey) % 8 AS y FROM lineitem GROUP BY l_orderkey)""")
def kept(t):
    g = t.lineitem.groupBy("l_orderkey").agg((F.min("l_linenumber") % 3).alias("p"), F.max("l_linenumber").alias("n"), (F.min("l_suppkey") % 8).cast("int").alias("x"), (F.max("l_suppkey") % 8).cast("int").alias("y"))
    return g.select("l_orderkey", F.array_join(F.transform(M.kept_indices(F.col("n"), F.col("p"), F.array("x", "y")), lambda i: i.cast("string")), ",").alias("kept"))


@query("output_media", """SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'h264' ELSE 'hevc' END AS video_codec, o_orderkey % 23 <> 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) AS hdr,
  CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 2 END AS audio_n, CASE WHEN o_orderkey % 10 <> 9 AND (o_orderkey % 8 < 2) THEN 1 ELSE 0 END AS commentary_n, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS subtitle_n,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 < 2 AND NOT (o_orderkey % 12 < 2 AND o_orderkey % 3 <> 1) ELSE true END AS labels_ok FROM orders""")
def output_media(t):
    m = M.output_media(probes(t))
    return m.select("item_id", "video_codec", "hdr", F.size("audio").alias("audio_n"), F.size(F.filter("audio", lambda a: a["commentary"])).alias("commentary_n"), F.size("subtitles").alias("subtitle_n"),
                    F.forall("subtitles", lambda s: s["label_ok"]).alias("labels_ok"))


@query("audio_summary", """SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 2 END AS audio_tracks, CASE WHEN o_orderkey % 10 <> 9 AND o_orderkey % 8 < 2 THEN 1 ELSE 0 END AS commentary_tracks,
  NOT (o_orderkey % 10 <> 9 AND o_orderkey % 8 = 1) AS commentary_labels_ok FROM orders""")
def audio_summary(t):
    return M.audio_summary(M.output_media(probes(t)))


@query("subtitle_summary", """SELECT o_orderkey AS item_id, coalesce(p, 0) AS passed, coalesce(r, 0) AS review, coalesce(f, 0) AS failed, coalesce(s, 0) AS skipped, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS tracks,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 12 < 2 THEN 1 ELSE 0 END AS forced_subtitle_files FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS p, count(*) FILTER (l_returnflag = 'A') AS r, count(*) FILTER (l_returnflag = 'R') AS f,
  count(*) FILTER (l_linestatus = 'O') AS s FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def subtitle_summary(t):
    v = F.when(F.col("l_returnflag") == "N", "passed").when(F.col("l_returnflag") == "A", "needs_review").otherwise("failed")
    r = t.lineitem.select(F.col("l_orderkey").alias("item_id"), F.when(F.col("l_linestatus") == "O", "None").otherwise("download").alias("source"), v.alias("validation"))
    return M.subtitle_summary(r, M.output_media(probes(t))).select("item_id", "passed", "review", "failed", "skipped", "tracks", "forced_subtitle_files")


@query("default_language_problem", "SELECT o_orderkey AS item_id, 'fr' AS default_language FROM orders WHERE o_orderkey % 10 <> 9 AND o_orderkey % 4 = 0 AND o_orderkey % 3 = 0")
def default_language(t):
    return M.default_language_problem(probes(t)).select("item_id", "default_language")


@query("av_offset_drift", """SELECT k AS item_id, CASE WHEN k % 23 = 0 THEN NULL ELSE round((b - a) * 1000, 6) END AS drift_ms, CASE WHEN k % 23 = 0 THEN 'unavailable' WHEN abs(round((b - a) * 1000, 6)) <= 100 THEN 'passed' ELSE 'failed' END AS status FROM (
  SELECT o_orderkey AS k, (o_orderkey % 5) / 10.0::DOUBLE + (o_orderkey % 13) / 50.0::DOUBLE - (o_orderkey % 5) / 10.0::DOUBLE AS a,
    CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 10 <> 9 THEN 0 ELSE (o_orderkey % 5) / 10.0::DOUBLE + (o_orderkey % 13) / 50.0::DOUBLE END - (o_orderkey % 5) / 10.0::DOUBLE AS b FROM orders)""")
def av_drift(t):
    p = probes(t)
    return M.av_offset_drift(p.withColumn("audio_ordinal", F.lit(0)), p).select("item_id", (F.col("drift_ms") + 0.0).alias("drift_ms"), "status")


@query("anomalies", f"""{with_views('v_eps', 'v_assets', 'v_items')}, {STATS}, {ROUTE}, fb AS (SELECT item_id, count(*) FILTER (status = 'failed') AS fe FROM v_assets GROUP BY item_id),
lg AS (SELECT user_id AS item_id, count(*) FILTER (event_type = 'error') AS le, count(*) FILTER (event_type = 'signup') AS lw FROM events GROUP BY user_id),
w AS (SELECT i.*, le, lw, st.* EXCLUDE (item_id), fe, clean, clean_in_review, review_in_library, missing_final FROM v_items i LEFT JOIN lg USING (item_id) LEFT JOIN st USING (item_id) LEFT JOIN fb USING (item_id) LEFT JOIN rt USING (item_id))
SELECT item_id, 0 AS rule, 'critical' AS severity, 'item_state' AS category, 'stopped in ' || failed_at_stage || ': ' || error_message AS message FROM w WHERE error_message <> ''
UNION ALL SELECT item_id, 1, 'warning', 'item_state', 'held for review: ' || review_reason FROM w WHERE needs_review
UNION ALL SELECT item_id, 2, 'critical', 'logs', le || ' log lines at error level' FROM w WHERE le > 0 UNION ALL SELECT item_id, 3, 'warning', 'logs', lw || ' log lines at warning level' FROM w WHERE lw > 0
UNION ALL SELECT item_id, 9, 'warning', 'episodes', review_episodes || ' episodes carry a review flag' FROM w WHERE review_episodes > 0
UNION ALL SELECT item_id, 13, 'info', 'episodes', unresolved || ' episodes are still placeholders' FROM w WHERE placeholder_only
UNION ALL SELECT item_id, 14, 'critical', 'episodes', unresolved || ' episodes have no number' FROM w WHERE NOT placeholder_only AND unresolved > 0
UNION ALL SELECT item_id, 15, 'critical', 'episodes', below_070 || ' episodes of confidence under 0.70' FROM w WHERE below_070 > 0
UNION ALL SELECT item_id, 16, 'warning', 'episodes', below_080 - below_070 || ' episodes of confidence 0.70 to 0.80' FROM w WHERE below_080 - below_070 > 0
UNION ALL SELECT item_id, 17, 'info', 'episodes', below_090 - below_080 || ' episodes of confidence 0.80 to 0.90' FROM w WHERE below_090 - below_080 > 0
UNION ALL SELECT item_id, 18, 'warning', 'episodes', 'gap in the numbers ' || "range" FROM w WHERE matched > 0 AND NOT contiguous
UNION ALL SELECT item_id, 23, 'critical', 'assets', fe || ' assets failed: encoded' FROM w WHERE fe > 0
UNION ALL SELECT item_id, 33, CASE WHEN clean > 0 AND clean_in_review = clean THEN 'critical' ELSE 'warning' END, 'organization', clean_in_review || ' clean episodes lie in review' FROM w WHERE clean_in_review > 0
UNION ALL SELECT item_id, 34, 'critical', 'organization', review_in_library || ' episodes for review lie in the library' FROM w WHERE review_in_library > 0
UNION ALL SELECT item_id, 35, 'warning', 'organization', missing_final || ' episodes lack a final file' FROM w WHERE missing_final > 0""")
def anomalies(t):
    p = stored(t, "episodes", "assets")
    eps, assets = A.explode_episodes(p), A.explode_assets(p)
    logs = E.split_kinds(V.log(t)).groupBy("item_id").agg(F.count_if("is_error").alias("log_errors"), F.count_if("is_warning").alias("log_warnings"))
    s = V.items(t).select("item_id", "error_message", "failed_at_stage", "needs_review", F.col("review_reason").alias("review_reasons"))
    for part in (logs, A.episode_stats(eps), A.failed_by_kind(assets), A.routing_check(p.select("item_id", "media_type", "review_dir"), eps, assets)):
        s = s.join(part, "item_id", "left")
    return A.anomalies(s)


@query("source_summary", """SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'bluray' END AS disc_source, CASE WHEN o_orderkey % 2 = 0 THEN '3840x2160' ELSE '1920x1080' END AS input_resolution, 'hevc,ac3' AS input_codecs,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'h264' ELSE 'hevc' END AS output_codec, CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN '3840x2160' ELSE '1920x1080' END AS output_resolution,
  o_orderkey % 23 <> 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) AS hdr, o_orderkey % 2 = 0 OR (o_orderkey % 23 <> 0 AND o_orderkey % 3 = 0) AS uhd_likely FROM orders""")
def source_summary(t):
    k = F.col("o_orderkey")
    items = t.orders.select(k.alias("item_id"), F.lit("x").alias("title"), F.when(k % 3 == 0, "").otherwise("bluray").alias("disc_source"))
    dec = t.orders.select(k.alias("item_id"), k.alias("seq"), F.lit("file_probe").alias("decision_type"),
                          F.concat(F.lit("probe ok resolution="), F.when(k % 2 == 0, "3840x2160").otherwise("1920x1080"), F.lit(", codecs=hevc,ac3,")).alias("decision_reason"), F.lit(None).cast("map<string,string>").alias("fields"))
    return A.source_summary(items, dec, M.output_media(probes(t)).withColumn("pos", F.lit(0)))


@query("prune_plan", "WITH r AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS cum, sum(n_chars) OVER () AS total FROM documents) SELECT doc_id AS name, n_chars AS bytes FROM r WHERE total - (cum - n_chars) > 500000")
def prune(t):
    d = t.documents.select(F.col("doc_id").alias("name"), F.col("n_chars").alias("bytes"), F.col("doc_id").alias("cached_at"))
    return RT.prune_plan(d, 500_000).select("name", "bytes")


@query("stale_entries", """SELECT name, reason, CASE WHEN reason = 'stale' THEN 'removed' ELSE 'preserved' END AS result FROM (SELECT name, CASE WHEN starts_with(name, 'queue-') OR user_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'protected' WHEN m > TIMESTAMP '2024-01-30 12:00:00' THEN 'recent' ELSE 'stale' END AS reason
FROM (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'queue-' ELSE 'user-' END || user_id AS name, max(ts) AS m FROM events GROUP BY user_id))""")
def stale(t):
    name = F.concat(F.when(F.col("user_id") % 7 == 0, "queue-").otherwise("user-"), F.col("user_id").cast("string"))
    dirs = t.events.groupBy(name.alias("name")).agg(F.max("ts").alias("modified"))
    active = t.labels.filter("quality = 1").select(F.concat(F.lit("user-"), F.col("doc_id").cast("string")).alias("name"))
    return RT.stale_entries(dirs, active, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("name", "reason", "result")


@query("capacity_plan", """SELECT destination, titles, unsized, estimated, required, CASE WHEN estimated = 0 THEN 'skipped' WHEN free < required THEN 'insufficient' ELSE 'passed' END AS status FROM (
  SELECT p_brand AS destination, count(*) AS titles, count(*) FILTER (p_size - 10 <= 0) AS unsized, coalesce(sum(p_size - 10) FILTER (p_size > 10), 0)::BIGINT AS estimated, floor(coalesce(sum(p_size - 10) FILTER (p_size > 10), 0) * 1.1::DOUBLE)::BIGINT AS required, 1400 AS free FROM part GROUP BY p_brand)""")
def capacity(t):
    p = t.part.select(F.col("p_brand").alias("destination"), (F.col("p_size") - 10).cast("long").alias("bytes"))
    return RT.capacity_plan(p, p.select("destination", F.lit(1400).alias("free")).distinct()).drop("free")


@query("language_filter", "SELECT doc_id, lang IN ('en', 'und', '') AS allowed FROM documents")
def language_filter(t):
    return LG.language_filter(t.documents, "lang").select("doc_id", "allowed")


@query("normalise_languages", """SELECT doc_id, lang AS iso2, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE 'und' END AS iso3,
  CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE upper(lang) END AS language_name FROM documents""")
def normalise_languages(t):
    return LG.normalise_languages(t.documents, "lang").select("doc_id", "iso2", "iso3", "language_name")


@query("unknown_languages", "SELECT lower(trim(source)) AS tag, count(*) AS n FROM documents GROUP BY 1")
def unknown_languages(t):
    """Document sources are no languages: all of them are reported."""
    return LG.unknown_languages(t.documents, "source")
