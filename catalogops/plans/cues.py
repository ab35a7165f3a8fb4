"""Queries of the timed-text operators: conversation turns and document lines as cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.functions.text import lexical_word_count, strip_payload
from catalogops.functions.times import srt_stamp
from catalogops.operators import cues as C
from catalogops.plans import views as V
from catalogops.plans.registry import query
from catalogops.plans.views import with_views
from catalogops.sources import subtitles as S

CUES, LINES, BOTH = with_views("v_cues"), with_views("v_lines"), with_views("v_lines", "v_lines_b")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rep(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


def strip_sql(expr: str) -> str:
    return rep(expr, r"^\s+|\s+$", "")


def _clean_sql() -> str:
    raw = rep("text", C.LINE_BREAK_MARK, "\n")
    t = rep(rep(raw, C.OVERRIDE_TAG, ""), C.OTHER_TAG, "")
    for tag in C.KEPT_TAGS:
        name = f"[{tag}{tag.upper()}]"
        t = rep(rep(t, rf"<{name}(?:[^a-zA-Z0-9>][^>]*)?>", f"<{tag}>"), rf"</{name}(?:[^a-zA-Z0-9>][^>]*)?>", f"</{tag}>")
    t = rep(rep(t, r"\[[^\]]*\]", ""), r"\([^)]*\)", "")
    line = strip_sql(rep(f"regexp_replace(x, {q(C.SPEAKER)}, '\\1')", r"[ \t]+", " "))
    keep = f"x <> '' AND NOT regexp_matches(x, {q(C.MUSIC_ONLY)}) AND NOT regexp_matches({rep('x', C.ANY_TAG, '')}, {q(C.PUNCT_ONLY)})"
    cleaned = f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: {line}), lambda x: {keep}), chr(10))"
    promo = " OR ".join(f"regexp_matches(x, {q(p)})" for p in C.PROMO_PATTERNS)
    hit = f"len(list_filter(string_split({raw}, chr(10)), lambda x: {promo})) > 0"
    return f"""{LINES}, f AS MATERIALIZED (SELECT *, CASE WHEN {hit} THEN 'promo' WHEN cleaned = '' THEN 'emptied' ELSE 'kept' END AS fate
  FROM (SELECT *, {cleaned} AS cleaned FROM v_lines))"""


@query("clean_cues", f"""{_clean_sql()} SELECT track, row_number() OVER (PARTITION BY track ORDER BY idx) AS idx, round(start, 6) AS start, cleaned AS text
FROM f WHERE fate = 'kept'""")
def clean_cues(t):
    return C.clean_cues(V.lines(t)).select("track", "idx", F.round("start", 6).alias("start"), "text")


@query("clean_counts", f"""{_clean_sql()} SELECT track, count(*) AS original, count(*) FILTER (fate = 'kept') AS cleaned, count(*) FILTER (fate = 'promo') AS promo,
  count(*) FILTER (fate = 'emptied') AS emptied FROM f GROUP BY track""")
def clean_counts(t):
    return C.clean_counts(V.lines(t))


@query("strip_markup_payload", f"SELECT page_id, {strip_sql(rep(rep(rep('html', chr(13) + chr(10) + '?', chr(10)), '<[^>]*>', ''), chr(10) + '{3,}', chr(10) * 2))} AS text FROM pages")
def strip_markup(t):
    return t.pages.select("page_id", strip_payload(F.col("html")).alias("text"))


def _srt_files(t):
    """One SRT file per document, written from its lines inside the row."""
    blocks = F.transform(F.split("text", "\n"), lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit("\r\n"), srt_stamp(i * 10.0), F.lit(" --> "), srt_stamp(i * 10.0 + 2.5), F.lit("\r\n"), x, F.lit("\r\n\r\n")))
    return t.documents.select(F.col("doc_id").alias("track"), F.array_join(blocks, "").alias("content"))


@query("parse_subtitles", rf"""{LINES} SELECT track, idx + 1 AS idx, start, start + 2.5 AS "end", CASE WHEN regexp_matches(text, '\S') THEN text ELSE '' END AS text FROM v_lines""")
def parse_subtitles(t):
    return S.parse_subtitles(_srt_files(t)).select("track", "idx", "start", "end", "text")


@query("decode_legacy_text", "SELECT doc_id, text FROM documents")
def decode_legacy(t):
    """Documents as UTF-8 files with a byte-order mark."""
    return t.documents.select("doc_id", S.decode_legacy_text(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).alias("text"))


@query("subtitle_plain_text", rf"""SELECT doc_id AS track, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '\S')), ' ') AS text FROM documents""")
def plain_text(t):
    return _srt_files(t).select("track", S.plain_text(S.srt_cues(F.col("content"))).alias("text"))


@query("track_extent", f"""{CUES} SELECT track, count(*) AS cues, min_by(start, idx) AS first_start, round(max_by("end", idx), 6) AS last_end FROM v_cues GROUP BY track""")
def extent(t):
    return C.track_extent(V.cues(t)).withColumn("last_end", F.round("last_end", 6))


METRIC_SQL = rf"""m0 AS (SELECT *, "end" - start AS dur, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS lines,
  {strip_sql('text')} AS st FROM src),
m AS MATERIALIZED (SELECT *, CASE WHEN dur > 0 THEN length(array_to_string(lines, ' ')) / dur ELSE 0 END AS cps, len(lines) > 2 AS m_lines,
  len(list_filter(lines, lambda x: length(x) > 42)) > 0 AS m_long_line, len(lines) = 2 AND abs(length(lines[1]) - length(lines[2])) > 16 AS m_unbalanced,
  st <> '' AND dur > 0 AND dur < 5.0::DOUBLE / 6.0::DOUBLE AS m_short, st <> '' AND dur > 7 AS m_long,
  len(regexp_extract_all(st, '[\p{{L}}\p{{Nd}}][\p{{L}}\p{{Nd}}''-]*')) AS nw FROM m0),
mm AS (SELECT *, cps > 20 AS m_fast, st <> '' AND dur > 0 AND nw > 0 AND ((dur >= 12 AND nw <= 2) OR (dur >= 8 AND nw <= 1 AND length(st) <= 24)) AS m_dull FROM m)"""


@query("cue_qc_stats", f"""{LINES}, src AS (SELECT * FROM v_lines), {METRIC_SQL} SELECT track, count(*) AS cues, round(max(cps), 6) AS max_cps,
  round(list(cps ORDER BY cps)[ceil(0.95::DOUBLE * count(*))::INT], 6) AS p95_cps, count(*) FILTER (m_fast) AS fast, count(*) FILTER (m_short) AS short,
  count(*) FILTER (m_long) AS long, count(*) FILTER (m_long_line) AS overlong_line, count(*) FILTER (m_unbalanced) AS unbalanced, count(*) FILTER (m_lines) AS too_many_lines
FROM mm GROUP BY track""")
def qc_stats(t):
    d = C.qc_stats(V.lines(t))
    return d.withColumns({"max_cps": F.round("max_cps", 6), "p95_cps": F.round("p95_cps", 6)})


ISSUES_SQL = f"""{with_views('v_lines', 'v_lines_b')}, src AS (SELECT * FROM v_lines_b), {METRIC_SQL},
o AS (SELECT *, lag("end") OVER (PARTITION BY track ORDER BY idx) AS prev FROM mm),
g AS (SELECT track, count(*) AS n, min_by(start, idx) AS f, max_by("end", idx) AS l, bool_or(coalesce(start < prev, false)) AS overlap, bool_or(m_lines) AS a1,
  bool_or(m_long_line) AS a2, bool_or(m_unbalanced) AS a3, bool_or(m_fast) AS a4, bool_or(m_short) AS a5, bool_or(m_long) AS a6, bool_or(m_dull) AS a7 FROM o GROUP BY track),
v AS (SELECT doc_id AS track, n_chars / 10.0::DOUBLE AS vs FROM documents)
SELECT track, CASE WHEN n IS NULL THEN 'empty_subtitle_file' ELSE concat_ws(',', CASE WHEN l > vs + 8 THEN 'duration_mismatch' END,
  CASE WHEN vs > 60 AND n / (vs / 60) < 2 THEN 'sparse_subtitles' END, CASE WHEN f > 900 THEN 'late_first_cue' END, CASE WHEN a1 THEN 'too_many_lines' END,
  CASE WHEN a2 THEN 'line_too_long' END, CASE WHEN a3 THEN 'unbalanced_line_breaks' END, CASE WHEN a4 THEN 'high_reading_speed' END, CASE WHEN a5 THEN 'short_cue_duration' END,
  CASE WHEN a6 THEN 'long_cue_duration' END, CASE WHEN a7 THEN 'low_information_long_cue' END, CASE WHEN overlap THEN 'overlapping_cues' END) END AS issues,
  CASE WHEN n IS NULL THEN 'empty_subtitle_file' ELSE concat_ws(',', CASE WHEN l > vs + 8 THEN 'duration_mismatch' END, CASE WHEN vs > 60 AND n / (vs / 60) < 2 THEN 'sparse_subtitles' END,
  CASE WHEN f > 900 THEN 'late_first_cue' END, CASE WHEN a7 THEN 'low_information_long_cue' END, CASE WHEN overlap THEN 'overlapping_cues' END) END AS review_issues,
  CASE WHEN n IS NULL THEN 'empty_subtitle_file' ELSE concat_ws(',', CASE WHEN a7 THEN 'low_information_long_cue' END, CASE WHEN overlap THEN 'overlapping_cues' END) END AS severe_issues
FROM v LEFT JOIN g USING (track)"""


@query("cue_issues", ISSUES_SQL)
def cue_issues(t):
    tracks = t.documents.select(F.col("doc_id").alias("track"), (F.col("n_chars") / 10.0).alias("video_seconds"))
    d = C.cue_issues(tracks, V.drifted(V.lines(t)))
    return d.select("track", *[F.array_join(c, ",").alias(c) for c in ("issues", "review_issues", "severe_issues")])


NORM = rf"""list_filter(regexp_split_to_array(regexp_replace(lower({rep(rep('text', C.OVERRIDE_TAG, ''), C.ANY_TAG, '')}), '[^\p{{L}}\p{{Nd}}\s\x{{00A0}}]', '', 'g'), '[\s\x{{00A0}}]+'), lambda x: x <> '')"""
ANCHOR_SQL = f"""k1 AS (SELECT track, k, min(start) AS s, min(idx) AS idx FROM (SELECT track, idx, start, array_to_string(tk, ' ') AS k FROM (SELECT *, {NORM} AS tk FROM v_lines_b) WHERE len(tk) >= 4) GROUP BY ALL HAVING count(*) = 1),
k2 AS (SELECT track, k, min(start) AS s FROM (SELECT track, idx, start, array_to_string(tk, ' ') AS k FROM (SELECT *, {NORM} AS tk FROM v_lines) WHERE len(tk) >= 4) GROUP BY ALL HAVING count(*) = 1),
an AS MATERIALIZED (SELECT track, k1.idx, k1.s AS at_s, k1.s - k2.s AS delta FROM k1 JOIN k2 USING (track, k))"""


def _pair(t):
    base = V.lines(t)
    return V.drifted(base), base


@query("text_anchors", f"{BOTH}, {ANCHOR_SQL} SELECT track, idx, round(at_s, 6) AS at, round(delta, 6) AS delta FROM an")
def anchors(t):
    d = C.text_anchors(*_pair(t))
    return d.select("track", "idx", F.round("at", 6).alias("at"), F.round("delta", 6).alias("delta"))


@query("anchor_median", f"{BOTH}, {ANCHOR_SQL} SELECT track, count(*) AS anchors, round(median(abs(delta)), 6) AS median_delta FROM an GROUP BY track")
def anchor_median(t):
    return C.anchor_median(C.text_anchors(*_pair(t))).withColumn("median_delta", F.round("median_delta", 6))


SEG_SQL = """sp AS (SELECT track, min(at_s) AS lo, max(at_s) - min(at_s) AS span FROM an GROUP BY track HAVING max(at_s) - min(at_s) > 0),
sg AS MATERIALIZED (SELECT track, least(floor((at_s - lo) / span * 4), 3)::INT + 1 AS segment, count(*) AS n, median(abs(delta)) AS md FROM an JOIN sp USING (track) GROUP BY ALL)"""


@query("segment_medians", f"{BOTH}, {ANCHOR_SQL}, {SEG_SQL} SELECT track, segment, n, round(md, 6) AS median_delta, n >= 6 AND md > 1.0 AS failed FROM sg")
def segment_medians(t):
    return C.segment_medians(C.text_anchors(*_pair(t))).withColumn("median_delta", F.round("median_delta", 6))


OVER_SQL = """ov AS MATERIALIZED (SELECT a.track, CASE WHEN least(ta, tb) > 0 THEN coalesce(i, 0) / least(ta, tb) ELSE 0 END AS overlap
  FROM (SELECT track, sum(greatest("end" - start, 0)) AS ta FROM v_lines_b GROUP BY track) a JOIN (SELECT track, sum(greatest("end" - start, 0)) AS tb FROM v_lines GROUP BY track) b USING (track)
  LEFT JOIN (SELECT x.track, sum(least(x."end", y."end") - greatest(x.start, y.start)) AS i FROM v_lines_b x JOIN v_lines y ON x.track = y.track AND y.start < x."end" AND y."end" > x.start
    GROUP BY x.track) c USING (track))"""


@query("interval_overlap", f"{BOTH}, {OVER_SQL} SELECT track, round(overlap, 6) AS overlap FROM ov")
def overlap(t):
    return C.interval_overlap(*_pair(t)).withColumn("overlap", F.round("overlap", 6))


DRIFT_SQL = """rk AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY at_s, idx) AS rn, count(*) OVER (PARTITION BY track) AS n FROM an),
pt AS (SELECT track, 'h' AS p, at_s, delta FROM rk WHERE n >= 8 AND rn <= greatest(n // 3, 1) UNION ALL SELECT track, 't', at_s, delta FROM rk WHERE n >= 8 AND rn > n - greatest(n // 3, 1)),
md AS (SELECT track, p, list(at_s ORDER BY at_s)[count(*) // 2 + 1] AS tm, list(delta ORDER BY delta)[count(*) // 2 + 1] AS d FROM pt GROUP BY ALL),
ft AS (SELECT h.track, (t.d - h.d) / (t.tm - h.tm) AS slope, h.d - (t.d - h.d) / (t.tm - h.tm) * h.tm AS intercept FROM md h JOIN md t ON h.track = t.track AND h.p = 'h' AND t.p = 't'
  WHERE t.tm - h.tm >= 1),
fit AS (SELECT * FROM ft WHERE slope BETWEEN -0.05 AND 0.05 AND intercept BETWEEN -120 AND 120)"""


@query("fit_linear_drift", f"{BOTH}, {ANCHOR_SQL}, {DRIFT_SQL} SELECT track, round(slope, 6) + 0.0 AS slope, round(intercept, 6) + 0.0 AS intercept FROM fit")
def drift(t):
    d = C.linear_drift(C.text_anchors(*_pair(t)))
    return d.select("track", (F.round("slope", 6) + 0.0).alias("slope"), (F.round("intercept", 6) + 0.0).alias("intercept"))


@query("correct_drift", f"""{BOTH}, {ANCHOR_SQL}, {DRIFT_SQL}, mv AS (SELECT track, idx, greatest(start - (intercept + slope * start), 0) AS s, "end" - (intercept + slope * "end") AS e FROM v_lines_b JOIN fit USING (track))
SELECT track, idx, round(s, 5) AS start, round(CASE WHEN e <= s THEN s + 0.001 ELSE e END, 5) AS "end" FROM mv""")
def corrected(t):
    cand, ref = _pair(t)
    d = C.correct_drift(cand, C.linear_drift(C.text_anchors(cand, ref)))
    return d.select("track", "idx", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"))


GATE_SQL = rf"""w1 AS (SELECT track, term, count(*)::DOUBLE AS tf FROM (SELECT track, unnest(list_filter(regexp_split_to_array(lower({rep(rep('text', C.OVERRIDE_TAG, ''), C.ANY_TAG, '')}), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS term FROM v_lines_b) GROUP BY ALL),
w2 AS (SELECT track, term, count(*)::DOUBLE AS tf FROM (SELECT track, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS term FROM v_lines) GROUP BY ALL),
u1 AS (SELECT track, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY track)) AS w FROM w1), u2 AS (SELECT track, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY track)) AS w FROM w2),
sim AS (SELECT u1.track, round(sum(u1.w * u2.w), 9) AS similarity FROM u1 JOIN u2 USING (track, term) GROUP BY u1.track),
e1 AS (SELECT track, min_by(start, idx) AS c0, max_by("end", idx) AS c1 FROM v_lines_b GROUP BY track), e2 AS (SELECT track, min_by(start, idx) AS r0, max_by("end", idx) AS r1 FROM v_lines GROUP BY track),
am AS (SELECT track, count(*) AS anchors, median(abs(delta)) AS md FROM an GROUP BY track), bs AS (SELECT track, min(segment) FILTER (n >= 6 AND md > 1.0) AS bad FROM sg GROUP BY track),
al AS (SELECT d.doc_id AS track, c0, c1, r0, r1, coalesce(similarity, 0) AS similarity, coalesce(anchors, 0) AS anchors, am.md, bad, coalesce(overlap, 0) AS overlap, n_chars / 10.0::DOUBLE + 300 AS vs
  FROM documents d LEFT JOIN e1 ON e1.track = d.doc_id LEFT JOIN e2 ON e2.track = d.doc_id LEFT JOIN sim ON sim.track = d.doc_id LEFT JOIN am ON am.track = d.doc_id
  LEFT JOIN bs ON bs.track = d.doc_id LEFT JOIN ov ON ov.track = d.doc_id)"""


@query("adoption_gate", f"""{BOTH}, {ANCHOR_SQL}, {SEG_SQL}, {OVER_SQL}, {GATE_SQL} SELECT track, CASE WHEN c0 IS NULL THEN 'no_cues' WHEN r0 IS NULL THEN 'no_reference'
  WHEN similarity < 0.6 THEN 'text_similarity' WHEN anchors >= 8 AND md > 1.0 THEN 'anchor_median' WHEN anchors >= 8 AND bad IS NOT NULL THEN 'anchor_segment'
  WHEN anchors < 8 AND overlap < 0.5 THEN 'time_overlap' WHEN r1 - r0 > 0 AND (c1 - c0) / (r1 - r0) < 0.6 THEN 'span_coverage' WHEN r1 - c1 > 600 THEN 'tail_gap'
  WHEN vs > 0 AND c1 > vs + 8 THEN 'past_end' END AS failure, round(similarity, 6) AS similarity, anchors, bad AS bad_segment FROM al""")
def gate(t):
    cand, ref = _pair(t)
    tracks = t.documents.select(F.col("doc_id").alias("track"), (F.col("n_chars") / 10.0 + 300).alias("video_seconds"))
    return C.adoption_gate(tracks, cand, ref).select("track", "failure", F.round("similarity", 6).alias("similarity"), "anchors", "bad_segment")


def words(t):
    """Spoken words of every document line: one each 0.4 s from 0.7 s after the line's start."""
    d = V.lines(t).select("track", "start", F.posexplode(F.split("text", r"\s+")).alias("i", "word")).filter("word <> ''")
    s = F.col("start") + 0.7 + F.col("i") * 0.4
    return S.number_words(d.select("track", F.col("word").alias("text"), s.alias("start"), (s + 0.3).alias("end")))


@query("snap_shifts")
def snap_shifts(t):
    return C.snap_shifts(V.lines(t), words(t)).select("track", "idx", "matched", F.round("shift", 6).alias("shift"))


@query("snap_to_words")
def snap(t):
    return C.snap_to_words(V.lines(t), words(t)).select("track", "idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("non_overlapping_starts", """WITH RECURSIVE c AS (SELECT conv_id AS track, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn AS idx,
  CASE WHEN turn % 3 = 2 THEN turn * 10.0 - 14 ELSE turn * 10.0 END::DOUBLE AS s0, CASE WHEN turn % 3 = 2 THEN turn * 10.0 - 14 ELSE turn * 10.0 END::DOUBLE + length(text) / 60.0::DOUBLE AS e0 FROM conversations),
r AS (SELECT track, i, idx, greatest(s0, 0) AS s, e0 FROM c WHERE i = 1 UNION ALL SELECT c.track, c.i, c.idx, greatest(c.s0, 0, r.s + 0.001), c.e0 FROM r JOIN c ON c.track = r.track AND c.i = r.i + 1)
SELECT track, idx, round(s, 6) AS start, round(least(CASE WHEN e0 <= s THEN s + 0.001 ELSE e0 END, coalesce(lead(s) OVER (PARTITION BY track ORDER BY i), 1e18)), 6) AS "end" FROM r""")
def non_overlapping(t):
    early = F.when(F.col("turn") % 3 == 2, F.col("turn") * 10.0 - 14).otherwise(F.col("turn") * 10.0)
    c = t.conversations.select(F.col("conv_id").alias("track"), F.col("turn").alias("idx"), early.alias("start"), (early + F.length("text") / 60.0).alias("end"), "text")
    return C.non_overlapping(c).select("track", "idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("adopt_first_passing")
def adopt(t):
    """Two candidates per document: a drifting copy first, then a copy without half of its lines."""
    base = V.lines(t)
    one = V.drifted(base).withColumn("start", F.col("start") + 4.0).withColumn("end", F.col("end") + 4.0).withColumn("track", F.col("track") * 2)
    two = base.filter("idx % 2 = 0").withColumn("track", F.col("track") * 2 + 1)
    vs = F.col("n_chars") / 10.0
    cand = t.documents.select(F.col("doc_id").alias("key"), F.explode(F.array(F.lit(0), F.lit(1))).alias("preference"), vs.alias("video_seconds"))
    cand = cand.withColumn("track", F.col("key") * 2 + F.col("preference"))
    return C.adopt_first_passing(cand, one.unionByName(two), base, words(t))


@query("middle_text", rf"""{LINES}, l AS (SELECT track, max_by("end", idx) AS total FROM v_lines GROUP BY track),
k AS (SELECT track, idx, text FROM v_lines JOIN l USING (track) WHERE NOT ("end" < CASE WHEN total < 600 THEN 0 ELSE greatest(0, total / 2 - 300) END OR start > CASE WHEN total < 600 THEN total ELSE total / 2 + 300 END))
SELECT track, text FROM (SELECT track, {strip_sql("substr(string_agg(text, ' ' ORDER BY idx), 1, 6000)")} AS text FROM k GROUP BY track) WHERE text <> ''""")
def middle_text(t):
    return C.middle_text(V.lines(t))


@query("lexical_word_count", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{Nd}][\p{L}\p{Nd}''-]*')) AS words FROM documents")
def word_count(t):
    return t.documents.select("doc_id", lexical_word_count(F.col("text")).alias("words"))


@query("time_stamps", f"""{CUES} SELECT track, idx, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp FROM (SELECT *, floor("end" * 1000)::BIGINT AS ms FROM v_cues)""")
def time_stamps(t):
    return V.cues(t).select("track", "idx", srt_stamp(F.col("end")).alias("stamp"))
