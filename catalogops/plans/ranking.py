"""Queries of title selection and candidate ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.functions import titles as X
from catalogops.operators import ranking as R
from catalogops.operators import titles as T
from catalogops.operators.skew import median_ranks, upper_median_rank, value_at_ranks
from catalogops.plans import views as V
from catalogops.plans.cues import q
from catalogops.plans.registry import query
from catalogops.plans.views import with_views

TITLES, MEMBERS = with_views("v_titles"), with_views("v_members")
RUNTIMES = with_views("v_titles", "v_expected")


@query("valid_titles", f"""{MEMBERS} SELECT item_id, ord, CASE WHEN ord - 3 < 0 THEN 'invalid_id' WHEN l_quantity - 10 <= 0 THEN 'duration<=0' END AS reject_reason FROM v_members""")
def valid_titles(t):
    m = V.members(t).select("item_id", "ord", (F.col("ord") - 3).alias("title_id"), (F.col("l_quantity") - 10).alias("duration"))
    return T.split_valid(m).select("item_id", "ord", "reject_reason")


FUNNEL = f"""{TITLES}, v AS (SELECT *, CASE WHEN duration >= 1200 AND regexp_matches(playlist, '^008[0-9][0-9][.]mpls$') THEN substr(playlist, 3, 3)::INT END AS num FROM v_titles WHERE title_id >= 0 AND duration > 0),
g AS (SELECT disc, min(num) AS lo8, count(num) >= 2 AND min(num) < max(num) AS noted, count(num) >= 2 AND min(num) < max(num) AND max(duration) FILTER (num IS NOT NULL) - min(duration) FILTER (num IS NOT NULL) <= 30 AS variant FROM v GROUP BY disc),
s1 AS (SELECT v.*, noted, variant, CASE WHEN variant THEN coalesce(num = lo8, false) ELSE true END AS k1 FROM v JOIN g USING (disc)),
s2 AS (SELECT *, max(duration) FILTER (k1) OVER (PARTITION BY disc) AS mx FROM s1), s3 AS (SELECT *, k1 AND duration >= mx - 2 AS k2 FROM s2),
s4 AS (SELECT *, k2 AND (mx < 1200 OR duration >= 1200) AS k3 FROM s3), s5 AS (SELECT *, max(chapters) FILTER (k3) OVER (PARTITION BY disc) AS mc FROM s4),
s6 AS (SELECT *, k3 AND chapters = mc AS k4, ends_with(playlist, '.mpls') AS mp FROM s5), s7 AS (SELECT *, coalesce(bool_or(mp) FILTER (k4) OVER (PARTITION BY disc), false) AS am FROM s6),
s8 AS (SELECT *, k4 AND (mp OR NOT am) AS k5 FROM s7), s9 AS (SELECT *, max(segment_count) FILTER (k5) OVER (PARTITION BY disc) AS ms FROM s8), s10 AS (SELECT *, k5 AND segment_count = ms AS k6 FROM s9),
s11 AS (SELECT *, count(*) FILTER (k6) OVER (PARTITION BY disc, title_hash) AS f FROM s10), s12 AS (SELECT *, max(f) OVER (PARTITION BY disc) AS tf FROM s11),
s13 AS MATERIALIZED (SELECT *, k6 AND (tf <= 1 OR f = tf) AS k7 FROM s12)"""


@query("primary_title", f"{FUNNEL} SELECT disc, title_id AS selected_id FROM (SELECT disc, title_id, row_number() OVER (PARTITION BY disc ORDER BY duration DESC, title_id) AS rn FROM s13 WHERE k7) WHERE rn = 1")
def primary_title(t):
    return T.primary_title(V.titles(t))[0]


@query("primary_title_trace", f"""{FUNNEL}, c AS (SELECT disc, count(*) AS n, count(*) FILTER (k1) AS c1, count(*) FILTER (k2) AS c2, count(*) FILTER (k3) AS c3, count(*) FILTER (k4) AS c4, count(*) FILTER (k5) AS c5,
  count(*) FILTER (k6) AS c6, count(*) FILTER (k7) AS c7, bool_or(noted) AS noted, any_value(mx) AS mx, any_value(mc) AS mc, bool_or(am) AS am, any_value(ms) AS ms, any_value(tf) AS tf FROM s13 GROUP BY disc)
SELECT disc, 0 AS step, 'disney_800_series' AS rule, n AS "before", c1 AS "after" FROM c WHERE noted UNION ALL SELECT disc, 1, 'duration_window', c1, c2 FROM c
UNION ALL SELECT disc, 2, 'feature_length_gate', c2, c3 FROM c WHERE mx >= 1200 UNION ALL SELECT disc, 3, 'chapter_preference', c3, c4 FROM c WHERE mc > 0
UNION ALL SELECT disc, 4, 'mpls_preference', c4, c5 FROM c WHERE am AND c5 < c4 UNION ALL SELECT disc, 5, 'segment_count_preference', c5, c6 FROM c WHERE ms > 0
UNION ALL SELECT disc, 6, 'titlehash_frequency', c6, c7 FROM c WHERE tf > 1""")
def primary_trace(t):
    return T.primary_title(V.titles(t))[1]


@query("primary_title_eliminated", f"""{FUNNEL} SELECT disc, title_id, CASE WHEN NOT k1 THEN 'disney_800_series' WHEN NOT k2 THEN 'duration_window' WHEN NOT k3 THEN 'feature_length_gate' WHEN NOT k4 THEN 'chapter_preference'
  WHEN NOT k5 THEN 'mpls_preference' WHEN NOT k6 THEN 'segment_count_preference' WHEN NOT k7 THEN 'titlehash_frequency' END AS eliminated_by FROM s13""")
def primary_eliminated(t):
    return T.primary_title(V.titles(t))[2]


@query("feature_candidates", f"""{TITLES}, c AS (SELECT disc, title_id, duration * 2 AS duration, coalesce(title_id = 1, false) AS selected FROM v_titles WHERE duration * 2 > 3600 AND chapters > 1),
g AS (SELECT disc, max(duration) FILTER (selected) AS sd, count(*) AS n FROM c GROUP BY disc)
SELECT c.disc, title_id, duration, selected, n AS feature_candidates, count(*) FILTER (abs(duration - sd) <= 30) OVER (PARTITION BY c.disc) AS similar_runtime FROM c JOIN g USING (disc)""")
def feature_candidates(t):
    d = V.titles(t).withColumn("duration", F.col("duration") * 2)
    return T.feature_candidates(d, d.select("disc", F.lit(1).alias("selected_id")).distinct())


@query("first_wins_dedup", f"""{TITLES}, k AS (SELECT *, CASE WHEN source = 'bluray' THEN segment_map END AS key FROM v_titles)
SELECT disc, title_id, CASE WHEN key IS NOT NULL AND title_id <> min(title_id) OVER (PARTITION BY disc, key) THEN min(title_id) OVER (PARTITION BY disc, key) END AS duplicate_of FROM k""")
def first_wins(t):
    d = V.titles(t).withColumn("key", F.when(F.col("source") == "bluray", F.col("segment_map")))
    return T.first_wins(d, ["disc"], "key", "pos", "title_id").select("disc", "title_id", "duplicate_of")


@query("document_copies", "SELECT doc_id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN min(doc_id) OVER (PARTITION BY text) END AS duplicate_of FROM documents")
def document_copies(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("key"), F.col("doc_id").alias("pos"))
    return T.first_wins(d, [], "key", "pos", "doc_id").select("doc_id", "duplicate_of")


@query("weighted_median", f"""{MEMBERS}, c AS (SELECT item_id, v, sum(v) OVER (PARTITION BY item_id ORDER BY v) AS cum, sum(v) OVER (PARTITION BY item_id) AS total FROM (SELECT item_id, (l_quantity * 60)::BIGINT AS v FROM v_members))
SELECT item_id, min(v) FILTER (2 * cum >= total) AS weighted_median, floor(min(v) FILTER (2 * cum >= total) * 0.4::DOUBLE)::BIGINT AS outlier_bar FROM c GROUP BY item_id""")
def weighted_median(t):
    return T.weighted_median(V.members(t).select("item_id", (F.col("l_quantity") * 60).cast("long").alias("v0")), ["item_id"], "v0")


@query("medians", """SELECT l_orderkey, median(abs(l_quantity - 20)) AS median_abs, list(l_quantity ORDER BY l_quantity)[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_orderkey""")
def medians(t):
    d = t.lineitem.select("l_orderkey", "l_quantity", F.abs(F.col("l_quantity") - 20).alias("a"))
    a = value_at_ranks(d, ["l_orderkey"], "a", median_ranks()).select("l_orderkey", ((F.col("lo") + F.col("hi")) / 2).alias("median_abs"))
    b = value_at_ranks(d, ["l_orderkey"], "l_quantity", {"upper_median": upper_median_rank()}).drop("n")
    return a.join(b, "l_orderkey")


@query("double_length_flag", f"""{MEMBERS}, d AS (SELECT item_id, ord, l_quantity * 60 AS v FROM v_members), o AS (SELECT a.item_id, a.ord, a.v, list(b.v ORDER BY b.v) AS l FROM d a JOIN d b ON a.item_id = b.item_id AND a.ord <> b.ord GROUP BY ALL)
SELECT d.item_id, d.ord, coalesce(len(l) >= 2 AND d.v >= floor(l[len(l) // 2 + 1] * 1.8::DOUBLE) AND d.v <= floor(l[len(l) // 2 + 1] * 2.4::DOUBLE), false) AS double_length FROM d LEFT JOIN o ON o.item_id = d.item_id AND o.ord = d.ord""")
def double_length(t):
    d = V.members(t).select("item_id", "ord", (F.col("l_quantity") * 60).alias("v"))
    return T.double_length_flags(d, ["item_id"], "v").select("item_id", "ord", "double_length")


FIT = f"""{RUNTIMES}, tg AS (SELECT disc, runtime * 60 AS target FROM v_expected UNION SELECT a.disc, (a.runtime + b.runtime) * 60 FROM v_expected a JOIN v_expected b ON a.disc = b.disc AND b.ord = a.ord + 1),
x AS (SELECT t.disc, t.title_id, bool_or(abs(duration - target) <= greatest(floor(target * 0.25::DOUBLE), 300)) AS fits, min(abs(duration - target)::DOUBLE / target) AS deviation
  FROM v_titles t JOIN tg USING (disc) GROUP BY ALL)"""


@query("runtime_fit", f"{FIT} SELECT disc, title_id, fits, round(deviation, 6) AS deviation, bool_or(fits) OVER (PARTITION BY disc) AS disc_fits FROM x")
def runtime_fit(t):
    return T.runtime_fit(V.titles(t), V.expected_episodes(t)).select("disc", "title_id", "fits", F.round("deviation", 6).alias("deviation"), "disc_fits")


@query("cap_to_expected", f"""{FIT}, r AS (SELECT *, row_number() OVER (PARTITION BY disc ORDER BY deviation, title_id) AS rn FROM x), n AS (SELECT disc, count(*) AS want FROM v_expected GROUP BY disc)
SELECT disc, title_id FROM r JOIN n USING (disc) WHERE rn <= want""")
def cap(t):
    return T.cap_to_expected(V.titles(t), V.expected_episodes(t)).select("disc", "title_id")


@query("composite_titles")
def composites(t):
    d = V.titles(t).filter("source = 'bluray'")
    return T.composite_titles(T.first_wins(d, ["disc"], "segment_map", "pos", "title_id").filter("duplicate_of is null"))


@query("select_group_titles")
def group_titles(t):
    return T.select_group_titles(V.titles(t), V.expected_episodes(t)).withColumn("ambiguity", F.array_join("ambiguity", ","))


@query("set_operations", f"""{TITLES}, s AS (SELECT disc, title_id, string_split(segment_map, ',') AS l FROM v_titles)
SELECT a.disc, a.title_id, array_to_string(list_sort(list_distinct(list_concat(a.l, b.l))), ',') AS union_set,
  array_to_string(list_sort(list_concat(list_filter(a.l, lambda x: NOT list_contains(b.l, x)), list_filter(b.l, lambda x: NOT list_contains(a.l, x)))), ',') AS sym_diff,
  list_has_any(a.l, b.l) AS overlaps, list_sort(a.l) = list_sort(b.l) AS equal FROM s a JOIN s b ON a.disc = b.disc AND b.title_id = a.title_id + 1""")
def set_operations(t):
    a = V.titles(t).select("disc", "title_id", T.segment_set(F.col("segment_map")).alias("x"))
    b = a.select("disc", (F.col("title_id") - 1).alias("title_id"), F.col("x").alias("y"))
    r = a.join(b, ["disc", "title_id"]).withColumn("r", T.set_relations(F.col("x"), F.col("y")))
    return r.select("disc", "title_id", F.array_join("r.union", ",").alias("union_set"), F.array_join("r.difference", ",").alias("sym_diff"), "r.overlaps", "r.equal")


@query("eliminated_ids", f"{TITLES} SELECT disc, title_id FROM v_titles EXCEPT SELECT disc, title_id FROM v_titles WHERE duration >= 2400")
def eliminated(t):
    d = V.titles(t).select("disc", "title_id", "duration")
    return T.eliminated(d, d.filter("duration >= 2400"), ["disc", "title_id"])


# Parts as reference candidates of the season and number of their key; brands play the episode names.
CANDS = """c AS (SELECT p_partkey AS text_id, p_partkey % 10 + 1 AS season, p_partkey // 10 % 8 + 1 AS number, p_size AS downloads, p_partkey % 3 = 0 AS hi,
  p_name || CASE p_partkey % 4 WHEN 0 THEN '.S' || printf('%02d', p_partkey % 10 + 1) || 'E' || printf('%02d', p_partkey // 10 % 8 + 1) WHEN 1 THEN '.s' || (p_partkey % 10 + 1) || 'e01-e08' ELSE '' END AS text FROM part),
e AS (SELECT p_partkey % 10 + 1 AS season, p_partkey // 10 % 8 + 1 AS number, min(p_name) AS name FROM part GROUP BY ALL)"""


def candidates(t):
    s, n = F.col("p_partkey") % 10 + 1, F.expr("p_partkey div 10 % 8 + 1")
    tail = (F.when(F.col("p_partkey") % 4 == 0, F.format_string(".S%02dE%02d", s, n))
            .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(".s"), s.cast("string"), F.lit("e01-e08"))).otherwise(""))
    c = t.part.select(F.col("p_partkey").alias("text_id"), s.alias("season"), n.alias("number"), F.col("p_size").alias("downloads"),
                      (F.col("p_partkey") % 3 == 0).alias("hearing_impaired"), F.concat("p_name", tail).alias("text"))
    e = t.part.groupBy(s.alias("season"), n.alias("number")).agg(F.min("p_name").alias("name"))
    return c, e


NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'), ' ')"
MENTION = f"""WITH {CANDS}, m AS MATERIALIZED (SELECT c.*, coalesce(bool_or(e.number = c.number) FILTER (contains({NORM.format('c.text')}, {NORM.format('e.name')})), false) AS target,
  coalesce(bool_or(e.number <> c.number) FILTER (contains({NORM.format('c.text')}, {NORM.format('e.name')})), false) AS other FROM c JOIN e ON e.season = c.season GROUP BY ALL)"""


@query("title_mention", f"{MENTION} SELECT text_id, target, other FROM m")
def title_mention(t):
    c, e = candidates(t)
    return R.title_mention(c, e, ["season"]).select("text_id", "target", "other")


RANKED = f"""{MENTION}, s AS (SELECT *, text_id % 4 = 0 OR (text_id % 4 = 1 AND number = 1) AS exact, text_id % 4 = 1 AS pack FROM m),
z AS (SELECT *, round(12 * log10(downloads + 1.0) + CASE WHEN hi THEN 0 ELSE 20 END + CASE WHEN exact THEN 35 ELSE 0 END + CASE WHEN target THEN 70 ELSE 0 END - CASE WHEN other THEN 140 ELSE 0 END
  - CASE WHEN pack THEN 90 ELSE 0 END, 9) AS score FROM s),
y AS MATERIALIZED (SELECT *, CASE WHEN other THEN 'candidate_names_different_episode_title' WHEN NOT target AND NOT exact THEN 'candidate_lacks_target_title_and_episode_marker'
  WHEN pack AND NOT target THEN 'candidate_looks_like_multi_episode_pack' WHEN score < 0 THEN 'candidate_score_below_trust_floor' END AS why FROM z)"""


@query("score_references", f"{RANKED} SELECT text_id, round(score, 6) AS score, exact, pack, why IS NOT NULL AS suspect, why AS suspect_reason FROM y")
def score_references(t):
    return R.score_references(*candidates(t)).select("text_id", F.round("score", 6).alias("score"), "exact", "pack", "suspect", "suspect_reason")


@query("rank_references", f"""{RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY season, number ORDER BY score DESC, text_id) AS r1, row_number() OVER (PARTITION BY season, number ORDER BY why IS NOT NULL, score DESC, text_id) AS r2 FROM y)
SELECT season, number, text_id, round(score, 6) AS score, why IS NOT NULL AS suspect, why IS NULL AND r1 > 1 AS fallback,
  coalesce(CASE WHEN why IS NULL AND r1 > 1 THEN 'fallback_to_non_suspect_candidate' ELSE why END, 'highest_scoring_candidate') AS reason FROM o WHERE r2 = 1""")
def rank_references(t):
    return R.rank_references(*candidates(t)).withColumn("score", F.round("score", 6))


@query("top_files", """WITH f AS (SELECT l_orderkey AS want, l_partkey AS file_id, max(l_linenumber) AS downloads, bool_or(l_returnflag = 'R') AS hi,
  CASE WHEN l_partkey % 3 = 0 THEN 1 WHEN l_partkey % 3 = 1 THEN 2 END AS mark FROM lineitem WHERE l_partkey % 5 <> 0 AND l_partkey > 0 GROUP BY ALL)
SELECT want, rank, file_id FROM (SELECT want, file_id, row_number() OVER (PARTITION BY want ORDER BY coalesce(mark = 1, false) DESC, hi, downloads DESC, file_id) AS rank FROM f WHERE mark IS NULL OR mark = 1) WHERE rank <= 3""")
def top_files(t):
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("want"), F.col("l_partkey").alias("file_id")).agg(
        F.max("l_linenumber").alias("downloads"), F.bool_or(F.col("l_returnflag") == "R").alias("hearing_impaired"))
    name = (F.when(F.col("file_id") % 3 == 0, "Show.S02E01.srt").when(F.col("file_id") % 3 == 1, "show 2x02").otherwise("plain"))
    return R.top_files(g.select("want", F.lit(2).alias("season"), F.lit(1).alias("episode"), F.lit("release").alias("release"), "downloads",
                                (F.col("file_id") % 5 == 0).alias("foreign_only"), "hearing_impaired", "file_id", name.alias("file_name")))


HITS = """qs AS (SELECT DISTINCT p_name AS query FROM part), rs AS (SELECT q.query, p_partkey AS id, p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' ' || p_type END AS title,
  p_size / 10.0::DOUBLE + 2 AS va, p_size AS vc FROM part JOIN qs q ON q.query = p_name),
sc AS (SELECT *, round(CASE WHEN contains(lower(title), lower(query)) THEN 1 ELSE 0 END + va / 10 + vc / 1000.0::DOUBLE, 9) AS score, title = query AS exact FROM rs),
pk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) AS r, row_number() OVER (PARTITION BY query, exact ORDER BY score DESC, pos) AS rx FROM sc),
ch AS (SELECT b.query, CASE WHEN coalesce(x.va >= 2 AND x.vc >= 5, false) THEN x.id ELSE b.id END AS id FROM pk b LEFT JOIN pk x ON x.query = b.query AND x.exact AND x.rx = 1 WHERE b.r = 1)"""


@query("best_search_hit", f"""WITH {HITS} SELECT s.query AS query_id, s.id, s.exact, round(s.score, 6) AS score FROM ch JOIN sc s ON s.query = ch.query AND s.id = ch.id
WHERE CASE WHEN s.exact THEN s.va >= 2 AND s.vc >= 5 ELSE s.va >= 3 AND s.score >= round(1.3 + s.vc / 1000.0::DOUBLE, 9) END""")
def best_hit(t):
    qs = t.part.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query"), F.lit(0).alias("year")).distinct()
    title = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    rs = t.part.select(F.col("p_name").alias("query_id"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), title.alias("title"), F.lit("").alias("date"),
                       (F.col("p_size") / 10.0 + 2).alias("vote_average"), F.col("p_size").alias("vote_count"))
    return R.best_search_hit(qs, rs).select("query_id", "id", "exact", F.round("score", 6).alias("score"))


@query("first_by_fingerprint", "SELECT sha256(text) AS fingerprint, min(doc_id) AS item_id, count(*) AS n FROM documents GROUP BY 1")
def first_fingerprint(t):
    d = t.documents.select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("fingerprint"), F.col("doc_id").alias("created_at"))
    return R.first_by_fingerprint(d)


@query("resolve_by_prefix", """WITH e AS (SELECT p_partkey AS number, md5(p_partkey::VARCHAR) AS fp FROM part), s AS (SELECT s_suppkey AS sel_pos, CASE s_suppkey % 4 WHEN 0 THEN (s_suppkey * 3)::VARCHAR WHEN 1 THEN upper(substr(md5(s_suppkey::VARCHAR), 1, 8))
  WHEN 2 THEN substr(md5(s_suppkey::VARCHAR), 1, 1) ELSE 'zz' || s_suppkey END AS selector FROM supplier),
m AS (SELECT sel_pos, selector, (SELECT max(fp) FROM e WHERE number = CASE WHEN regexp_matches(selector, '^[+-]?[0-9]+$') THEN try_cast(selector AS BIGINT) END) AS h1, (SELECT count(*) FROM e WHERE starts_with(fp, lower(selector))) AS n, (SELECT min(fp) FROM e WHERE starts_with(fp, lower(selector))) AS h2 FROM s),
d AS (SELECT *, coalesce(h1, CASE WHEN n = 1 THEN h2 END) AS fingerprint FROM m)
SELECT sel_pos, selector, CASE WHEN fingerprint IS NOT NULL THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status, fingerprint,
  fingerprint IS NOT NULL AND sel_pos > min(sel_pos) OVER (PARTITION BY fingerprint) AS repeated FROM d""")
def by_prefix(t):
    e = t.part.select(F.col("p_partkey").alias("number"), F.md5(F.col("p_partkey").cast("string")).alias("fingerprint"))
    k = F.col("s_suppkey")
    h = F.md5(k.cast("string"))
    sel = (F.when(k % 4 == 0, (k * 3).cast("string")).when(k % 4 == 1, F.upper(F.substring(h, 1, 8))).when(k % 4 == 2, F.substring(h, 1, 1))
           .otherwise(F.concat(F.lit("zz"), k.cast("string"))))
    return R.resolve_by_prefix(e, t.supplier.select(k.alias("sel_pos"), sel.alias("selector")))


@query("comparison_key", r"SELECT p_partkey, regexp_replace(lower(p_name || ' & ' || p_type || '+1'), '[^\p{L}\p{Nd}&+]', '', 'g').replace('&', 'and').replace('+', 'and') AS key FROM part")
def comparison_key(t):
    return t.part.select("p_partkey", X.comparison_key(F.concat("p_name", F.lit(" & "), "p_type", F.lit("+1"))).alias("key"))


def _re(x: str, p: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(p)}, {q(to)}, '{flags}')"


LABELS = "l AS (SELECT p_partkey AS label_id, CASE p_partkey % 6 WHEN 0 THEN '12_' || upper(replace(p_name, ' ', '_')) || '_S1_DISC_2' WHEN 1 THEN p_name || ' Season ' || p_size || ': Disc 3' WHEN 2 THEN p_name || ' (' || (1900 + p_size) || ')' WHEN 3 THEN p_name || ' 50th Anniversary Edition Blu-ray' WHEN 4 THEN 'volume_' || p_size ELSE p_name || ' D2' END AS label FROM part)"


def labels(t):
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    label = (F.when(k == 0, F.concat(F.lit("12_"), F.upper(F.regexp_replace("p_name", " ", "_")), F.lit("_S1_DISC_2")))
             .when(k == 1, F.concat("p_name", F.lit(" Season "), n, F.lit(": Disc 3"))).when(k == 2, F.concat("p_name", F.lit(" ("), (F.col("p_size") + 1900).cast("string"), F.lit(")")))
             .when(k == 3, F.concat("p_name", F.lit(" 50th Anniversary Edition Blu-ray"))).when(k == 4, F.concat(F.lit("volume_"), n)).otherwise(F.concat("p_name", F.lit(" D2"))))
    return t.part.select(F.col("p_partkey").alias("label_id"), label.alias("label"))


@query("normalise_titles", f"""WITH {LABELS}, a AS (SELECT *, trim(replace({_re(_re(_re('label', '^[0-9]+_', '', 'c'), '(?i)_S[0-9]+_DISC_[0-9]+$'), '(?i)_TV$')}, '_', ' ')) AS named FROM l),
b AS (SELECT *, CASE WHEN label_id % 6 = 2 THEN regexp_extract(named, '([0-9]{{4}})\\)$', 1)::INT ELSE 0 END AS year, CASE WHEN label_id % 6 = 2 THEN trim({_re('named', X.TRAILING_YEAR)}) ELSE named END AS title FROM a),
c AS (SELECT *, coalesce(nullif(trim({_re(_re(_re('title', X.DISC_WORDS), X.FORMAT_WORDS), X.TRAILING)}), ''), title) AS query FROM b)
SELECT label_id, label, query, coalesce(nullif(trim({_re(_re('query', X.EDITION_WORDS), X.TRAILING)}), ''), query) AS narrow, year, coalesce(try_cast(regexp_extract(label, {q(X.SEASON)}, 1) AS INT), 0) AS season,
  coalesce(try_cast(regexp_extract(label, {q(X.DISC_NUMBER)}, 1) AS INT), 0) AS disc, CASE WHEN regexp_matches(label, {q(X.TV_HINT)}) THEN 'tv' ELSE '' END AS hint,
  {_re('lower(query)', r'[^a-z0-9]')} AS key, CASE WHEN label_id % 6 = 4 THEN 'unusable' ELSE 'ok' END AS status FROM c""")
def normalise_titles(t):
    return X.normalise_titles(labels(t))
