"""Queries of the text matcher: documents as rips, benchmark passages as catalogue references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.operators import linkage as L
from catalogops.operators import vectors as V
from catalogops.plans import views as V2
from catalogops.plans.registry import Tables, query
from catalogops.policy import MatchPolicy
from catalogops.session import cut_lineage

# Documents are spread over 128 shelves, each of one of 8 seasons; the policy is lowered so that invented prose
# yields acceptances.
EASY = MatchPolicy(min_similarity=0.03, clear_margin=0.01, review_below=0.04, auto_accept=0.05, clear_confidence=0.12)
SHELVES = 128
SEASONS = 8


def rips(t: Tables, shelves: int = 0) -> DataFrame:
    grp = F.pmod("doc_id", F.lit(shelves)) if shelves else F.lit(1)
    return t.documents.select(grp.cast("long").alias("grp"), F.col("doc_id").alias("key"), F.col("doc_id").alias("pos"), "text")


def refs(t: Tables, shelves: int = 0) -> DataFrame:
    if not shelves:
        return t.benchmark.select(F.lit(1).cast("long").alias("grp"), F.col("item_id").alias("number"),
                                  (F.col("item_id") % 10 == 0).alias("suspect"), "text")
    seasons = t.benchmark.select(F.pmod("item_id", F.lit(SEASONS)).alias("season"),
                                 F.expr(f"item_id div {SEASONS} + 1").alias("number"),
                                 (F.col("item_id") % 10 == 0).alias("suspect"), "text")
    shelf = rips(t, shelves).select("grp", F.pmod("grp", F.lit(SEASONS)).alias("season")).distinct()
    return shelf.join(seasons, "season").drop("season")


def season(t: Tables, shelves: int = 0) -> DataFrame:
    return refs(t, shelves).select("grp", "number", F.substring("text", 1, 20).alias("name"))


def episodes(t: Tables, shelves: int = SHELVES) -> DataFrame:
    """Documents as episodes; runtime from their length, a few already carry a number."""
    number = F.when(F.col("doc_id") % 97 == 5, F.col("doc_id") % 5 + 1).otherwise(F.lit(0))
    return t.documents.select(F.pmod("doc_id", F.lit(shelves)).alias("grp"), F.col("doc_id").alias("key"),
                              F.col("doc_id").alias("pos"), number.cast("long").alias("number"),
                              F.col("n_chars").alias("duration"))


def vec_sql(src: str, name: str) -> str:
    return f"""{name}_n AS MATERIALIZED (
  SELECT grp, doc, term, count(*) AS tf FROM (
    SELECT grp, doc, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS term
    FROM {src}) GROUP BY ALL),
{name} AS MATERIALIZED (
  SELECT grp, doc, term, tf, tf::DOUBLE / sqrt(sum(tf::DOUBLE * tf) OVER (PARTITION BY grp, doc)) AS weight FROM {name}_n)"""


def idf_sql(vec: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT d.grp, d.term, d.df, n.n_docs,
    CASE WHEN n.n_docs < 2 THEN 1.0 ELSE ln((n.n_docs + 1.0) / (d.df + 1.0)) END AS idf
  FROM (SELECT grp, term, count(*) AS df FROM {vec} GROUP BY ALL) d
  JOIN (SELECT grp, count(DISTINCT doc) AS n_docs FROM {vec} GROUP BY ALL) n USING (grp))"""


def tfidf_sql(vec: str, idf: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT grp, doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY grp, doc)) AS weight FROM (
    SELECT v.grp, v.doc, v.term, v.weight * coalesce(i.idf, 1.0) AS w
    FROM {vec} v LEFT JOIN {idf} i ON v.grp = i.grp AND v.term = i.term) WHERE w <> 0)"""


def pairs_sql(shelves: int = 0) -> str:
    if shelves:
        source = f"""rips AS (SELECT doc_id % {shelves} AS grp, doc_id AS doc, text FROM documents),
refs AS (SELECT g.grp, item_id // {SEASONS} + 1 AS doc, item_id % 10 = 0 AS suspect, text
  FROM benchmark JOIN (SELECT DISTINCT grp FROM rips) g ON g.grp % {SEASONS} = item_id % {SEASONS})"""
    else:
        source = """rips AS (SELECT 1::BIGINT AS grp, doc_id AS doc, text FROM documents),
refs AS (SELECT 1::BIGINT AS grp, item_id AS doc, item_id % 10 = 0 AS suspect, text FROM benchmark)"""
    return f"""WITH {source},
{vec_sql('rips', 'rv')}, {vec_sql('refs', 'fv')}, {idf_sql('fv', 'idf')},
{tfidf_sql('rv', 'idf', 'rw')}, {tfidf_sql('fv', 'idf', 'fw')},
wp AS MATERIALIZED (
  SELECT a.grp, a.doc AS key, b.doc AS number, round(sum(a.weight * b.weight), 9) AS weighted
  FROM rw a JOIN fw b ON a.grp = b.grp AND a.term = b.term GROUP BY ALL),
rp AS MATERIALIZED (
  SELECT p.grp, p.key, p.number, round(sum(a.weight * b.weight), 9) AS raw
  FROM wp p JOIN rv a ON a.grp = p.grp AND a.doc = p.key
  JOIN fv b ON b.grp = p.grp AND b.doc = p.number AND b.term = a.term
  GROUP BY ALL),
pairs AS MATERIALIZED (
  SELECT p.grp, p.key, p.number, p.weighted, r.raw,
    CASE WHEN r.raw >= 0.9 AND p.weighted >= 0.5 THEN greatest(p.weighted, r.raw) ELSE p.weighted END AS score
  FROM wp p LEFT JOIN rp r USING (grp, key, number))"""


def claims_sql(groups: int, p: MatchPolicy) -> str:
    m, half = p.clear_margin, p.clear_margin / 2
    clear = f"(rip_margin >= {m} AND ref_margin >= {m} AND neighbor_margin >= {half})"

    def pen(c: str, target: float, weight: float) -> str:
        return f"CASE WHEN {c} >= {target} THEN 0 ELSE {weight} * ({target} - greatest(0, {c})) / {target} END"

    return f"""{pairs_sql(groups)},
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp, key ORDER BY score DESC, number) AS r1,
    row_number() OVER (PARTITION BY grp, number ORDER BY score DESC, key) AS r2 FROM pairs WHERE score > 0),
c0 AS MATERIALIZED (
  SELECT p.*, f.suspect,
    coalesce(CASE WHEN a1.number = p.number THEN a2.number ELSE a1.number END, 0) AS runner_up_number,
    coalesce(CASE WHEN a1.number = p.number THEN a2.score ELSE a1.score END, 0) AS runner_up_score,
    CASE WHEN k1.key = p.key THEN k2.key ELSE k1.key END AS rip_runner_up_key,
    coalesce(CASE WHEN k1.key = p.key THEN k2.score ELSE k1.score END, 0) AS rip_runner_up_score,
    coalesce(lo.score, 0) AS lo_s, coalesce(hi.score, 0) AS hi_s
  FROM pairs p JOIN refs f ON f.grp = p.grp AND f.doc = p.number
  LEFT JOIN ranked a1 ON a1.grp = p.grp AND a1.key = p.key AND a1.r1 = 1
  LEFT JOIN ranked a2 ON a2.grp = p.grp AND a2.key = p.key AND a2.r1 = 2
  LEFT JOIN ranked k1 ON k1.grp = p.grp AND k1.number = p.number AND k1.r2 = 1
  LEFT JOIN ranked k2 ON k2.grp = p.grp AND k2.number = p.number AND k2.r2 = 2
  LEFT JOIN pairs lo ON lo.grp = p.grp AND lo.key = p.key AND lo.number = p.number - 1
  LEFT JOIN pairs hi ON hi.grp = p.grp AND hi.key = p.key AND hi.number = p.number + 1
  WHERE p.score >= {p.min_similarity}),
c1 AS (SELECT *, CASE WHEN hi_s > lo_s THEN number + 1 WHEN lo_s > 0 THEN number - 1 ELSE 0 END AS neighbor_number,
    greatest(lo_s, hi_s) AS neighbor_score, round(score - runner_up_score, 9) AS rip_margin,
    round(score - rip_runner_up_score, 9) AS ref_margin, round(score - greatest(lo_s, hi_s), 9) AS neighbor_margin FROM c0),
c2 AS (SELECT *, round(greatest(0, least(1, score - {pen('rip_margin', m, 0.2)} - {pen('ref_margin', m, 0.18)}
    - {pen('neighbor_margin', half, 0.16)} - CASE WHEN suspect THEN 0.18 ELSE 0 END)), 9) AS confidence FROM c1),
claims AS MATERIALIZED (SELECT *,
    CASE WHEN NOT suspect AND {clear} AND confidence >= {p.clear_confidence} THEN 'clear'
      WHEN NOT suspect AND {clear} AND confidence >= {p.auto_accept} THEN 'decisive_low_similarity'
      WHEN suspect OR confidence < {p.review_below} OR neighbor_margin < {m * 0.4} THEN 'contested'
      ELSE 'ambiguous' END AS quality,
    concat_ws(',', CASE WHEN rip_margin < {m} THEN 'rip_margin' END, CASE WHEN ref_margin < {m} THEN 'episode_margin' END,
      CASE WHEN neighbor_margin < {half} THEN 'neighbor_margin' END, CASE WHEN suspect THEN 'suspect_reference' END,
      CASE WHEN confidence < {p.auto_accept} THEN 'confidence_below_auto_accept_threshold' END) AS reasons,
    suspect OR confidence < {p.auto_accept} OR NOT {clear} AS needs_verify,
    round(confidence + 0.1 * greatest(0, rip_margin) + 0.1 * greatest(0, ref_margin) + 0.05 * greatest(0, neighbor_margin)
      - CASE WHEN suspect THEN 0.15 ELSE 0 END, 9) AS strength,
    {clear} AND NOT suspect AND confidence >= {p.auto_accept} AS auto_accept FROM c2),
accepted AS MATERIALIZED (SELECT *, CASE WHEN quality = 'decisive_low_similarity' THEN 'decisive_low_similarity_claim'
    ELSE 'clear_claim' END AS accepted_by FROM (
  SELECT *, row_number() OVER (PARTITION BY grp, key ORDER BY strength DESC, score DESC, number) AS o1,
    row_number() OVER (PARTITION BY grp, number ORDER BY strength DESC, score DESC, key) AS o2
  FROM claims WHERE auto_accept) WHERE o1 = 1 AND o2 = 1),
pending AS MATERIALIZED (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY grp, key ORDER BY strength DESC, score DESC, number) AS rank FROM claims c
  WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.grp = c.grp AND a.key = c.key)
    AND NOT EXISTS (SELECT 1 FROM accepted a WHERE a.grp = c.grp AND a.number = c.number)) WHERE rank <= 2)"""


R6, R9 = "round({0}, 6) AS {0}", "round({0}, 9) AS {0}"
CLAIM_COLS = ("grp", "key", "number", "suspect", "runner_up_number", "rip_runner_up_key", "neighbor_number", "quality",
              "reasons", "needs_verify", "auto_accept")
CLAIM_NUMS = ("score", "runner_up_score", "rip_runner_up_score", "neighbor_score", "rip_margin", "ref_margin",
              "neighbor_margin", "confidence", "strength")
CLAIM_SELECT = ", ".join(CLAIM_COLS) + ", " + ", ".join(R6.format(c) for c in CLAIM_NUMS)


def show(df: DataFrame, cols=CLAIM_COLS, nums=CLAIM_NUMS, places: int = 6) -> DataFrame:
    return df.select(*cols, *[F.round(c, places).alias(c) for c in nums])


@query("tf_vectors", f"""WITH d AS (SELECT 1 AS grp, doc_id AS doc, text FROM documents), {vec_sql('d', 'v')}
SELECT doc, term, tf, round(weight, 6) AS weight FROM v""")
def tf_vectors(t):
    v = V.tf_vectors(rips(t).withColumnRenamed("key", "doc"))
    return v.select("doc", "term", "tf", F.round("weight", 6).alias("weight"))


@query("idf", f"""WITH d AS (SELECT 1 AS grp, item_id AS doc, text FROM benchmark), {vec_sql('d', 'v')}, {idf_sql('v', 'i')}
SELECT term, df, n_docs, round(idf, 6) AS idf FROM i""")
def idf(t):
    v = V.tf_vectors(refs(t).withColumnRenamed("number", "doc"))
    return V.idf(v).select("term", "df", "n_docs", F.round("idf", 6).alias("idf"))


@query("tfidf_vectors", f"{pairs_sql()} SELECT doc, term, round(weight, 6) AS weight FROM rw")
def tfidf_vectors(t):
    table = V.idf(V.tf_vectors(refs(t).withColumnRenamed("number", "doc")))
    return V.tfidf_vectors(V.tf_vectors(rips(t).withColumnRenamed("key", "doc")), table).select("doc", "term", F.round("weight", 6).alias("weight"))


PAIR_NUMS = ("weighted", "raw", "score")


@query("score_pairs", f"{pairs_sql()} SELECT key, number, {', '.join(R9.format(c) for c in PAIR_NUMS)} FROM pairs")
def score_pairs(t):
    return show(L.score_pairs(rips(t), refs(t)), ("key", "number"), PAIR_NUMS, 9)


@query("top_match_per_document", f"""{pairs_sql()} SELECT key, number, {', '.join(R9.format(c) for c in PAIR_NUMS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY grp, key ORDER BY score DESC, number) AS rn FROM pairs) WHERE rn = 1""")
def top_match(t):
    return show(L.top_match(L.score_pairs(rips(t), refs(t))), ("key", "number"), PAIR_NUMS, 9)


@query("near_duplicate_documents", f"""WITH d AS (SELECT 1 AS grp, min(doc_id) AS doc, text FROM documents GROUP BY text),
{vec_sql('d', 'v')}
SELECT * FROM (SELECT a.doc AS a, b.doc AS b, round(sum(a.weight * b.weight), 9) AS score
  FROM v a JOIN v b ON a.grp = b.grp AND a.term = b.term AND a.doc < b.doc GROUP BY ALL) WHERE score >= 0.92""")
def near_duplicates(t):
    """All documents with each other; `exact_copies` names the members of each representative."""
    d = rips(t).withColumnRenamed("key", "doc")
    return V.near_duplicates(d).select("a", "b", "score")


@query("exact_copies", "SELECT doc_id AS doc, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents")
def exact_copies(t):
    return V.representatives(rips(t).withColumnRenamed("key", "doc")).select("doc", "rep")


def _claims(t: Tables, groups: int, policy: MatchPolicy):
    r, f = rips(t, groups), refs(t, groups)
    # at the low bar of the shelves nearly every pair is a claim, so there all pairs are the input
    return r, f, L.build_claims(L.score_pairs(r, f) if groups else L.claim_pairs(r, f, policy), r, f, policy)


def _resolved(t: Tables, shelves: int = SHELVES):
    """Claims, acceptances and open candidates of the shelves."""
    r, f, c = _claims(t, shelves, EASY)
    c = cut_lineage(c)
    a = L.assign_one_to_one(c)
    return r, f, c, a, L.pending_candidates(c, a)


@query("neighbour_score", f"""{claims_sql(0, MatchPolicy())}
SELECT key, number, neighbor_number, round(neighbor_score, 9) AS neighbor_score FROM claims""")
def neighbour_score(t):
    p = L.claim_pairs(rips(t), refs(t))
    base = p.filter(F.col("score") >= MatchPolicy().min_similarity)
    return L.neighbour_scores(base, p).select("key", "number", "neighbor_number", F.round("neighbor_score", 9).alias("neighbor_score"))


@query("claims", f"{claims_sql(0, MatchPolicy())} SELECT {CLAIM_SELECT} FROM claims")
def claims(t):
    return show(_claims(t, 0, MatchPolicy())[2])


@query("claims_by_group", f"{claims_sql(SHELVES, EASY)} SELECT {CLAIM_SELECT} FROM claims")
def claims_by_group(t):
    return show(_claims(t, SHELVES, EASY)[2])


@query("assign_one_to_one", f"{claims_sql(SHELVES, EASY)} SELECT grp, key, number, accepted_by, {R6.format('strength')} FROM accepted")
def assign(t):
    return show(_resolved(t)[3], ("grp", "key", "number", "accepted_by"), ("strength",))


@query("pending_candidates", f"{claims_sql(SHELVES, EASY)} SELECT grp, key, number, rank, {R6.format('strength')} FROM pending")
def pending(t):
    return show(_resolved(t)[4], ("grp", "key", "number", "rank"), ("strength",))


@query("unclaimed_rips", f"{claims_sql(SHELVES, EASY)} SELECT grp, doc AS key FROM rips r WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.grp = r.grp AND c.key = r.doc)")
def unclaimed(t):
    r, _, c = _claims(t, SHELVES, EASY)
    return L.unclaimed(r, c)


@query("unresolved_rips", f"{claims_sql(SHELVES, EASY)} SELECT DISTINCT grp, key FROM pending")
def unresolved(t):
    _, _, _, a, p = _resolved(t)
    return L.unresolved(p, a)


HOLE_SQL = """, spans AS (SELECT grp, count(*) AS n, min(number) AS lo, max(number) AS hi, sum(number) AS s
  FROM (SELECT DISTINCT grp, number FROM accepted WHERE number > 0) GROUP BY grp),
holes AS (SELECT grp, (lo + hi) * (hi - lo + 1) // 2 - s AS missing FROM spans WHERE n >= 2 AND hi - lo = n),
lone AS (SELECT grp, max(key) AS key FROM (SELECT DISTINCT grp, key FROM pending) GROUP BY grp HAVING count(*) = 1),
filled AS (SELECT c.grp, c.key, c.number, greatest(0, c.confidence - 0.08) AS confidence
  FROM pending c JOIN lone USING (grp, key) JOIN holes h ON h.grp = c.grp AND h.missing = c.number
  JOIN refs f ON f.grp = c.grp AND f.doc = c.number
  JOIN pending b ON b.grp = c.grp AND b.key = c.key AND b.rank = 1
  WHERE NOT c.suspect AND NOT (b.number <> c.number AND (b.score >= c.score + {m} OR b.confidence >= {k})))"""


@query("single_hole_fill", claims_sql(256, EASY) + HOLE_SQL.format(m=EASY.clear_margin, k=EASY.clear_confidence)
       + " SELECT grp, key, number, round(confidence, 6) AS confidence FROM filled")
def single_hole(t):
    _, f, _, a, p = _resolved(t, 256)
    return show(L.single_hole_fill(a, p, f, EASY), ("grp", "key", "number"), ("confidence",))


def verdicts(p: DataFrame) -> DataFrame:
    """Answers for two thirds of the pending pairs, as an outside reviewer's table would hold them."""
    return (p.select("grp", "key", "number").filter((F.col("key") + F.col("number")) % 3 != 2)
            .withColumn("same", (F.col("key") + F.col("number")) % 3 == 0))


@query("verdict_outcomes")
def verdict_outcomes(t):
    _, _, _, _, p = _resolved(t)
    p = cut_lineage(p)
    return L.verdict_outcomes(p, verdicts(p)).select("grp", "key", "number", "rank", "outcome")


@query("verdict_summary")
def verdict_summary(t):
    _, _, _, _, p = _resolved(t)
    p = cut_lineage(p)
    return L.verdict_summary(L.verdict_outcomes(p, verdicts(p)))


@query("confidence_counts", claims_sql(SHELVES, EASY) + f""" SELECT grp, count_if(quality = 'clear') AS clear,
  count_if(quality = 'decisive_low_similarity') AS decisive_low_similarity, count_if(quality = 'ambiguous') AS ambiguous,
  count_if(quality = 'contested') AS contested,
  count_if(quality = 'decisive_low_similarity' AND confidence >= 0.05 AND confidence < 0.08) AS decisive_in_band
  FROM claims GROUP BY grp""")
def confidence_counts(t):
    return L.confidence_counts(_claims(t, SHELVES, EASY)[2], 0.05, 0.08)


@query("resolution_counts", claims_sql(SHELVES, EASY) + """, o AS (SELECT grp, key, count(*) AS n, min_by(quality, rank) AS q FROM pending GROUP BY ALL),
oc AS (SELECT grp, count_if(q = 'decisive_low_similarity' AND n = 1) AS d,
  count_if(NOT (q = 'decisive_low_similarity' AND n = 1) AND (q = 'contested' OR n > 1)) AS c,
  count_if(NOT (q = 'decisive_low_similarity' AND n = 1) AND NOT (q = 'contested' OR n > 1)) AS a FROM o GROUP BY grp),
ac AS (SELECT grp, count_if(accepted_by = 'clear_claim') AS k, count_if(accepted_by <> 'clear_claim') AS d FROM accepted GROUP BY grp)
SELECT f.grp, coalesce(ac.k, 0) AS clear_matches, coalesce(ac.d, 0) + coalesce(oc.d, 0) AS decisive_matches,
  coalesce(oc.a, 0) AS ambiguous, coalesce(oc.c, 0) AS contested, f.n AS suspect_references
FROM (SELECT grp, count_if(suspect) AS n FROM refs GROUP BY grp) f LEFT JOIN ac USING (grp) LEFT JOIN oc USING (grp)""")
def resolution_counts(t):
    _, f, _, a, p = _resolved(t)
    return L.resolution_counts(a, p, f)


APPLIED_SQL = """, eps AS (SELECT doc_id % 128 AS grp, doc_id AS key, CASE WHEN doc_id % 97 = 5 THEN doc_id % 5 + 1 ELSE 0 END AS number0 FROM documents),
applied AS (SELECT e.grp, e.key, coalesce(a.number, e.number0) AS number, a.score AS match_score, a.confidence AS match_confidence,
  trim(substr(f.text, 1, 20), ' ') AS title,
  CASE WHEN a.confidence < 0.04 THEN 'low_confidence' WHEN a.number IS NOT NULL THEN 'matched'
    WHEN NOT EXISTS (SELECT 1 FROM claims c WHERE c.grp = e.grp AND c.key = e.key) THEN 'probable_extra' ELSE 'unresolved' END AS status
  FROM eps e LEFT JOIN accepted a ON a.grp = e.grp AND a.key = e.key LEFT JOIN refs f ON f.grp = a.grp AND f.doc = a.number)"""


def _applied(t: Tables):
    r, f, c, a, _ = _resolved(t)
    return L.apply_matches(episodes(t), a, L.unclaimed(r, c), season(t, SHELVES), EASY), f


@query("apply_matches", claims_sql(SHELVES, EASY) + APPLIED_SQL + """ SELECT grp, key, number, title, status,
  CASE status WHEN 'probable_extra' THEN 'no reference claims it, probably an extra'
    WHEN 'unresolved' THEN 'claimed, but not decided'
    WHEN 'low_confidence' THEN printf('decided with confidence %.3f, wanted %.2f', match_confidence, 0.04) ELSE '' END AS reasons,
  round(match_score, 6) AS match_score, round(match_confidence, 6) AS match_confidence FROM applied""")
def apply_matches(t):
    d, _ = _applied(t)
    return show(d.withColumn("reasons", F.array_join("reasons", "|")), ("grp", "key", "number", "title", "status", "reasons"),
                ("match_score", "match_confidence"))


@query("apply_summary", claims_sql(SHELVES, EASY) + APPLIED_SQL + """ SELECT grp, count(*) AS episodes, count_if(status = 'unresolved') AS unresolved,
  count_if(status = 'probable_extra') AS probable_extras, count_if(status = 'low_confidence') AS low_confidence FROM applied GROUP BY grp""")
def apply_summary(t):
    return L.apply_summary(_applied(t)[0])


@query("match_summary", claims_sql(SHELVES, EASY) + APPLIED_SQL + """ SELECT grp, count_if(number > 0) AS matched, count_if(number <= 0) AS unresolved,
  count(*) FILTER (match_confidence > 0 AND match_confidence < 0.04) AS low_confidence, any_value(n) AS "references",
  count(match_score) < 2 OR (count(match_score) = count(DISTINCT number) FILTER (match_score IS NOT NULL)
    AND max(number) FILTER (match_score IS NOT NULL) - min(number) FILTER (match_score IS NOT NULL) = count(match_score) - 1) AS contiguous
FROM applied JOIN (SELECT grp, count(*) AS n FROM refs GROUP BY grp) USING (grp) GROUP BY grp""")
def match_summary(t):
    d, f = _applied(t)
    return L.match_summary(d, f, EASY)


SCOPE_SQL = """WITH eps AS (SELECT doc_id % 512 AS grp, doc_id AS pos, n_chars AS duration,
  CASE WHEN doc_id % 97 = 5 THEN doc_id % 5 + 1 ELSE 0 END AS number FROM documents),
season AS (SELECT g.grp, item_id // 8 + 1 AS number FROM benchmark JOIN (SELECT DISTINCT grp FROM eps) g ON g.grp % 8 = item_id % 8),
firsts AS (SELECT grp, min(pos) AS p0, min_by(duration, pos) AS f, count(*) AS n,
  min(number) FILTER (number > 0) AS r_lo, max(number) FILTER (number > 0) AS r_hi FROM eps GROUP BY grp),
meds AS (SELECT grp, list(duration ORDER BY duration) AS l FROM eps JOIN firsts USING (grp) WHERE pos > p0 AND duration > 0 GROUP BY grp),
b AS (SELECT f.grp, f.n, r_lo, r_hi, f.grp % 4 AS disc, s_lo, s_hi,
  coalesce(f.n >= 3 AND f.f > 0 AND len(l) >= 2 AND f.f >= floor(l[len(l) // 2 + 1] * 1.8) AND f.f <= floor(l[len(l) // 2 + 1] * 2.4), false) AS dbl
  FROM firsts f LEFT JOIN meds USING (grp) JOIN (SELECT grp, min(number) AS s_lo, max(number) AS s_hi FROM season GROUP BY grp) USING (grp)),
k AS (SELECT *, greatest(0, n - (r_hi - r_lo + 1)) AS k, CASE WHEN dbl THEN n + 1 ELSE n END AS blk FROM b),
w AS (SELECT *, least(s_hi - r_hi, (k + 1) // 2 + greatest(0, k // 2 - (r_lo - s_lo))) AS up,
  least(r_lo - s_lo, k // 2 + greatest(0, (k + 1) // 2 - (s_hi - r_hi))) AS dn, greatest(2, blk // 4) AS pad FROM k),
x AS (SELECT s.grp, s.number, coalesce(s.number BETWEEN r_lo - dn AND r_hi + up, false) AS in_a,
  disc > 0 AND s.number BETWEEN (disc - 1) * blk + 1 - pad AND disc * blk + pad AS in_b,
  row_number() OVER (PARTITION BY s.grp ORDER BY s.number) <= greatest(2 * n, 1) AS in_c FROM season s JOIN w USING (grp)),
y AS (SELECT *, bool_or(in_a) OVER (PARTITION BY grp) AS has_a, bool_or(in_b) OVER (PARTITION BY grp) AS has_b FROM x)
SELECT grp, number, CASE WHEN has_a THEN 'resolved_episode_scope' WHEN has_b THEN 'disc_block_estimate' ELSE 'season_prefix_fallback' END AS scope
FROM y WHERE CASE WHEN has_a THEN in_a WHEN has_b THEN in_b ELSE in_c END"""


@query("block_candidates", SCOPE_SQL)
def block_candidates(t):
    e = episodes(t, 512)
    return L.block_candidates(e, season(t, 512), e.select("grp", (F.col("grp") % 4).alias("disc")).distinct())


SCOPE_BODY = SCOPE_SQL.removeprefix("WITH ")
SCOPE_CTES, SCOPE_PICK = SCOPE_BODY.split("\nSELECT grp, number, CASE", 1)


@query("expand_scope", claims_sql(512, EASY) + ", " + SCOPE_CTES + ", sc AS (SELECT grp, number, CASE" + SCOPE_PICK + """),
q AS (SELECT grp, count(*) AS n_scope FROM sc GROUP BY grp), nn AS (SELECT grp, count(*) AS n_season FROM season GROUP BY grp), nr AS (SELECT grp, count(*) AS n_rips FROM rips GROUP BY grp),
na AS (SELECT grp, count(*) AS n_acc FROM accepted a WHERE EXISTS (SELECT 1 FROM sc WHERE sc.grp = a.grp AND sc.number = a.number) GROUP BY grp),
ns AS (SELECT grp, count(*) AS n_sus FROM refs f WHERE suspect AND EXISTS (SELECT 1 FROM sc WHERE sc.grp = f.grp AND sc.number = f.doc) GROUP BY grp)
SELECT grp, reason FROM (SELECT grp, CASE WHEN coalesce(n_acc, 0) < n_rips THEN 'initial_scope_left_unresolved_titles' WHEN coalesce(n_sus, 0) > 0 THEN 'initial_scope_contains_suspect_references' END AS reason
  FROM q JOIN nn USING (grp) JOIN nr USING (grp) LEFT JOIN na USING (grp) LEFT JOIN ns USING (grp) WHERE n_scope < n_season) WHERE reason IS NOT NULL""")
def expand_scope(t):
    r, f, c, a, _ = _resolved(t, 512)
    e = episodes(t, 512)
    sc = cut_lineage(L.block_candidates(e, season(t, 512), e.select("grp", (F.col("grp") % 4).alias("disc")).distinct()))
    return L.expand_scope(sc, season(t, 512), r, a.join(sc, ["grp", "number"], "left_semi"), f)


@query("opening_double_shift", """WITH eps AS (SELECT l_orderkey AS grp, l_orderkey % 2 + 1 AS disc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos, l_quantity AS duration FROM lineitem),
e AS (SELECT *, pos + l_start - 1 AS number FROM (SELECT *, CASE WHEN grp % 3 = 0 THEN 2 ELSE 1 END AS l_start FROM eps)),
m AS (SELECT grp, list(duration ORDER BY duration) FILTER (pos > 1) AS l, max(duration) FILTER (pos = 1) AS f, count(*) AS n FROM e GROUP BY grp),
h AS (SELECT grp, n >= 3 AND f >= floor(l[len(l) // 2 + 1] * 1.8::DOUBLE) AND f <= floor(l[len(l) // 2 + 1] * 2.4::DOUBLE) AND grp % 2 = 0 AS shifted FROM m)
SELECT e.grp, pos, CASE WHEN coalesce(shifted, false) THEN CASE WHEN pos = 1 THEN 1 WHEN l_start = 1 THEN number + 1 ELSE number END ELSE number END AS new_number,
  CASE WHEN shifted AND pos = 1 THEN 2 END AS number_end, coalesce(shifted, false) AS shifted FROM e JOIN h USING (grp)""")
def opening_double_shift(t):
    start = F.when(F.col("item_id") % 3 == 0, 2).otherwise(1)
    e = V2.members(t).select(F.col("item_id").alias("grp"), (F.col("item_id") % 2 + 1).alias("disc"), F.col("ord").alias("key"), F.col("ord").alias("pos"),
                             (F.col("ord") + start - 1).alias("number"), F.col("l_quantity").alias("duration"))
    s = t.orders.select(F.col("o_orderkey").alias("grp"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("number")).withColumn("name", F.lit("Episode"))
    return L.opening_double_shift(e, s).select("grp", "pos", "new_number", "number_end", "shifted")
