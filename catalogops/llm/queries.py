"""One registered query per corpus operator, over the whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.llm import centroids, chat, decontam, htmlmain, langid, linetree, mixing, neardup, quality, sketch, suffixes, toxicity, turntrie
from catalogops.llm.common import table


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sketch.neighbour_fingerprints(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {f.__name__: f for f in (op2_language_id, op4_toxicity, op6_quality, op9_fingerprints)}
SQL: dict[str, str] = {}


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


QUERIES["op10_near_duplicates"] = op10_near_duplicates
SQL["op10_near_duplicates"] = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hits >= 80 * (x.n + y.n - hits)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT g.b, r.seen FROM r JOIN g ON g.a = r.doc_id AND r.seen < g.b)
SELECT r.doc_id, n.n AS n_shingles, min(seen) AS component_id, r.doc_id = min(seen) AS kept FROM r JOIN n USING (doc_id) GROUP BY r.doc_id, n.n"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256")
    return decontam.contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


QUERIES["op3_decontamination"] = op3_decontamination
WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL["op3_decontamination"] = f"""
WITH i AS (SELECT item_id::VARCHAR AS item, {WORDS_SQL} AS w FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT item, array_to_string(w[k:k + 12], ' ') AS phrase, len(w[k:k + 12]) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS MATERIALIZED (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, k, array_to_string(w[k:k + n - 1], ' ') AS phrase, n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d), (SELECT DISTINCT n FROM p) WHERE k + n - 1 <= len(w)),
m AS MATERIALIZED (SELECT t.doc_id, t.k, t.n, p.item FROM t JOIN p ON t.phrase = p.phrase AND t.n = p.n),
h AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM m) GROUP BY doc_id),
j AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(j.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN j USING (doc_id)"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linetree.drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"), "text")


QUERIES["op8_line_dedup"] = op8_line_dedup
SPACES_SQL = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in linetree.SPACES) + "]"
SPACED_SQL = f"trim(regexp_replace(regexp_replace(regexp_replace(line, '{SPACES_SQL}', ' ', 'g'), '([{linetree.UNSPACED}])', ' \\1 ', 'g'), ' +', ' ', 'g'), ' ')"
FIELD_SQL = "regexp_replace(l, '[^ ]*[0-9][^ ]*', '<*>', 'g')"
MASK_SQL = f"CASE WHEN regexp_matches(l, '[0-9]') AND (length({FIELD_SQL}) - length(replace({FIELD_SQL}, '<*>', ''))) / 3 * 2 <= length(l) - length(replace(l, ' ', '')) + 1 THEN {FIELD_SQL} ELSE l END"
OFTEN_SQL = """HAVING count(*) >= 3 AND count(*) * max(n) >= 30 OR count(*) >= 2 AND max(n) >= 30 AND starts_with(key, 'L')"""
SQL["op8_line_dedup"] = f"""
WITH raw AS MATERIALIZED (SELECT doc_id, k, line, l, {MASK_SQL} AS m FROM (SELECT doc_id, k, line, {SPACED_SQL} AS l FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents))),
s AS MATERIALIZED (SELECT *, len(t) AS n, array_to_string(t[1:3], ' ') AS head FROM (SELECT DISTINCT doc_id, m, string_split(m, ' ') AS t FROM raw) WHERE len(t) >= 3),
leaf AS MATERIALIZED (SELECT n, head, count(*) AS lines FROM (SELECT DISTINCT doc_id, l, m FROM raw) JOIN s USING (doc_id, m) GROUP BY ALL HAVING count(*) >= 3 OR count(*) >= 2 AND n >= 30),
sh AS MATERIALIZED (SELECT s.* FROM s JOIN leaf USING (n, head)),
u AS MATERIALIZED (SELECT n, head, m, t, count(*) AS docs FROM sh GROUP BY ALL),
pl AS MATERIALIZED (SELECT n, head, m, docs, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM u),
sup AS (SELECT n, head, pos, token FROM (SELECT n, head, pos, token, sum(docs) AS docs FROM pl WHERE token <> '<*>' GROUP BY ALL HAVING sum(docs) >= 3) JOIN leaf USING (n, head) WHERE docs * 20 >= lines),
con AS (SELECT * FROM sup JOIN (SELECT n, head, pos FROM sup GROUP BY ALL HAVING count(*) <= 20) USING (n, head, pos)),
tp AS (SELECT pl.n, pl.head, pl.m, count(con.token) FILTER (pl.pos > 3) AS c, string_agg(pl.pos || '=' || con.token, ' ' ORDER BY pl.pos) FILTER (con.token IS NOT NULL) AS parts
  FROM pl LEFT JOIN con ON pl.n = con.n AND pl.head = con.head AND pl.pos = con.pos AND pl.token = con.token GROUP BY ALL),
te AS (SELECT m, CASE WHEN c >= 0.5 * (n - 3) THEN 'T' || n || '|' || head || '|' || coalesce(parts, '') ELSE 'L' || m END AS template FROM tp),
seen AS MATERIALIZED (SELECT doc_id, m, n, template, unnest(CASE WHEN n >= 30 THEN list_distinct([template, 'L' || m]) ELSE [template] END) AS key FROM sh JOIN te USING (m)),
cand AS (SELECT key FROM (SELECT DISTINCT key, doc_id, n FROM seen) GROUP BY key {OFTEN_SQL}),
ins AS (SELECT doc_id, sum(strlen(m)) AS inside FROM (SELECT DISTINCT doc_id, m FROM seen WHERE key IN (FROM cand)) GROUP BY doc_id),
cop AS (SELECT doc_id FROM ins JOIN documents USING (doc_id) WHERE inside >= 0.8 * strlen(text)),
vot AS (SELECT key FROM (SELECT DISTINCT key, doc_id, n FROM seen WHERE doc_id NOT IN (FROM cop)) GROUP BY key {OFTEN_SQL}),
hit AS MATERIALIZED (SELECT DISTINCT doc_id, m, template FROM seen WHERE key IN (FROM vot)),
los AS MATERIALIZED (SELECT doc_id, string_agg(DISTINCT template, chr(10) ORDER BY template) AS tset, sum(strlen(m)) < 0.8 * any_value(strlen(text)) AS carrier FROM hit JOIN documents USING (doc_id) GROUP BY doc_id),
los_ok AS (SELECT doc_id FROM los WHERE carrier OR tset IN (SELECT tset FROM los WHERE carrier GROUP BY tset HAVING count(*) >= 3)),
gone AS MATERIALIZED (SELECT doc_id, m FROM hit WHERE doc_id IN (FROM los_ok)),
out AS (SELECT raw.doc_id, count(*) AS n_lines, count(gone.m) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (gone.m IS NULL), '') AS text
  FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.m = gone.m GROUP BY raw.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(out.text) AS text_sha256, out.text AS text FROM documents d LEFT JOIN out USING (doc_id)"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op7_mixing"] = op7_mixing


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_texts(table(spark, sf_dir, "pages"))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_preferences(chat.preference_pairs(table(spark, sf_dir, "conversations")))
    flat = [F.array_join(F.transform(f"{s}_spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(f"{s}_spans") for s in ("chosen", "rejected")]
    return out.select("pair_id", "kind", "n_shared", "prompt", "chosen_completion", "rejected_completion", *flat)


QUERIES |= {"op1_main_text": op1_main_text, "op5_preferences": op5_preferences}
HEAD_SQL = "'<|im_start|>' || role || chr(10)"
SQL["op5_preferences"] = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, role, text FROM t),
a AS (SELECT conv_id, max(i) AS hi, min(i) AS lo FROM n WHERE role = 'assistant' GROUP BY conv_id HAVING max(i) > 0),
p AS (SELECT conv_id, string_agg({HEAD_SQL} || text || '<|im_end|>' || chr(10), '' ORDER BY i) AS prompt FROM n JOIN a USING (conv_id) WHERE i < hi GROUP BY conv_id),
v AS (SELECT a.conv_id, hi, l.text AS good, f.text AS earlier, lo FROM a JOIN n l ON l.conv_id = a.conv_id AND l.i = a.hi JOIN n f ON f.conv_id = a.conv_id AND f.i = a.lo),
w AS (SELECT conv_id, hi, good, 'truncated' AS kind, left(good, length(good) // 2) AS bad FROM v UNION ALL SELECT conv_id, hi, good, 'repeated', earlier FROM v WHERE lo < hi)
SELECT conv_id AS pair_id, kind, hi::INT AS n_shared, prompt, '<|im_start|>assistant' || chr(10) || good || '<|im_end|>' || chr(10) AS chosen_completion,
  '<|im_start|>assistant' || chr(10) || bad || '<|im_end|>' || chr(10) AS rejected_completion,
  '22-' || (22 + length(good) + 11) AS chosen_spans, '22-' || (22 + length(bad) + 11) AS rejected_spans FROM w JOIN p USING (conv_id) WHERE good <> bad"""



def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES["op12_prefix_trie"] = op12_prefix_trie
#: crc32 of a short ASCII text, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[(ascii(ch) >> i) & 1 FOR i IN range(8)] FOR ch IN string_split({0}, '')])),
  lambda c, b: xor(c >> 1, (xor(c, b::BIGINT) & 1) * 3988292384)))"""
SQL["op12_prefix_trie"] = f"""
WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC32_SQL.format('conv_id::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
s AS MATERIALIZED (SELECT c.conv_id, coalesce((SELECT list({{'r': role, 't': text}} ORDER BY pos) FROM t WHERE t.conv_id = c.base AND pos <= h), [])
  || coalesce((SELECT list({{'r': role, 't': text}} ORDER BY pos) FROM t WHERE t.conv_id = c.conv_id AND pos > h), []) AS s FROM c),
p AS (SELECT conv_id, s[1:d] AS p, d, len(s) = d AS ended FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM s)),
n AS MATERIALIZED (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, CASE d WHEN 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].t) END AS saved,
  sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends FROM p GROUP BY p, d),
k AS MATERIALIZED (SELECT n.p, n.d, count(x.d) AS children FROM n LEFT JOIN n x ON x.d = n.d + 1 AND x.p[1:n.d] = n.p GROUP BY n.p, n.d),
u AS (SELECT n.p, n.d, sum(x.saved) AS saved, count(*) FILTER (k.children = 0) AS leaves FROM n JOIN n x ON x.d >= n.d AND x.p[1:n.d] = n.p JOIN k ON k.d = x.d AND k.p = x.p GROUP BY n.p, n.d)
SELECT n.conv_id, n.d::BIGINT AS depth, (SELECT y.conv_id FROM n y WHERE y.d = n.d - 1 AND y.p = n.p[1:n.d - 1]) AS parent_conv_id, n.n AS n_convs, k.children AS n_children,
  u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256 FROM n JOIN k ON k.d = n.d AND k.p = n.p JOIN u ON u.d = n.d AND u.p = n.p"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


QUERIES["op13_centroids"] = op13_centroids


def _centroid_sql(rounds: int) -> str:
    place = "SELECT i, vec_id, v, min(list_sum([(v[j] - c[j]) * (v[j] - c[j]) FOR j IN range(1, 65)])::BIGINT * 8 + k) AS m FROM v, c{0} GROUP BY ALL"
    steps = [f"""a{r} AS MATERIALIZED ({place.format(r)}),
m{r} AS MATERIALIZED (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (SELECT m % 8 AS k, j, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT m, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY ALL) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))""" for r in range(rounds)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM v ORDER BY h, v LIMIT 8)),
{(',' + chr(10)).join(steps)},
z AS MATERIALIZED (SELECT vec_id, m % 8 AS k, m // 8 AS distance FROM ({place.format(rounds)}))
SELECT vec_id, z.k::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY z.k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c{rounds} x ON x.k = z.k"""


SQL["op13_centroids"] = _centroid_sql(10)


def op11_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op11_repeated_bytes"] = op11_repeated_bytes
