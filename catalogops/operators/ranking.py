"""Ranking candidates: reference search results, subtitle files, catalogue hits, cache selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogops.functions.titles import comparison_key, comparison_tokens, candidate_text, episode_markers, looks_like_pack

KEEP_FILES = 3
# Catalogue acceptance limits.
EXACT_MIN_AVERAGE, OTHER_MIN_AVERAGE, OTHER_BASE = 2.0, 3.0, 1.3


def title_mention(texts: DataFrame, titles: DataFrame, keys: list[str]) -> DataFrame:
    """Per text: does it contain its target's title, and the title of any other number of the same key.

    `texts` (keys, text_id, number, text), `titles` (keys, number, name).  The titles of a key, the episodes of one
    season, travel as one list, so every text stays one row.
    """
    named = titles.select(*keys, F.struct(F.col("number").alias("n"), candidate_text(F.col("name")).alias("t")).alias("x")).filter("x.t <> ''")
    listed = named.groupBy(*keys).agg(F.collect_set("x").alias("_titles"))
    d = texts.withColumn("_x", candidate_text(F.col("text"))).join(listed, keys, "left")

    def named_by(which) -> Column:
        return F.coalesce(F.exists("_titles", lambda x: which(x["n"]) & F.contains(F.col("_x"), x["t"])), F.lit(False))

    return d.select(*texts.columns, named_by(lambda n: n == F.col("number")).alias("target"), named_by(lambda n: n != F.col("number")).alias("other"))


def score_references(cands: DataFrame, titles: DataFrame) -> DataFrame:
    """Score, diagnostics and suspect reason of every candidate.

    `cands` (season, number, text_id, text, downloads, hearing_impaired), `titles` (season, number, name).
    """
    d = title_mention(cands, titles, ["season"])
    marks = episode_markers(F.col("text"))
    exact = F.exists(marks, lambda m: (m["season"] == F.col("season")) & (m["episode"] == F.col("number")))
    d = d.withColumns({"exact": exact, "pack": looks_like_pack(F.col("text"), F.col("season"))})
    score = (F.log10(F.col("downloads") + F.lit(1.0)) * 12 + F.when(~F.col("hearing_impaired"), 20).otherwise(0)
             + F.when(F.col("exact"), 35).otherwise(0) + F.when(F.col("target"), 70).otherwise(0)
             - F.when(F.col("other"), 140).otherwise(0) - F.when(F.col("pack"), 90).otherwise(0))
    d = d.withColumn("score", F.round(score, 9))
    reason = (F.when(F.col("other"), "candidate_names_different_episode_title")
              .when(~F.col("target") & ~F.col("exact"), "candidate_lacks_target_title_and_episode_marker")
              .when(F.col("pack") & ~F.col("target"), "candidate_looks_like_multi_episode_pack")
              .when(F.col("score") < 0, "candidate_score_below_trust_floor"))
    return d.withColumn("suspect_reason", reason).withColumn("suspect", F.col("suspect_reason").isNotNull())


def rank_references(cands: DataFrame, titles: DataFrame) -> DataFrame:
    """Best candidate per (season, number): the first that is not suspect, else the best suspect."""
    d = score_references(cands, titles)
    order = F.struct(F.col("suspect"), -F.col("score"), F.col("text_id"))
    top = F.min(F.struct(-F.col("score"), F.col("text_id")))
    g = d.groupBy("season", "number").agg(F.min_by(F.struct("text_id", "score", "suspect", "suspect_reason"), order).alias("b"), top.alias("t"))
    fallback = ~F.col("b.suspect") & (F.col("b.text_id") != F.col("t.text_id"))
    reason = F.when(fallback, "fallback_to_non_suspect_candidate").otherwise(F.col("b.suspect_reason"))
    return g.select("season", "number", F.col("b.text_id").alias("text_id"), F.col("b.score").alias("score"),
                    F.col("b.suspect").alias("suspect"), fallback.alias("fallback"), F.coalesce(reason, F.lit("highest_scoring_candidate")).alias("reason"))


def top_files(hits: DataFrame, local: DataFrame | None = None, keep: int = KEEP_FILES) -> DataFrame:
    """Best files per wanted episode: exact marker, not hearing-impaired, downloads, id; a local reference first.

    `hits` (want, season, episode, release, downloads, foreign_only, hearing_impaired, file_id, file_name); season 0
    stands for a film.  Files whose own name (else the release) marks another episode are dropped.
    """
    own = episode_markers(F.col("file_name"))
    marks = F.when(F.size(own) > 0, own).otherwise(episode_markers(F.col("release")))
    tv = (F.col("season") > 0) & (F.col("episode") > 0)
    exact = tv & F.exists("_m", lambda m: (m["season"] == F.col("season")) & (m["episode"] == F.col("episode")))
    d = (hits.filter(~F.col("foreign_only") & (F.col("file_id") > 0)).withColumn("_m", marks).withColumn("exact", exact)
         .filter(~tv | (F.size("_m") == 0) | F.col("exact")).withColumn("is_local", F.lit(False)))
    d = d.select("want", "file_id", "exact", F.col("hearing_impaired").alias("hi"), "downloads", "is_local")
    if local is not None:
        d = d.unionByName(local.select("want", "file_id", F.lit(False).alias("exact"), F.lit(False).alias("hi"),
                                       F.lit(0).cast(hits.schema["downloads"].dataType).alias("downloads"), F.lit(True).alias("is_local")))
    order = F.struct(~F.col("is_local"), ~F.col("exact"), F.col("hi"), -F.col("downloads"))
    best = d.groupBy("want", "file_id").agg(F.min(order).alias("o"))
    w = Window.partitionBy("want").orderBy("o", "file_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).select("want", "rank", "file_id")


def alias_match(query: Column, title: Column) -> Column:
    """Query words align with title words one to one, or with the initials of a run of title words.

    A fold over the query words keeps the set of title positions reached so far.
    """
    q, t = comparison_tokens(query), comparison_tokens(title)
    start = F.array(F.lit(0))

    def step(reach: Column, word: Column) -> Column:
        def ends(p: Column) -> Column:
            whole = F.when(F.get(t, p) == word, F.array(p + 1)).otherwise(F.array().cast("array<int>"))
            n = F.length(word)
            initials = F.array_join(F.transform(F.slice(t, p + 1, n), lambda w: F.substring(w, 1, 1)), "")
            run = F.when((n > 0) & (p + n <= F.size(t)) & (initials == word), F.array(p + n)).otherwise(F.array().cast("array<int>"))
            return F.concat(whole, run)

        return F.array_distinct(F.flatten(F.transform(reach, ends)))

    reached = F.aggregate(q, start, step)
    return (F.size(q) > 0) & (F.size(t) > 0) & F.array_contains(reached, F.size(t))


def best_search_hit(queries: DataFrame, results: DataFrame, min_votes: int = 5, aliases: bool = True) -> DataFrame:
    """Accepted hit per query or no row.

    `queries` (query_id, query, year), `results` (query_id, pos, id, title, date, vote_average, vote_count).
    """
    d = results.join(queries.select("query_id", "query", "year"), "query_id")
    named = F.contains(F.lower("title"), F.lower("query"))
    if aliases:
        named = named | alias_match(F.col("query"), F.col("title"))
    score = F.when(named, 1.0).otherwise(0.0) + F.col("vote_average") / 10 + F.col("vote_count") / 1000
    year = F.coalesce(F.substring("date", 1, 4).try_cast("int"), F.lit(0))
    exact = (comparison_key(F.col("title")) == comparison_key(F.col("query"))) & ((F.col("year") <= 0) | (year == F.col("year")))
    d = d.withColumns({"score": F.round(score, 9), "exact": exact}).filter("score > 0")
    row = F.struct("id", "title", "score", "exact", "vote_average", "vote_count")
    order = F.struct(-F.col("score"), F.col("pos"))
    g = d.groupBy("query_id").agg(F.min_by(row, order).alias("best"), F.min_by(row, F.when(F.col("exact"), order)).alias("ex"))
    prefer = F.coalesce((F.col("ex.vote_average") >= EXACT_MIN_AVERAGE) & (F.col("ex.vote_count") >= min_votes), F.lit(False))
    s = g.select("query_id", F.when(prefer, F.col("ex")).otherwise(F.col("best")).alias("s")).select("query_id", "s.*")
    good = F.when(F.col("exact"), (F.col("vote_average") >= EXACT_MIN_AVERAGE) & (F.col("vote_count") >= min_votes)).otherwise(
        (F.col("vote_average") >= OTHER_MIN_AVERAGE) & (F.col("score") >= F.round(OTHER_BASE + F.col("vote_count") / 1000, 9)))
    return s.filter(good)


def best_by_rank(rows: DataFrame, keys: list[str], kind: str, preference: tuple[str, ...], usable: Column) -> DataFrame:
    """Per key the usable row of the first available kind."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(kind))
    value = F.struct(*[c for c in rows.columns if c not in keys])
    g = rows.groupBy(*keys).agg(F.min_by(value, F.when(usable & (rank > 0), rank)).alias("b")).filter("b is not null")
    return g.select(*keys, "b.*")


def best_probe(assets: DataFrame) -> DataFrame:
    """First completed of final, subtitled, encoded per (item_id, key)."""
    done = (F.coalesce("path", F.lit("")) != "") & (F.coalesce("status", F.lit("")) != "failed")
    return best_by_rank(assets, ["item_id", "key"], "kind", ("final", "subtitled", "encoded"), done)


def first_by_fingerprint(items: DataFrame) -> DataFrame:
    """Oldest item of every fingerprint."""
    first = F.min_by("item_id", F.struct("created_at", "item_id"))
    return items.filter("fingerprint <> ''").groupBy("fingerprint").agg(first.alias("item_id"), F.count(F.lit(1)).alias("n"))


def resolve_by_prefix(entries: DataFrame, selectors: DataFrame) -> DataFrame:
    """Each selector resolved to an entry: by row number, else by unique id prefix in any case.

    `entries` (number, fingerprint), `selectors` (sel_pos, selector).  Prefixes are matched by equality: an entry is
    spread over the prefix lengths that occur among the selectors, at most the length of an id.
    """
    s = selectors.withColumn("sel", F.lower(F.trim("selector")))
    whole = F.when(F.col("sel").rlike(r"^[+-]?\d+$"), F.col("sel").try_cast("long"))  # 12E5 and 1.5 are no row numbers
    by_number = (s.select("sel_pos", whole.alias("number")).filter("number is not null")
                 .join(entries.select("number", "fingerprint"), "number").select("sel_pos", F.col("fingerprint").alias("hit")))
    rest = s.join(by_number.select("sel_pos"), "sel_pos", "left_anti").filter("sel <> ''")
    fp = F.lower("fingerprint")
    spread = entries.select("fingerprint", fp.alias("f"), F.explode(F.sequence(F.lit(1), F.length(fp))).alias("n")).filter("f <> ''")
    sizes = rest.select(F.length("sel").alias("n")).distinct()  # one row per prefix length
    keyed = spread.join(sizes, "n", "left_semi").select("fingerprint", F.expr("left(f, n)").alias("sel"))
    # one row per prefix before the join, so that a short prefix of many entries costs a selector one row
    m = rest.join(keyed.groupBy("sel").agg(F.count(F.lit(1)).alias("n"), F.min("fingerprint").alias("hit")), "sel").select("sel_pos", "n", "hit")
    d = s.join(by_number.withColumnRenamed("hit", "num_hit"), "sel_pos", "left").join(m, "sel_pos", "left")
    status = (F.when(F.col("sel") == "", "required").when(F.col("num_hit").isNotNull() | (F.col("n") == 1), "found")
              .when(F.col("n") > 1, "ambiguous").otherwise("not_found"))
    d = d.withColumns({"status": status, "fingerprint": F.coalesce("num_hit", F.when(F.col("n") == 1, F.col("hit")))})
    firsts = d.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min("sel_pos").alias("first_pos"))
    return (d.join(firsts, "fingerprint", "left")
            .select("sel_pos", "selector", "status", "fingerprint", F.coalesce(F.col("first_pos") < F.col("sel_pos"), F.lit(False)).alias("repeated")))
