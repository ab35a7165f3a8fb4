"""Term vectors, inverse document frequency and sparse cosine similarity.

Documents are rows (grp, doc, text); vectors are long tables (grp, doc, term, weight).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogops.operators.cosine import blocks_of, packed, similar_pairs
from catalogops.operators.skew import dealt_by_text, parts_by_text
from catalogops.session import store

# Fixed values of the text fingerprint.
TOKEN_SPLIT = "[^a-z0-9]+"
MIN_TOKEN = 3
SAME_TEXT = 0.92
# Sums of products depend on the order of addition in the last bits; scores are cut to this many places so
# that exact copies tie exactly whatever the partitioning.
PLACES = 9
#: Terms of documents that one task meets with posting lists: some 350 MB of memory.
PASS_ROWS = 500_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: F.length(t) >= MIN_TOKEN)


def _normalise(weighted: DataFrame) -> DataFrame:
    doc = Window.partitionBy("grp", "doc")
    return weighted.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(doc))).drop("w")


def tf_vectors(docs: DataFrame) -> DataFrame:
    """L2-normalised term frequencies; a document without tokens has no rows.

    The text is placed by document once, before it is exploded; counting and the norm then need no shuffle.
    """
    return tf_of_terms(dealt_by_text(docs.select("grp", "doc", "text"), "text", "grp", "doc")
                       .select("grp", "doc", F.explode(tokens(F.col("text"))).alias("term")))


def tf_of_terms(terms: DataFrame) -> DataFrame:
    """The same from one row (grp, doc, term) per token, for documents that span many rows."""
    counted = terms.groupBy("grp", "doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    return _normalise(counted.withColumn("w", F.col("tf").cast("double"))).select("grp", "doc", "term", "tf", "weight")


def idf(vectors: DataFrame) -> DataFrame:
    """ln((N+1)/(1+df)) per group and term; a group with a single document keeps raw weights (factor 1)."""
    sizes = vectors.select("grp", "doc").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("n_docs"))
    df = vectors.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("df"))
    factor = F.when(F.col("n_docs") < 2, F.lit(1.0)).otherwise(F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)))
    return df.join(sizes, "grp").select("grp", "term", "df", "n_docs", factor.alias("idf"))


def tfidf_vectors(vectors: DataFrame, idf_table: DataFrame) -> DataFrame:
    """Reweighted and renormalised; unknown terms keep their weight, zero weights and empty vectors vanish."""
    w = (vectors.select("grp", "doc", "term", "weight")
         .join(idf_table.select("grp", "term", "idf"), ["grp", "term"], "left")
         .withColumn("w", F.col("weight") * F.coalesce("idf", F.lit(1.0)))
         .filter(F.col("w") != 0))
    return _normalise(w.drop("weight", "idf")).select("grp", "doc", "term", "weight")


def cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """Dot product of normalised vectors for every pair of a group that shares a term."""
    a = left.select("grp", "term", F.col("doc").alias("a"), F.col("weight").alias("wa"))
    b = right.select("grp", "term", F.col("doc").alias("b"), F.col("weight").alias("wb"))
    return (a.join(b, ["grp", "term"]).groupBy("grp", "a", "b")
            .agg(F.round(F.sum(F.col("wa") * F.col("wb")), PLACES).alias("score")))


def known_vectors(vectors: DataFrame, idf_table: DataFrame) -> DataFrame:
    """(grp, doc, term, raw, weight): both weights of every term that the table knows; other terms count in the norm only."""
    doc = Window.partitionBy("grp", "doc")
    w = F.col("raw") * F.coalesce("idf", F.lit(1.0))
    d = (vectors.select("grp", "doc", "term", F.col("weight").alias("raw"))
         .join(idf_table.select("grp", "term", "idf"), ["grp", "term"], "left").withColumn("w", w))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(doc))
    weight = F.when(norm > 0, F.col("w") / norm).otherwise(0.0)
    return d.withColumn("weight", weight).filter("idf is not null").select("grp", "doc", "term", "raw", "weight")


def passes(table: DataFrame) -> list[DataFrame]:
    """A stored table in parts of whole documents, so many that a shuffle partition gets about PASS_ROWS rows of a part."""
    n = max(1, math.ceil(table.count() / (PASS_ROWS * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    return [table.filter(F.pmod(F.xxhash64("grp", "doc"), F.lit(n)) == i) for i in range(n)] if n > 1 else [table]


def pair_sums(left: DataFrame, right: DataFrame) -> DataFrame:
    """(grp, a, b, weighted, raw) of every pair that shares a term of weight on both sides; both products in one pass over each part of `left`."""
    b = right.select("grp", "term", F.col("doc").alias("b"), F.col("weight").alias("wb"), F.col("raw").alias("rb"))
    sums = [_both_products(part.select("grp", "term", F.col("doc").alias("a"), F.col("weight").alias("wa"), F.col("raw").alias("ra")).join(b, ["grp", "term"]))
            for part in passes(left)]
    # a union of unwritten passes would meet in one task again
    return reduce(DataFrame.unionByName, [store(one, "pass") for one in sums]) if len(sums) > 1 else sums[0]


def exact_sums(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The same for the given (grp, a, b) pairs only."""
    a = left.select("grp", F.col("doc").alias("a"), "term", F.col("weight").alias("wa"), F.col("raw").alias("ra"))
    b = right.select("grp", F.col("doc").alias("b"), "term", F.col("weight").alias("wb"), F.col("raw").alias("rb"))
    return _both_products(pairs.select("grp", "a", "b").join(a, ["grp", "a"]).join(b, ["grp", "b", "term"]))


def _both_products(met: DataFrame) -> DataFrame:
    product = F.col("wa") * F.col("wb")
    return (met.groupBy("grp", "a", "b").agg(F.round(F.sum(product), PLACES).alias("weighted"), F.round(F.sum(F.col("ra") * F.col("rb")), PLACES).alias("raw"),
                                             F.max(product).alias("_most")).filter("_most > 0").drop("_most"))


# --- exact search with upper bounds per posting list

#: Slack for sums that were added in another order.
SLACK = 10.0 ** (1 - PLACES)
SEED_TERMS = 4
#: Lists are left unread while all of them together can add at most this part of the bar; a pair is followed from the other part on.
UNREAD = 0.5


def list_bounds(corpus: DataFrame) -> DataFrame:
    """(grp, term, top): the largest weight in every posting list."""
    return corpus.groupBy("grp", "term").agg(F.max("weight").alias("top"))


def bounded_terms(queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """Terms of each query that the corpus behind `bounds` has, with `upto`, a bound of what all terms up to here can add to a score.

    Terms go up by the largest product a partner can add there (query weight times the largest weight in the posting list).  The bound is
    the sum of these products or the norm of the query's weights up to here, whichever is less.  `above` counts the terms behind.
    """
    doc = Window.partitionBy("grp", "doc")
    up = doc.orderBy("most", "term")
    sofar = up.rowsBetween(Window.unboundedPreceding, 0)
    d = queries.select("grp", "doc", "term", "weight").join(bounds, ["grp", "term"]).withColumn("most", F.col("weight") * F.col("top")).filter("most > 0")
    upto = F.least(F.sum("most").over(sofar), F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(sofar)))
    return d.select("grp", "doc", "term", "weight", upto.alias("upto"), (F.count(F.lit(1)).over(doc) - F.row_number().over(up)).alias("above"))


def _partial(terms: DataFrame, corpus: DataFrame, *kept: str) -> DataFrame:
    c = corpus.select("grp", "term", F.col("doc").alias("b"), F.col("weight").alias("wb"))
    return (terms.withColumnRenamed("doc", "a").join(c, ["grp", "term"]).groupBy("grp", "a", "b")
            .agg(F.sum(F.col("weight") * F.col("wb")).alias("partial"), *[F.max(k).alias(k) for k in kept]))


def reaching(terms: DataFrame, bar: Column | DataFrame, corpus: DataFrame) -> DataFrame:
    """Pairs (grp, a, b) that can score `bar`: one number for all, or (grp, doc, bar) per query, 0 where it has none.

    Posting lists that together can add no more than UNREAD of the bar are not read, and a pair is dropped, before anything is
    written, when the lists it shares and that bound stay below the bar.  No pair of that score is lost.
    """
    t = terms.withColumn("bar", bar) if isinstance(bar, Column) else terms.join(bar, ["grp", "doc"], "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
    unread = F.col("upto") < F.col("bar") * UNREAD
    t = t.withColumn("rest", F.coalesce(F.max(F.when(unread, F.col("upto"))).over(Window.partitionBy("grp", "doc")), F.lit(0.0)))
    read = store(t.filter(~unread).select("grp", "doc", "term", "weight", "rest", "bar"), "read-lists")
    met = _partial(read, corpus, "rest", "bar")
    return met.filter(F.col("partial") + F.col("rest") >= F.col("bar") - SLACK).select("grp", "a", "b")


def best_partners(queries: DataFrame, corpus: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """Pairs (grp, a, b) that hold the k best partners of every query, with all ties at the last place; few others.

    The k-th best sum over the SEED_TERMS terms of the largest bounds is a lower bound of the k-th best score, and so the bar.
    """
    terms = bounded_terms(queries, bounds)
    seeds = _partial(terms.filter(F.col("above") < SEED_TERMS), corpus)
    place = F.row_number().over(Window.partitionBy("grp", "a").orderBy(F.desc("partial")))
    kth = (seeds.withColumn("place", place).filter(F.col("place") <= k).groupBy("grp", F.col("a").alias("doc"))
           .agg(F.min("partial").alias("bar"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n"))
    return reaching(terms, kth, corpus)


def representatives(docs: DataFrame) -> DataFrame:
    """Exact copies collapsed: (grp, doc, rep) with the lowest id of the same text as representative."""
    hashed = docs.select("grp", "doc", F.sha2("text", 256).alias("h"))
    reps = hashed.groupBy("grp", "h").agg(F.min("doc").alias("rep"))
    return hashed.join(reps, ["grp", "h"]).select("grp", "doc", "rep")


def near_duplicates(docs: DataFrame, threshold: float = SAME_TEXT) -> DataFrame:
    """Pairs a < b of distinct texts with cosine >= threshold.

    Copies of one text are compared once, through their representative (see `representatives` for the
    members), so a large group of copies never multiplies into pairs.  All pairs of representatives are compared block by
    block (see `cosine`); the text moves once and no candidates are written.
    """
    docs = docs.select("grp", "doc", "text").dropna()
    reps = store(representatives(docs).filter("doc = rep").select(F.struct("grp", "doc").alias("key")), "representatives")
    # both are dealt by the same key, so neither the join nor the counting moves the text again
    parts = parts_by_text(docs, "text")
    text = docs.select(F.struct("grp", "doc").alias("key"), "text").repartition(parts, "key")
    once = text.join(reps.repartition(parts, "key"), "key", "left_semi")
    return similar_pairs(packed(once.select("key", tokens(F.col("text")).alias("tokens"))), blocks_of(docs, "text"), threshold, PLACES)
