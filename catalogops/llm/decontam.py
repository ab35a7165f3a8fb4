"""Benchmark decontamination over a distributed positional inverted index; DataFrame functions only.

Test items are cut into phrases of consecutive words.  The index stores one posting (term, document, position) for every
occurrence of a test term.  A phrase is looked up from its rarest term: the postings of that term, moved back by the term's offset, are the
candidate starts; they are intersected with the moved postings of the second rarest term; what is left is compared word by word
with the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import keep, lower_ascii, with_safe_names

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE = 13
#: A list of at most so many terms (some 10 MB) is broadcast; a longer one is joined by a shuffle.
BROADCAST_TERMS = 200_000


def words(text: str | Column) -> Column:
    """Words of a text: runs of digits, letters and non-ASCII characters, A-Z in lower case; null has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(lower_ascii(F.coalesce(c, F.lit(""))), GAP), lambda w: w != "")


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def phrases(items: DataFrame, length: int = PHRASE) -> DataFrame:
    """Distinct phrases of `items(item_id, text)`: phrase, terms and the ids (as strings) of the items that hold it.

    An item of fewer words is one phrase; an item without words has none.
    """
    w = items.select(F.col("item_id").cast("string").alias("item"), words("text").alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(1)))
    cut = w.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), length).alias("terms"))
    return cut.groupBy("terms").agg(F.collect_set("item").alias("items")).withColumn("phrase", F.xxhash64("terms"))


def short_list(df: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """A broadcast hint for a stored table that was counted and found small; otherwise the table as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc, pos) for every occurrence of `terms(term)` in `docs(doc_id, text)`; pos counts words from 0."""
    occurrences = docs.select(row_key().alias("doc"), F.posexplode(words("text")).alias("pos", "term"))
    return occurrences.join(short_list(terms), "term", "left_semi").select("term", "doc", "pos")


def by_rarity(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """`wanted(phrase, terms)` with its two rarest terms and their offsets: term1, off1, term2, off2 (null for one word).

    A term that no document holds has frequency 0, so its phrase ends at the first lookup.
    """
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = wanted.select("phrase", F.posexplode("terms").alias("off", "term"))
    ranked = placed.join(frequency, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = F.array_sort(F.collect_list(F.struct("n", "term", "off")))
    return (ranked.groupBy("phrase").agg(order.alias("o"))
            .select("phrase", F.col("o")[0]["term"].alias("term1"), F.col("o")[0]["off"].alias("off1"),
                    F.try_element_at("o", F.lit(2))["term"].alias("term2"), F.try_element_at("o", F.lit(2))["off"].alias("off2")))


def phrase_starts(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(phrase, doc, start) where the two rarest terms of `wanted(phrase, terms)` stand at the right distance."""
    plan = keep(by_rarity(wanted, index), "phrase-plan")
    first = (index.withColumnRenamed("term", "term1").join(short_list(plan), "term1")
             .select("phrase", "doc", (F.col("pos") - F.col("off1")).alias("start"), "term2", "off2").filter("start >= 0"))
    second_terms = keep(plan.filter("term2 is not null").select(F.col("term2").alias("term")).distinct(), "second-terms")
    second = index.join(short_list(second_terms), "term", "left_semi").select(F.col("term").alias("term2"), "doc", F.col("pos").alias("pos2"))
    pairs = (first.filter("term2 is not null").withColumn("pos2", F.col("start") + F.col("off2"))
             .join(second, ["doc", "pos2", "term2"], "left_semi").select("phrase", "doc", "start"))
    return first.filter("term2 is null").select("phrase", "doc", "start").union(pairs)


def exact(w: Column, candidates: Column) -> Column:
    """The candidates (start, terms, ...) that the words `w` really hold, by start."""
    return F.array_sort(F.filter(candidates, lambda m: F.slice(w, m["start"] + 1, F.size(m["terms"])) == m["terms"]))


def phrase_matches(docs: DataFrame, items: DataFrame, length: int = PHRASE) -> DataFrame:
    """Every row of `docs` (all columns) with `w`, its words, and `found`: the exact occurrences (start, terms, items) in order."""
    wanted = keep(phrases(items, length), "phrases")
    vocabulary = keep(wanted.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    index = keep(postings(docs, vocabulary), "postings")
    starts = phrase_starts(index, wanted.select("phrase", "terms"))
    lists = (starts.join(short_list(wanted), "phrase").groupBy("doc")
             .agg(F.collect_set(F.struct("start", "terms", "items")).alias("_candidates")))
    none = F.expr("array()").cast(lists.schema["_candidates"].dataType)
    joined = docs.withColumn("_doc", row_key()).join(lists, F.col("_doc") == F.col("doc"), "left").drop("doc", "_doc")
    return (joined.withColumn("w", words("text")).withColumn("found", F.coalesce(exact(F.col("w"), F.col("_candidates")), none))
            .drop("_candidates"))


def proximity_matches(docs: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(query, doc_id, at) for `queries(query, terms)` whose terms all stand within `slop` words of the rarest one, at word `at`.

    Repeated terms count once; postings meet in blocks of slop + 1 positions, so a frequent term is never compared with a whole text.
    """
    wanted = keep(queries.select("query", F.explode(F.array_distinct("terms")).alias("term")), "near-terms")
    index = keep(postings(docs, keep(wanted.select("term").distinct(), "near-vocabulary")), "near-postings")
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = (wanted.join(frequency, "term", "left").groupBy("query")
              .agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("rare"), F.count(F.lit(1)).alias("k")))
    block = F.floor(F.col("pos") / (slop + 1)).cast("long")
    first = (index.join(rarest, F.col("term") == F.col("rare")).select("query", "k", "doc", F.col("pos").alias("at"), F.explode(F.array(block - 1, block, block + 1)).alias("block")))
    other = index.join(wanted, "term").select("query", "term", "doc", "pos", block.alias("block"))
    near = (first.join(other, ["query", "doc", "block"]).filter(F.abs(F.col("pos") - F.col("at")) <= slop)
            .groupBy("query", "doc", "at", "k").agg(F.count_distinct("term").alias("met")).filter("met = k"))
    ids = docs.select("doc_id", row_key().alias("doc")).distinct()
    return near.join(ids, "doc").select("query", "doc_id", "at")


def contamination(docs: DataFrame, items: DataFrame, length: int = PHRASE) -> DataFrame:
    """Every row of `docs`, all columns, with n_words, n_hit, n_items, item_ids and contaminated.

    n_hit counts the words inside any occurrence of a phrase; a document is contaminated when that is at least a twentieth of its
    words.  Null and empty texts have no words; a null item id has no entry in item_ids; repeated rows each get the result.
    """
    return with_safe_names(docs, ["doc_id", "text"], lambda d: _judged(d, items, length))


def _judged(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    found = phrase_matches(docs, items, length)
    span = F.aggregate(
        "found", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, m: F.struct(
            F.greatest(a["end"], m["start"] + F.size(m["terms"])).alias("end"),
            (a["n"] + F.greatest(F.lit(0), m["start"] + F.size(m["terms"]) - F.greatest(a["end"], m["start"]))).alias("n")))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda m: m["items"]))))
    return (found.withColumn("n_words", F.size("w").cast("long")).withColumn("n_hit", span["n"].cast("long")).withColumn("item_ids", ids)
            .withColumn("n_items", F.size("item_ids").cast("long")).drop("w", "found")
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their own columns."""
    return with_safe_names(docs, ["doc_id", "text"], lambda d: _judged(d, items, PHRASE).filter("not contaminated").select(d.columns))
