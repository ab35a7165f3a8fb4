"""Line dedup with a log-template tree; DataFrame functions only.

Lines are parsed by a tree of fixed depth: token count, then the leading tokens, with tokens that hold a digit generalised to
a field.  In a leaf that several documents reach, a token stays constant at its position if a share of the leaf's documents has it
there; every other token is generalised to a field too.  A line whose template keeps at least half of the tokens behind the leading
ones, which all lines of the leaf share, belongs to that template, any other line is its own template.  Templates that recur across documents are dropped from all of them.

A document with next to no text of its own beside recurring lines is a copy of another document, not a witness of boilerplate.  So copies
do not vote: a template recurs if enough *carriers* (documents with a fifth of their bytes outside shared lines) have it.  Every carrier loses
its recurring lines, however many they are.  A document of which less than a fifth would stay loses them too if the same set of recurring
templates is the whole set of several carriers, as on the pages of one site; otherwise these lines never stand together but in copies, and it
stays whole, for near-duplicate search to judge.

Any white space inside a line parts tokens, and a character of a script without blanks is a token.  Long lines recur by their exact text from two documents on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import keep, with_safe_names

FIELD = "<*>"
#: A stored list of at most so many rows of three numbers (some 10 MB) is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 300_000


@dataclass(frozen=True)
class TreeRules:
    depth: int = 3  # leading tokens that select a leaf
    min_tokens: int = 3  # shorter lines are never boilerplate
    min_documents: int = 3  # documents that must share a template, and support a constant token at least
    min_mass: int = 30  # documents times tokens of a template, so that short lines need more witnesses
    max_children: int = 20  # a constant stands in one of so many documents of its leaf; a position with more constants is a field
    constant_share: float = 0.5  # least share of constant tokens behind the leading tokens of a template
    copy_share: float = 0.8  # a document with that share of its bytes in shared lines is a copy
    min_carriers: int = 3  # carriers with the same set of templates, for a document that would lose that share
    long_tokens: int = 30  # lines of so many tokens recur by exact text from long_documents on
    long_documents: int = 2


RULES = TreeRules()

# White space other than the blank; blocks of scripts written without blanks (Thai, Lao, Myanmar, Khmer, kana, Han).
SPACES = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
UNSPACED = r"\x{e00}-\x{eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3041}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{323af}"


# The same classes, with one range tried before the rest, so that common letters fail at once.
_SPACE = "\t\x0b\x0c\r\x85\xa0[\u1680-\u3000&&[" + SPACES[6:] + "]]"
_UNSPACED = rf"[\x{{e00}}-\x{{323af}}&&[{UNSPACED}]]"


def spaced(text: Column) -> Column:
    """In every line of a text: each run of white space as one blank, none outside, and blanks around each character of an unspaced script."""
    parted = F.regexp_replace(text, f"({_UNSPACED})", " $1 ")
    single = F.regexp_replace(parted, f"[ {_SPACE}]{{2,}}|[{_SPACE}]", " ")
    # every space but those named here, and every unspaced script, lies beyond U+0E00
    other = text.contains("  ") | text.rlike(r"[\t\x0b\x0c\r\x85\xa0\x{e00}-\x{10ffff}]")
    even = F.when(other, single).otherwise(text)
    return F.trim(F.replace(F.replace(even, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")))


def fielded(text: Column) -> Column:
    """Tokens with a digit replaced by a field."""
    return F.regexp_replace(text, "(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", FIELD)


def masked(line: Column, with_fields: Column) -> Column:
    """A spaced line with its fields, unless they are more than half of its tokens."""
    fields = (F.octet_length(with_fields) - F.octet_length(F.replace(with_fields, F.lit(FIELD)))) / len(FIELD)
    return F.when(fields * 2 <= tokens(line), with_fields).otherwise(line)


def tokens(line: Column) -> Column:
    """Number of tokens between single blanks."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1


def parsed(docs: DataFrame, rules: TreeRules) -> DataFrame:
    """(doc, size, line, n, leaf): every distinct line of every document of at least min_tokens, masked; size counts the document's bytes."""
    lines = (docs.filter("text is not null")
             .select(F.xxhash64("doc_id", "text").alias("doc"), F.octet_length("text").alias("size"), F.explode(F.array_distinct(F.split(spaced(F.col("text")), "\n"))).alias("line"))
             .filter(F.octet_length(F.substring_index("line", " ", rules.min_tokens - 1)) < F.octet_length("line"))  # a field is one token too
             .withColumn("n", tokens(F.col("line")))
             .withColumn("_fielded", F.when(F.col("line").rlike("[0-9]"), fielded(F.col("line")))))
    lines = lines.select("doc", "size", F.when(F.col("_fielded").isNull(), F.col("line")).otherwise(masked(F.col("line"), F.col("_fielded"))).alias("line"), "n")
    return lines.withColumn("leaf", F.xxhash64("n", F.substring_index("line", " ", rules.depth)))


def short_list(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def templates(shared: DataFrame, leaves: DataFrame, rules: TreeRules) -> DataFrame:
    """(line_id, template) for `shared(doc, line, line_id, n, leaf)` and `leaves(leaf, docs)`."""
    distinct = keep(shared.groupBy("leaf", "line_id", "line").agg(F.count(F.lit(1)).alias("docs")), "distinct-lines")
    placed = distinct.select("leaf", "line_id", "docs", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    token = F.xxhash64("token").alias("token_id")
    support = placed.filter(F.col("token") != FIELD).groupBy("leaf", "pos", token).agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= rules.min_documents)
    support = support.join(short_list(leaves.withColumnRenamed("docs", "all")), "leaf").filter(F.col("docs") * rules.max_children >= F.col("all"))
    narrow = support.groupBy("leaf", "pos").agg(F.count(F.lit(1)).alias("children")).filter(F.col("children") <= rules.max_children)
    constant = keep(support.join(narrow, ["leaf", "pos"]).select("leaf", "pos", "token_id"), "constants")
    marked = placed.withColumn("token_id", F.xxhash64("token")).join(constant.withColumn("constant", F.lit(1)), ["leaf", "pos", "token_id"], "left")
    # the template of a line: constants with their positions, in any order of addition
    part = F.when(F.col("constant") == 1, F.xxhash64("pos", "token_id").cast("decimal(20,0)"))
    summed = marked.groupBy("leaf", "line_id").agg(F.sum(part).alias("parts"), F.count_if((F.col("constant") == 1) & (F.col("pos") >= rules.depth)).alias("constants"), F.count(F.lit(1)).alias("n"))
    general = F.col("constants") >= rules.constant_share * (F.col("n") - rules.depth)
    return summed.select("line_id", F.when(general, F.xxhash64("leaf", F.col("parts").cast("string"))).otherwise(F.col("line_id")).alias("template"))


def recurring(docs: DataFrame, rules: TreeRules = RULES) -> DataFrame:
    """(doc, line_id, template, bytes, size): the lines of each document that recur, and the document's bytes."""
    lines = parsed(docs, rules)
    reached = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.max("n").alias("n"))
    enough = (F.col("docs") >= rules.min_documents) | (F.col("docs") >= rules.long_documents) & (F.col("n") >= rules.long_tokens)
    leaves = keep(reached.filter(enough).select("leaf", "docs"), "leaves")
    shared = keep(lines.join(short_list(leaves.select("leaf")), "leaf", "left_semi").withColumn("line_id", F.xxhash64("line")).distinct(), "shared-lines")
    seen = keep(shared.select("doc", "size", "line_id", "n", F.octet_length("line").alias("bytes")).join(templates(shared, leaves, rules), "line_id"), "templates")
    # a long line recurs by its template or by its own text
    exact = F.when((F.col("n") >= rules.long_tokens) & (F.col("template") != F.col("line_id")), F.array("template", "line_id")).otherwise(F.array("template"))
    once = seen.select("doc", "size", "bytes", "line_id", "template", "n", F.explode(exact).alias("key"))

    def often(d: DataFrame) -> DataFrame:
        by_text = (F.col("docs") >= rules.long_documents) & (F.col("n") >= rules.long_tokens) & F.col("text")
        both = d.groupBy("key", "doc").agg(F.max("n").alias("n"), F.every(F.col("key") == F.col("line_id")).alias("text"))
        counted = both.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("n").alias("n"), F.every("text").alias("text"))
        return counted.filter((F.col("docs") >= rules.min_documents) & (F.col("docs") * F.col("n") >= rules.min_mass) | by_text).select("key")

    def having(keys: DataFrame) -> DataFrame:
        return once.join(short_list(keys), "key", "left_semi").select("doc", "line_id", "template", "bytes", "size").dropDuplicates(["doc", "line_id"])

    candidates = keep(often(once), "candidates")
    inside = having(candidates).groupBy("doc").agg(F.sum("bytes").alias("inside"), F.max("size").alias("size"))
    copies = inside.filter(F.col("inside") >= rules.copy_share * F.col("size")).select("doc")
    return having(keep(often(once.join(copies, "doc", "left_anti")), "voted"))


def losses(docs: DataFrame, rules: TreeRules = RULES) -> DataFrame:
    """(doc, gone): the line ids that each document loses."""
    found = recurring(docs, rules).groupBy("doc").agg(F.collect_set("line_id").alias("gone"), F.xxhash64(F.array_sort(F.collect_set("template"))).alias("set"),
                                                      F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
    found = keep(found.select("doc", "gone", "set", (F.col("bytes") < rules.copy_share * F.col("size")).alias("carrier")), "losses")
    carried = keep(found.groupBy("set").agg(F.count_if("carrier").alias("n")).filter(F.col("n") >= rules.min_carriers).select("set"), "carried-sets")
    return found.filter("carrier").select("doc", "gone").union(found.filter("not carrier").join(short_list(carried), "set", "left_semi").select("doc", "gone"))


def drop_recurring_lines(docs: DataFrame, rules: TreeRules = RULES) -> DataFrame:
    """Every row of `docs(doc_id, text, ...)`, all columns, with `text` cleaned, n_lines and n_dropped.

    Lines end at a line feed; the lines that stay keep their order and spelling.  A text that loses nothing is returned as it is;
    null stays null with 0 lines.  Rows repeated under one id and text count as one document.
    """
    return with_safe_names(docs, ["doc_id", "text"], lambda d: _dropped(d, rules))


def _dropped(docs: DataFrame, rules: TreeRules) -> DataFrame:
    gone = losses(docs, rules).withColumnRenamed("gone", "_gone")
    joined = docs.withColumn("_doc", F.xxhash64("doc_id", "text")).join(gone, F.col("_doc") == F.col("doc"), "left").drop("_doc", "doc")
    split = joined.withColumn("_lines", F.split("text", "\n"))
    lost = F.col("_gone").isNotNull()
    keys = split.withColumn("_spaced", F.when(lost, spaced(F.col("text")))).withColumn("_fielded", F.split(fielded(F.col("_spaced")), "\n"))
    keys = keys.withColumn("_spaced", F.split("_spaced", "\n")).withColumn("_keys", F.zip_with("_spaced", "_fielded", lambda x, m: F.xxhash64(masked(x, m))))
    both = F.zip_with("_lines", "_keys", lambda x, key: F.struct(x.alias("line"), key.alias("key")))
    left = F.filter(both, lambda x: ~F.array_contains("_gone", x["key"]))
    stay = keys.withColumn("_stay", F.when(lost, F.transform(left, lambda x: x["line"]))).drop("_spaced", "_fielded", "_keys")
    out = (stay.withColumn("n_lines", F.coalesce(F.size("_lines"), F.lit(0)).cast("long"))
           .withColumn("n_dropped", F.when(lost, F.size("_lines") - F.size("_stay")).otherwise(0).cast("long"))
           .withColumn("text", F.when(lost, F.array_join("_stay", "\n")).otherwise(F.col("text"))))
    return out.withColumn("n_lines", F.greatest("n_lines", F.lit(0))).drop("_gone", "_lines", "_stay")


def cleaned_documents(docs: DataFrame, rules: TreeRules = RULES) -> DataFrame:
    """`docs` with recurring lines dropped, in its own columns; n_chars, where there is one, follows the new text.

    A document of which nothing but blanks is left after dropping goes; one that was blank before stays.
    """
    def run(d: DataFrame) -> DataFrame:
        out = _dropped(d, rules).filter("n_dropped = 0 or trim(text) <> ''")
        if "n_chars" in d.columns:
            out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
        return out.select(d.columns)

    return with_safe_names(docs, ["doc_id", "text", "n_chars"], run)
