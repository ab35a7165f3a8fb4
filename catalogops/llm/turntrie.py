"""Trie of conversation prefixes by whole-sequence collapse; DataFrame functions, but for hashing long end lists.

Conversations with the same turns are one weighted sequence with a list of its ends.  A sequence that is a proper prefix of another
is no leaf (an anti-join drops it).  Every prefix of a distinct sequence is a row that carries the sequence's weight, so all figures of
a node are one aggregate over the sequences that pass through it:

* A node belongs to the sequence with the smallest member id of those that pass.  A sequence then owns the nodes of its path from
  some depth on, and each node has one owner.
* Token sums over a subtree need no descent: the copies of a subtree's turns are the rest of the bytes of the sequences that pass,
  times their weight; its distinct turns are what these sequences own.

A turn is named by two 64-bit hashes of role and text; the name of a prefix adds the hashes of its turns with their positions, as
running sums, so even one very long conversation is cut over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import keep
from catalogops.operators.skew import sliced_window

BLOCK = 5  # conversations that share one opening
OPENING = 9  # an opening has fewer turns than this
CHUNK_BITS = 12  # ids of 2^12 successive values make one piece of an end list
KEY = ["k1", "k2"]


def _hash(*parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), *parts) for salt in (11, 12)]


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, t1, t2, bytes): turns numbered from 1 in the order of turn (null first), then role and text."""
    d = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = sliced_window(d, ["conv_id"], ["turn", "role", "text"], "turn", number="at")
    names = [h.alias(f"t{i}") for i, h in enumerate(_hash(F.col("role"), F.col("text")), 1)]
    return n.select("conv_id", F.col("at").cast("long").alias("at"), *names, F.octet_length("text").cast("long").alias("bytes"))


def rebuilt_turns(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, bytes) of every rebuilt conversation: the opening of its block's first id, then its own turns behind it."""
    heads = turns.filter(F.col("at") < OPENING).withColumnRenamed("conv_id", "base")
    opening = heads.join(convs, "base").filter("at <= h").select("conv_id", F.col("at").alias("pos"), "t1", "t2", "bytes")
    taken = convs.join(heads.groupBy("base").agg(F.count(F.lit(1)).alias("n")), "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"))
    own = turns.join(taken, "conv_id").filter("at > h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("pos"), "t1", "t2", "bytes")
    return opening.union(own)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, len, bytes, upto, total, k1, k2, p1, p2): every prefix of every conversation with its name and its parent's."""
    d = rebuilt.withColumns({f"x{i}": _wide(F.xxhash64("pos", f"t{i}")) for i in (1, 2)})
    run = sliced_window(d, ["conv_id"], ["pos"], "pos", total="len",
                        sums={"s1": "x1", "s2": "x2", "upto": "bytes"}, group_sums={"total": "bytes"})
    name = _hash(F.col("pos"), F.col("s1"), F.col("s2"))
    above = _hash(F.col("pos") - 1, (F.col("s1") - F.col("x1")).cast("decimal(30,0)"), (F.col("s2") - F.col("x2")).cast("decimal(30,0)"))
    run = run.withColumns({"s1": F.col("s1").cast("decimal(30,0)"), "s2": F.col("s2").cast("decimal(30,0)")})
    return run.select("conv_id", F.col("pos").alias("depth"), "len", "bytes", "upto", "total", *[c.alias(k) for k, c in zip(KEY, name, strict=True)],
                      *[c.alias(k) for k, c in zip(("p1", "p2"), above, strict=True)])


def end_digests(members: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of `members(conv_id, k1, k2)`: the ids that end there, ascending, joined by commas.

    Ids are joined piece by piece (a piece is a bounded range of ids); a task hashes the pieces of a sequence as they stream past.
    """
    chunk = F.expr(f"shiftright(conv_id, {CHUNK_BITS})")
    pieces = members.groupBy(*KEY, chunk.alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []
        for b in batches:
            for k1, k2, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (k1, k2) != at:
                    if at:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*KEY, "ends_sha256"])
                out = []
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, digest.hexdigest())], names=[*KEY, "ends_sha256"])

    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id belong to no conversation and are left out; null role or text is empty; repeated rows are repeated turns;
    rows that agree in turn go by role and text.  Without conversations there is no node.  Other columns are not read.
    """
    turns = keep(numbered_turns(conversations), "turns")
    convs = keep(turns.select("conv_id").distinct()
                 .withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % OPENING).cast("long")).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK), "conversations")
    steps = keep(prefixes(rebuilt_turns(turns, convs)), "prefixes")

    # whole sequences with weight and ends
    final = steps.filter("depth = len").select("conv_id", *KEY, "len", "total")
    root = {"k1": F.lit(0), "k2": F.lit(0), "len": F.lit(0), "total": F.lit(0)}
    whole = keep(convs.select("conv_id").join(final, "conv_id", "left").select("conv_id", *[F.coalesce(c, v.cast("long")).alias(c) for c, v in root.items()]), "whole")
    sequences = whole.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.first("len").alias("len"))
    sequences = keep(sequences, "sequences")
    paths = keep(steps.join(sequences.filter("len > 0").select("conv_id", "weight"), "conv_id"), "paths")
    inner = paths.filter("depth < len").select(*KEY).distinct()
    leaves = sequences.filter("len > 0").join(inner, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    owned = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.first("bytes").alias("bytes")).groupBy("conv_id").agg(F.sum("bytes").alias("own"))

    # figures of nodes
    marked = paths.join(owned.join(leaves, "conv_id", "full"), "conv_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("own", "leaf")})
    rest = F.col("total") - F.col("upto") + F.col("bytes")
    nodes = marked.groupBy(*KEY).agg(
        F.min(F.struct("conv_id", "own", rest.alias("rest"))).alias("owner"), F.first("depth").alias("depth"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(F.col("weight") * rest).alias("copies"), F.sum("own").alias("owned"), F.first("bytes").alias("bytes"))
    saved = F.col("copies") - (F.col("owned") - F.col("owner.own") + F.col("owner.rest"))
    nodes = keep(nodes.select(*KEY, "p1", "p2", F.col("owner.conv_id").alias("conv_id"), "depth", "n_convs", "n_leaves", saved.alias("saved_tokens"), "bytes"), "nodes")
    children = nodes.filter("depth > 1").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))

    everything = whole.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).first()
    if not everything.n:
        return nodes.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit("").alias("ends_sha256"))
    zero = F.lit(0).cast("long")
    top = nodes.filter("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n"), F.sum("saved_tokens").alias("saved")).select(
        zero.alias("k1"), zero.alias("k2"), F.lit(everything.conv_id).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(everything.n).cast("long").alias("n_convs"), "n_children", F.coalesce("n", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    first = below.filter("depth = 1").withColumn("parent_conv_id", F.lit(everything.conv_id))
    deeper = below.filter("depth > 1").join(parents, ["p1", "p2"])
    figures = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    together = top.select(*KEY, *figures).union(first.select(*KEY, *figures)).union(deeper.select(*KEY, *figures))
    ends = end_digests(whole.select("conv_id", *KEY))
    out = together.join(ends, KEY, "left")
    return out.select(*[F.col(c).cast("long").alias(c) for c in figures], F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
