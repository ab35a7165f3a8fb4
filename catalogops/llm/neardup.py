"""Near duplicates by min-max hashing.

Every text is a set of word shingles.  Under each of `PERMUTATIONS` hash functions both the smallest and the largest value are
kept, so half as many functions are evaluated for a signature of the same length; both are unbiased for the Jaccard similarity.
Bands of ROWS values place a text in buckets.  Texts that share a bucket are candidates; candidates are linked only after an
exact comparison of the whole sets.

Equal sets count once from the start.  In every bucket the first member is compared with all others, and links are closed into
components.  Then only members of different components are still of interest: those outside a bucket's largest component
meet all its members, block by block inside tasks, by the estimate from a longer signature.  A first pass follows the best
estimates only, which ends nearly all open cases; the last pass follows every pair that the estimate cannot rule out.  So a bucket of n copies
costs about n comparisons of sets, no pair is left out, and no list of all pairs is ever written.

A pair of similarity 0.8 shares a band of five with probability 0.328 and is missed by all 32 bands three times in a million.
Sets are named by a 64-bit hash: among a billion different texts, two share a name with a chance of 3 percent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogops.llm.common import keep, map_texts, mix64, with_safe_names

PERMUTATIONS = 80
ROWS = 5
WIDE = 512  # permutations of the longer signature, of candidates only
BLOCK, CHUNK = 256, 1024  # members of a bucket that meet in one step
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 2**63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, WIDE, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than `width` are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        out = h[:len(h) - n + 1] + np.uint64(n)
        for k in range(1, n):
            out = mix64(out * _ODD + h[k:len(h) - n + 1 + k])
    return np.unique(out)


def name_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(s: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Smallest and largest value under every permutation, one after the other."""
    low, high = np.full(permutations, 2**64 - 1, np.uint64), np.zeros(permutations, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 4096):
            v = _A[:permutations, None] * s[None, i:i + 4096]
            v += _B[:permutations, None]
            np.minimum(low, v.min(1), out=low)
            np.maximum(high, v.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def bands(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        part = sig.reshape(-1, ROWS)
        out = np.arange(len(part), dtype=np.uint64)
        for k in range(ROWS):
            out = mix64(out * _ODD + part[:, k])
    return out.view(np.int64)


def _describe(width: int):
    def run(part):
        n, name, keys = [], [], []
        for t in part:
            s = shingle_set(t, width)
            n.append(len(s))
            name.append(name_of(s) if len(s) else None)
            keys.append(bands(signature(s)) if len(s) else None)
        return {"n_shingles": n, "node": name, "bands": keys}

    return run


def _sets(width: int):
    def run(part):
        sets = [shingle_set(t, width) for t in part]
        wide = [signature(s, WIDE) for s in sets]
        short = [(w >> np.uint64(40)).astype(np.uint8).tobytes() for w in wide]
        return {"found": [name_of(s) for s in sets], "n": [len(s) for s in sets], "sig": [b[:2 * PERMUTATIONS] for b in short], "wide": short,
                "bands": [bands(w[:2 * PERMUTATIONS]).tobytes() for w in wide], "hashes": [s.tobytes() for s in sets]}

    return run


def least_share(percent: int, permutations: int) -> float:
    """Share of agreeing signature values below which a pair is ruled out: four standard deviations below the limit."""
    limit = percent / 100
    return limit - 4 * (limit * (1 - limit) / (2 * permutations)) ** 0.5


def _promising(least: float):
    """Pairs whose signatures agree in at least a share of `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
                yield b.select([0, 1]).filter(pa.array((x == y).mean(1) >= least))

    return run


def _across(least: float, best: int | None):
    """Promising pairs of members of different components, from rows sorted by (bucket, block, chunk, kind, node).

    Rows of kind 0 are a block of minor members and stay in memory; rows of kind 1 stream past them.  A pair is reported in the
    first bucket that its members share.  With `best`, only so many pairs of each minor member and batch, those of the best estimate.
    """

    def compare(key, minor, other):
        a, root_a, wide_a, bands_a = minor
        b, root_b, wide_b, bands_b, is_minor = other
        out = []
        for i in range(len(a)):
            share = (wide_b == wide_a[i]).mean(1)
            good = (share >= least) & (root_b != root_a[i]) & ~(is_minor & (b <= a[i]))
            at = np.flatnonzero(good)
            if len(at):
                same = bands_b[at] == bands_a[i]
                at = at[bands_a[i][same.argmax(1)] == key[0]]
            if best and len(at) > best:
                at = at[np.argsort(-share[at], kind="stable")[:best]]
            out += [(a[i], b[j]) for j in at]
        return out

    def columns(b):
        wide, keys = (np.frombuffer(b"".join(b.column(k).to_pylist()), t).reshape(b.num_rows, -1) for k, t in ((7, np.uint8), (8, np.int64)))
        return [b.column(k).to_numpy() for k in range(7)], wide, keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, minor = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                (bucket, block, chunk, kind, node, root, flag), wide, keys = columns(b)
                cut = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(block) != 0) | (np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1
                out = []
                for lo, hi in zip([0, *cut], [*cut, len(node)], strict=True):
                    here = (bucket[lo], block[lo], chunk[lo])
                    if kind[lo] == 0:
                        new = (node[lo:hi], root[lo:hi], wide[lo:hi], keys[lo:hi])
                        minor = tuple(np.concatenate(p) for p in zip(minor, new, strict=True)) if here == key else new
                        key = here
                    elif here == key:
                        out += compare(key, minor, (node[lo:hi], root[lo:hi], wide[lo:hi], keys[lo:hi], flag[lo:hi].astype(bool)))
                if out:
                    x = np.array(out, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _side(sets: DataFrame, name: str, value: str) -> DataFrame:
    return sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col(value).alias(f"v_{name}"))


def promising(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The `pairs(a, b)` that sizes and short signatures do not rule out."""
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    both = pairs.join(_side(sets, "a", "sig"), "a").join(_side(sets, "b", "sig"), "b").filter(sized)
    return both.select("a", "b", "v_a", "v_b").mapInArrow(_promising(least_share(percent, PERMUTATIONS)), "a long, b long")


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The `pairs(a, b)` whose whole sets are similar enough."""
    both = pairs.join(_side(sets, "a", "hashes"), "a").join(_side(sets, "b", "hashes"), "b")
    return both.select("a", "b", "v_a", "v_b").mapInArrow(_linked(percent), "a long, b long")


def across(labelled: DataFrame, sets: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Promising pairs of different components in the buckets of `labelled(bucket, node, root)`; see `_across`.

    Block and chunk of a member are drawn by its name, so no bucket is ever sorted or numbered in one task.
    """
    counts = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    main = (counts.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("size")).filter("m.c < size")
            .select("bucket", F.col("m.root").alias("main"), F.ceil((F.col("size") - F.col("m.c")) / BLOCK).cast("int").alias("blocks"),
                    F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")))
    m = labelled.join(main, "bucket").withColumn("minor", F.col("root") != F.col("main"))
    first = (m.filter("minor").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int"))
             .select("bucket", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), "node", "root", "minor"))
    second = m.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit(2)), "chunks").cast("int").alias("chunk"),
                      F.lit(1).alias("kind"), "node", "root", "minor")
    rows = first.union(second).join(sets.select("node", "wide", "bands"), "node")
    key = ["bucket", "block", "chunk"]
    return (rows.select(*key, "kind", "node", "root", F.col("minor").cast("int").alias("minor"), "wide", "bands")
            .repartition(*key).sortWithinPartitions(*key, "kind", "node").mapInArrow(_across(least_share(percent, WIDE), best), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges(a, b)`; the root is the smallest node reachable.

    Alternates large-star and small-star steps: every node hangs its larger, then its smaller neighbours below the smallest.
    """
    e = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    mark = _mark(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = keep(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def rest_of(name: Column | str) -> Column:
    return F.coalesce("root", name)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs(doc_id, text)`: n_shingles, component_id and kept.

    Two rows are linked when their sets of `width`-word shingles (A-Z in lower case, words between ASCII blanks) have a Jaccard
    similarity of `percent` / 100 or more.  component_id is the smallest doc_id reachable over links; kept marks the row that has
    it.  Null, empty and blank texts have no shingles and are linked with nothing.  Repeated rows are equal sets and so in one
    component; a null doc_id is never the smallest unless the component has no other.
    """
    out = _grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row of `docs(doc_id, text)`: doc_id, h, n_shingles, root, component_id; h names the text, root the component (null: alone)."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    rows = keep(map_texts(texts, ["doc_id", "h"], "text", _describe(width), "n_shingles long, node long, bands array<long>"), "signatures")
    named = rows.filter("node is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    classes = named.groupBy("node").agg(first.alias("at")).select("node", F.col("at.doc_id").alias("rep"), F.col("at.h").alias("rep_h"))
    members = named.select("node", F.explode("bands").alias("bucket")).distinct()
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).filter("size > 1").drop("size")
    buckets = keep(members.join(sizes, "bucket"), "buckets")
    wanted = buckets.select("node").distinct().join(classes, "node")
    told = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h")))
    sets = map_texts(told, ["node"], "text", _sets(width), "found long, n long, sig binary, wide binary, bands binary, hashes binary")
    sets = keep(sets.filter("node = found").drop("found").dropDuplicates(["node"]), "sets")

    pairs = buckets.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    roots = None
    if not buckets.isEmpty():
        roots = components(links(keep(promising(pairs, sets, percent), "leader-pairs"), sets, percent))
        for best in (2, None):
            labelled = buckets.join(roots, "node", "left").withColumn("root", rest_of("node")).select("bucket", "node", "root")
            near = keep(across(labelled, sets, percent, best), "open-pairs")
            if near.isEmpty():
                break
            roots = components(links(near, sets, percent).union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    if roots is None:
        joined = classes.select("node", F.col("node").alias("root"), F.col("rep").alias("component_id"))
    else:
        rooted = classes.join(roots, "node", "left").withColumn("root", rest_of("node"))
        joined = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("node", "root", "component_id")
    linked = named.select("doc_id", "h", "n_shingles", "node").join(joined, "node").select("doc_id", "h", "n_shingles", "root", "component_id")
    alone = rows.filter("node is null").select("doc_id", "h", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def one_per_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each near-duplicate component, the one with the smallest id; all columns stay.

    Rows repeated under one id and text stay once.  An id with several texts is judged text by text: of those in one component, one stays.
    """
    found = keep(_grouped(docs, width, percent).select("doc_id", "h", "root").distinct(), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("at")
    best = found.filter("root is not null").groupBy("root").agg(first).select("at.doc_id", "at.h")
    best = best.union(found.filter("root is null").select("doc_id", "h")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    once = Window.partitionBy("doc_id", "_text").orderBy(F.lit(1))

    def run(d: DataFrame) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_h"))
        kept = d.withColumn("_text", F.xxhash64("text")).join(best, same, "left_semi")
        return kept.withColumn("_copy", F.row_number().over(once)).filter("_copy = 1").select(d.columns)

    return with_safe_names(docs, ["doc_id", "text"], run)
