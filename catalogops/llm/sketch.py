"""Document fingerprints: a threshold-scaled sketch.

A text's shingles are its runs of `WIDTH` code points.  Each has a 64-bit hash; the sketch keeps every hash below a fixed
fraction of the hash range.  The threshold is the same for all texts, so sketches of parts merge by union, and the overlap of
two sketches estimates both likeness and containment, also between texts of very unequal length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import mix64

WIDTH = 16
FRACTION = 1 / 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LIMIT = np.uint64(int(2**64 * FRACTION) - 1)
LOWEST = -(2**63)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def shingle_hashes(c: np.ndarray) -> np.ndarray:
    """Hash of every run of WIDTH code points; a shorter text is one run, an empty one has none."""
    if not len(c):
        return np.zeros(0, np.uint64)
    if len(c) < WIDTH:
        c = np.concatenate([c, np.full(WIDTH - len(c), 0x110000, np.uint64)])
    with np.errstate(over="ignore"):
        h, step, base = c + np.uint64(1), 1, _BASE
        while step < WIDTH:
            h = h[:-step] * base + h[step:]
            base = base * base
            step *= 2
    return mix64(h)


def select(h: np.ndarray) -> np.ndarray:
    """Distinct hashes below the threshold; if there is none, the smallest hash, so that no text of any length is lost."""
    low = h[h <= _LIMIT]
    return np.unique(low) if len(low) else h[h.argmin():][:1] if len(h) else h


def to_text(sketch: np.ndarray) -> str:
    """Eight hex digits for each kept hash: the 32 bits below those that the threshold makes zero."""
    return ((sketch >> np.uint64(28)) & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.unique(np.frombuffer(bytes.fromhex(fingerprint), ">u4"))


def merge(*fingerprints: str) -> str:
    """Fingerprint of all the texts together."""
    kept = [from_text(f) for f in fingerprints]
    return (np.unique(np.concatenate(kept)) if kept else np.zeros(0)).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of the union; 1 for two empty sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Part of `a` that `b` holds; an empty sketch is contained in any."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


#: Bytes of text in one id range, which one task sorts; a range start is one number on the driver.
RANGE_BYTES = 32 << 20


def range_starts(docs: DataFrame) -> list[int]:
    """First sort key of every id range, so many that a range holds about RANGE_BYTES of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ranged = docs.select("_key").repartitionByRange(n, "_key").select("_key", F.spark_partition_id().alias("part"))
    return sorted(r.start for r in ranged.groupBy("part").agg(F.min("_key").alias("start")).collect())


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of `docs(doc_id, text)`: its fingerprint, that of its edited text, and likeness to both neighbours.

    The next document is the one with the next id (ties by text, null ids first); after the last comes the first.  Texts move once:
    ids are cut into ranges, each range is sorted in one task, and the first row of a range is also sent to the range before it.
    Null texts count as empty; an empty table gives an empty result.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LOWEST)).cast("long").alias("_key"))
    starts = range_starts(d)
    last = len(starts) - 1

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series([max(0, bisect_right(starts, k) - 1) for k in key], dtype="int32")

    @F.pandas_udf("boolean")
    def starts_range(key: pd.Series) -> pd.Series:
        return key.isin(set(starts))

    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guard"))
    before = F.struct(F.when(F.col("_range") == 0, F.lit(last)).otherwise(F.col("_range") - 1).cast("int").alias("range"), F.lit(True).alias("guard"))
    placed = (d.withColumn("_range", range_of("_key")).withColumn("_first", starts_range("_key"))
              .select("doc_id", "text", "_key", F.explode(F.when(F.col("_first"), F.array(own, before)).otherwise(F.array(own))).alias("_at"))
              .select("doc_id", "text", "_key", "_at.range", "_at.guard"))
    schema = docs.select("doc_id").schema
    for name, kind in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"),
                       ("near_edited", "double"), ("near_next", "double"), ("next_contained", "double")):
        schema = schema.add(name, kind)
    return (placed.repartition(max(1, 2 * len(starts)), "range").sortWithinPartitions("range", "guard", "_key", "text")
            .select("doc_id", "text", "range", "guard").mapInArrow(_rows(docs.select("doc_id").schema), schema))


def _rows(id_schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    id_type = to_arrow_schema(id_schema).field(0).type

    def finish(row, following):
        doc_id, text, h, own = row
        n, m = len(text), len(text) // 4
        edited = edit(text, following[1])
        # runs that end before the cut are as in the text itself
        stay = max(0, n - m - WIDTH + 1) if n >= WIDTH else 0
        changed = np.concatenate([h[:stay], shingle_hashes(codes(edited[stay:]))]) if stay and len(edited) - stay >= WIDTH else shingle_hashes(codes(edited))
        other = select(changed)
        return (doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(other),
                likeness(own, other), likeness(own, following[3]), containment(following[3], own))

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        types = [id_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 3]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_contained"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def run(batches):
        pending, closed, out, size = None, True, [], 0
        for b in batches:
            ids, texts, ranges, guards = (b.column(i) for i in range(4))
            for i in range(b.num_rows):
                at, guard = ranges[i].as_py(), guards[i].as_py()
                if guard and closed:
                    continue  # a later copy of the row that ended this range
                text = texts[i].as_py()
                h = shingle_hashes(codes(text))
                row = (ids[i].as_py(), text, h, select(h))
                if pending is not None and not closed:
                    out.append(finish(pending, row))
                    size += len(out[-1][3]) + len(out[-1][4])
                pending, closed = row, guard
                if size > 8 << 20 or len(out) >= 2000:
                    yield batch(out)
                    out, size = [], 0
        if out:
            yield batch(out)

    return run
