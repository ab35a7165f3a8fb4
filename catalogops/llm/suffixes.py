"""Removal of repeated byte strings with sorted suffixes.

A string of `LENGTH` bytes goes where it also starts earlier, in a document of smaller id or further up in the same one.  All
positions whose string may occur twice are sorted as suffixes, deep and shallow: a multikey quicksort over characters of eight bytes
orders them to a shallow depth, and blind tries order the groups that still share that prefix.

Only strings that can recur are sorted.  Every string has one *anchor*, the place of its smallest hash of `GRAM` bytes; equal strings have
equal anchors, so a string whose anchor hash occurs once in the whole corpus is unique.

1. Different texts are stored once, in groups of about SHARE bytes; identical ones go by their whole hash.
2. The anchor hashes of every group meet by hash, counted within the group first; the recurring ones come back to the group.
3. A group sends each different *context* of a recurring anchor, the bytes of all strings with that anchor, with its earliest place in the
   group to the task of the hash.  A *hot* anchor, which very many places have, is dealt out string by string under the string's own
   hash.
4. The strings of a task are sorted; of equal ones all but the first in document order go.  What is repeated within a group is found there.
5. The removed places return to their group, and each text is cut.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import keep, mix64
from catalogops.session import work_folder

LENGTH = 100
GRAM = 40
SPREAD = LENGTH - GRAM + 1  # places at which the anchor of a string can stand
HOT = 20_000  # places of one anchor from which its strings are dealt out one by one
SHALLOW = 2  # characters of eight bytes that the quicksort looks at
SHARE = 32 << 20  # bytes of text in one group
LOWEST = -(2**63)
EMPTY = hashlib.sha256(b"").hexdigest()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)


# ---- anchors


def gram_hashes(b: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` bytes, built by doubling."""
    with np.errstate(over="ignore"):
        h, base, step, out, done = b.astype(np.uint64) + np.uint64(1), _BASE, 1, None, 0
        while True:
            if width & step:
                m = len(b) - done - step + 1
                out, done = (h, step) if out is None else (out[:m] * base + h[done:done + m], done + step)
            step *= 2
            if step > width:
                return mix64(out)
            h = h[:-(step // 2)] * base + h[step // 2:]
            base = base * base


def sliding(choose: np.ufunc, h: np.ndarray, width: int) -> np.ndarray:
    """Smallest or largest (np.minimum, np.maximum) of every `width` successive values."""
    step = 1
    while 2 * step <= width:
        h = choose(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return choose(h[:len(h) - rest], h[rest:]) if rest else h


def anchor_places(text: bytes) -> np.ndarray:
    """The hash of every place that is the anchor of a string: it is as small as the least hash of one of the strings around it."""
    if len(text) < LENGTH:
        return np.zeros(0, np.uint64)
    h = gram_hashes(np.frombuffer(text, np.uint8), GRAM)
    edge = np.zeros(SPREAD - 1, np.uint64)
    return h[sliding(np.maximum, np.concatenate([edge, sliding(np.minimum, h, SPREAD), edge]), SPREAD) == h]


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Runs of successive strings with one anchor hash: (hash, first string); a run ends where the next one starts.

    A run may hold several anchors of equal hash; what counts is that equal strings have equal hashes.
    """
    if len(text) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = sliding(np.minimum, gram_hashes(np.frombuffer(text, np.uint8), GRAM), SPREAD)
    # a run is cut so that a context stays short also where one gram repeats for long
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    lengths = np.diff(np.append(first, len(least)))
    if lengths.max() > SPREAD:
        pieces = -(-lengths // SPREAD)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + within * SPREAD
    return least[first], first


# ---- order of suffixes


def order_suffixes(data: np.ndarray, starts: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of the `depth` bytes at each of `starts`: indices in sorted order, and a number that equal strings share.

    The quicksort goes character by character (eight bytes, big-endian): only ties go on to the next one.  Below the shallow depth, a
    blind trie is grown in every group of ties at once: the common prefix of the group is skipped by comparing all members with the
    first one, and the group branches at the first byte where any of them differs.  A group without such a byte is one string.
    """
    size = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)

    def character(at: np.ndarray, length: int = 8) -> np.ndarray:
        c = np.ascontiguousarray(size[at]).view(">u8").ravel().astype(np.uint64)
        return c >> np.uint64(8 * (8 - length)) << np.uint64(8 * (8 - length)) if length < 8 else c

    n = len(starts)
    order, group = np.arange(n), np.zeros(n, np.int64)
    active = np.arange(n)  # positions of `order` that are not alone in their group
    for k in range(min(shallow, -(-depth // 8))):
        if not len(active):
            break
        c = character(starts[order[active]] + 8 * k, min(8, depth - 8 * k))
        by = np.argsort(c, kind="quicksort") if k == 0 else np.lexsort((c, group[active]))
        order[active], c, g = order[active][by], c[by], group[active][by]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
        at = active[np.flatnonzero(new)]
        group[active] = np.repeat(at, np.diff(np.append(np.flatnonzero(new), len(active))))
        active = active[_tied(group[active])]
    reached = np.full(n, 8 * shallow)
    while len(active):
        g, members = group[active], order[active]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(head, len(active)))
        leader = np.repeat(members[head], sizes)
        # first differing byte of each member from the group's first one; the branch is the least of the group
        differ, todo = np.full(len(active), depth), np.arange(len(active))
        at = reached[active].copy()
        while len(todo):
            x = character(starts[members[todo]] + at[todo]) ^ character(starts[leader[todo]] + at[todo])
            hit = x != 0
            zeros = 7 - np.searchsorted(_BYTES, x[hit], side="right")
            differ[todo[hit]] = np.minimum(at[todo[hit]] + zeros, depth)
            todo = todo[~hit]
            at[todo] += 8
            todo = todo[at[todo] < depth]
        branch = np.repeat(np.minimum.reduceat(differ, head), sizes)
        open_ = branch < depth
        active, members, g, branch = active[open_], members[open_], g[open_], branch[open_]
        if not len(active):
            break
        byte = data[np.minimum(starts[members] + branch, len(data) - 1)]
        by = np.lexsort((byte, g))
        order[active], byte, g, branch = members[by], byte[by], g[by], branch[by]
        new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (byte[1:] != byte[:-1])]))
        group[active] = np.repeat(active[new], np.diff(np.append(new, len(active))))
        reached[active] = branch + 1
        active = active[_tied(group[active])]
    return order, group


def _tied(g: np.ndarray) -> np.ndarray:
    same = g[1:] == g[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(g) else np.zeros(0, bool)


def repeated(contexts: list[bytes], first: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Per context, which of its strings also start earlier; `first` and `rank` give the place of its first string and its document's order."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    strings = sizes - (LENGTH - 1)
    at = np.repeat(np.cumsum(sizes) - sizes, strings)
    within = np.arange(len(at)) - np.repeat(np.cumsum(strings) - strings, strings)
    order, group = order_suffixes(data, at + within)
    where, which = (np.repeat(first, strings) + within)[order], np.repeat(rank, strings)[order]
    by = np.lexsort((where, which, group))
    later = np.zeros(len(order), bool)
    g = group[by]
    later[order[by]] = np.concatenate([[False], g[1:] == g[:-1]])
    return np.split(later, np.cumsum(strings)[:-1])


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of every run of marked places."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


# ---- jobs


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, sha, text) without repeated texts of this task; the row with the smallest id of a batch stays, and any that is smaller still."""
    seen: dict[str, int] = {}
    for b in batches:
        best: dict[str, int] = {}
        for i, (doc, sha) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if doc < seen.get(sha, doc + 1):
                seen[sha] = doc
                best[sha] = i
        yield b.take(pa.array(sorted(best.values()), pa.int64()))


def _texts(table: pa.Table) -> list[tuple[int, int, str, bytes]]:
    """(id, short name, sha, bytes) of the different texts of a group, in document order."""
    found: dict[str, tuple] = {}
    for doc, sha, text in zip(*(table.column(c).to_pylist() for c in ("id", "sha", "text")), strict=True):
        if sha not in found or doc < found[sha][0]:
            found[sha] = (doc, int(sha[:16], 16), sha, text.encode("utf-8", "surrogatepass"))
    return sorted(found.values())


def _hashes(parts: int):
    """(bucket, g, hashes, counts): the different anchor hashes of a group and how often it has them, dealt out by hash."""

    def flush(g, held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = (h % np.uint64(parts)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        h, n, bucket = h[by], n[by].astype(np.uint32), bucket[by]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(cut[1:], len(h))
        return _batch({"bucket": pa.array(bucket[cut]), "g": pa.array(np.full(len(cut), g, np.int32)), "h": pa.array([h[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()),
                       "n": pa.array([n[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, size, seen = [], None, 0, set()
        for b in batches:
            for g, sha, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if g != at or size > 4_000_000:
                    if held and size:
                        yield flush(at, held)
                    held, size, seen, at = [], 0, (seen if g == at else set()), g
                if sha not in seen:
                    seen.add(sha)
                    held.append(anchor_places(text.as_py().encode("utf-8", "surrogatepass")))
                    size += len(held[-1])
        if held and size:
            yield flush(at, held)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each bucket, from batches sorted by bucket."""
    at, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            if row["bucket"] != at and rows:
                yield at, rows
                rows = []
            at = row["bucket"]
            rows.append(row)
    if rows:
        yield at, rows


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, hashes, hot): the hashes of a group that stand at two places or more of the corpus."""
    for _, rows in _by_bucket(batches):
        h = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rows])
        n = np.concatenate([np.frombuffer(r["n"], np.uint32) for r in rows]).astype(np.int64)
        _, inverse = np.unique(h, return_inverse=True)
        total = np.bincount(inverse, weights=n)[inverse]
        ends = np.cumsum([len(r["h"]) // 8 for r in rows])
        keep_, hot = np.split(total > 1, ends[:-1]), np.split(total > HOT, ends[:-1])
        parts = [(r["g"], np.frombuffer(r["h"], np.uint64)[k].tobytes(), x[k].tobytes()) for r, k, x in zip(rows, keep_, hot, strict=True) if k.any()]
        if parts:
            g, a, x = zip(*parts, strict=True)
            yield _batch({"g": pa.array(g, pa.int32()), "h": pa.array(a, pa.binary()), "hot": pa.array(x, pa.binary())})


CONTEXTS = "bucket int, g int, h binary, id binary, short binary, first binary, strings binary, data binary"


def _contexts(parts: int):
    """The different contexts of a group's recurring anchors, each with its earliest place, dealt out by hash."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), *[(c, pa.binary()) for c in ("h", "id", "short", "first", "strings", "data")]])
        if not texts.num_rows or not answers.num_rows:
            return schema.empty_table()
        wanted = np.frombuffer(b"".join(answers.column("h").to_pylist()), np.uint64)
        hot = np.frombuffer(b"".join(answers.column("hot").to_pylist()), bool)
        by = np.argsort(wanted)
        wanted, hot = wanted[by], hot[by]
        known, found = set(), []  # found: (hash, id, short, first, bytes)
        for doc, short, _, text in _texts(texts):
            h, first = anchors(text)
            if not len(h):
                continue
            strings = np.diff(np.append(first, len(text) - LENGTH + 1))
            at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            good = np.flatnonzero(wanted[at] == h)
            for x, p, n, wide in zip(h[good].tolist(), first[good].tolist(), strings[good].tolist(), hot[at[good]].tolist(), strict=True):
                context = text[p:p + n + LENGTH - 1]
                if context in known:
                    continue
                known.add(context)
                if wide:
                    own = gram_hashes(np.frombuffer(context, np.uint8), LENGTH).tolist()
                    found.extend((y, doc, short, p + i, context[i:i + LENGTH]) for i, y in enumerate(own))
                else:
                    found.append((x, doc, short, p, context))
        if not found:
            return schema.empty_table()
        h, doc, short, first = (np.array(c, t) for c, t in zip(list(zip(*found, strict=True))[:4], (np.uint64, np.int64, np.uint64, np.uint32), strict=True))
        data = [f[4] for f in found]
        strings = np.fromiter((len(d) - LENGTH + 1 for d in data), np.uint8, len(data))
        bucket = (h % np.uint64(parts)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) != 0]))
        cols: dict[str, list] = {f.name: [] for f in schema}
        for piece in np.split(by, cut[1:]):
            cols["bucket"].append(int(bucket[piece[0]]))
            cols["g"].append(texts.column("g")[0].as_py())
            for name, values in (("h", h), ("id", doc), ("short", short), ("first", first), ("strings", strings)):
                cols[name].append(values[piece].tobytes())
            cols["data"].append(b"".join([data[i] for i in piece]))
        return pa.Table.from_pydict(cols, schema=schema)

    return run


SPANS = "g int, short binary, start binary, stop binary"


def _spans(rows: list[dict], strings_at_once: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(g, short, start, stop) of the removed places of a bucket."""
    h, doc, short, first, strings = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in
                                     (("h", np.uint64), ("id", np.int64), ("short", np.uint64), ("first", np.uint32), ("strings", np.uint8)))
    g = np.repeat([r["g"] for r in rows], [len(r["strings"]) for r in rows])
    first, strings = first.astype(np.int64), strings.astype(np.int64)
    data = b"".join(r["data"] for r in rows)
    ends = np.cumsum(strings + LENGTH - 1).tolist()
    by = np.lexsort((first, short, doc, h))  # one hash after the other, each in document order
    rank = np.zeros(len(by), np.int64)
    rank[by] = np.concatenate([[0], np.cumsum((np.diff(doc[by]) != 0) | (short[by][1:] != short[by][:-1]))])
    firsts, out, todo, known, size = first.tolist(), [], [], {}, 0

    def finish():
        if todo:
            for i, flags in zip(todo, repeated([known_bytes[i] for i in todo], first[todo], rank[todo]), strict=True):
                out.extend((i, firsts[i] + a, firsts[i] + b + LENGTH) for a, b in runs(flags))

    known_bytes: dict[int, bytes] = {}
    group_start = np.concatenate([[True], h[by][1:] != h[by][:-1]]).tolist()
    for new, i in zip(group_start, by.tolist(), strict=True):
        if new:
            known = {}
            if size > strings_at_once:
                finish()
                todo, known_bytes, size = [], {}, 0
        stop = ends[i]
        text = data[stop - strings[i] - LENGTH + 1:stop]
        if text in known:  # the same context further on: all of it is repeated
            out.append((i, firsts[i], firsts[i] + len(text)))
        else:
            known[text] = i
            known_bytes[i] = text
            todo.append(i)
            size += int(strings[i])
    finish()
    if out:
        i, start, stop = (np.array(c) for c in zip(*out, strict=True))
        yield g[i], short[i], start, stop


def _sorted(strings_at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            for g, short, start, stop in _spans(rows, strings_at_once):
                by = np.argsort(g, kind="stable")
                pieces = np.split(by, np.flatnonzero(np.diff(g[by])) + 1)
                yield _batch({"g": pa.array([int(g[p[0]]) for p in pieces], pa.int32()), "short": pa.array([short[p].tobytes() for p in pieces], pa.binary()),
                              "start": pa.array([start[p].astype(np.uint32).tobytes() for p in pieces], pa.binary()), "stop": pa.array([stop[p].astype(np.uint32).tobytes() for p in pieces], pa.binary())})

    return run


def _cut(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """(sha, n_removed, n_spans, kept_sha256) of every text of a group that loses bytes."""
    schema = pa.schema([("sha", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    found = _texts(texts) if texts.num_rows else []
    gone: dict[int, list[tuple[int, int]]] = {}
    if spans.num_rows:
        short, start, stop = (np.frombuffer(b"".join(spans.column(c).to_pylist()), t) for c, t in (("short", np.uint64), ("start", np.uint32), ("stop", np.uint32)))
        for s, a, b in zip(short.tolist(), start.tolist(), stop.tolist(), strict=True):
            gone.setdefault(s, []).append((a, b))
    # contexts that this group has twice: only the first place was sent out
    placed = [(i, *anchors(t[3])) for i, t in enumerate(found)]
    placed = [p for p in placed if len(p[1])]
    if placed:
        every, counts = np.unique(np.concatenate([p[1] for p in placed]), return_counts=True)
        twice = every[counts > 1]
        known = set()
        for i, h, first in placed if len(twice) else ():
            text, short = found[i][3], found[i][1]
            strings = np.diff(np.append(first, len(text) - LENGTH + 1))
            at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
            for k in np.flatnonzero(twice[at] == h).tolist():
                key = text[first[k]:first[k] + strings[k] + LENGTH - 1]
                if key in known:
                    gone.setdefault(short, []).append((int(first[k]), int(first[k]) + len(key)))
                else:
                    known.add(key)
    out = []
    for _, short, sha, text in found:
        if short in gone:
            spans_, digest, end, removed, n = sorted(gone[short]), hashlib.sha256(), 0, 0, 0
            for a, b in spans_:
                if a > end or not n:
                    digest.update(text[end:a])
                    n += 1
                    removed += b - a
                    end = b
                elif b > end:
                    removed += b - end
                    end = b
            digest.update(text[end:])
            out.append((sha, removed, n, digest.hexdigest()))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else schema.empty_table()


def remove_repeats(docs: DataFrame, strings_at_once: int = 400_000) -> DataFrame:
    """Per row of `docs(doc_id, text)`: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    Texts are UTF-8 bytes; null counts as empty, and a text of fewer than LENGTH bytes loses nothing.  Ids are whole numbers; null comes
    before every number, rows of one id go by the hash of their text, and of rows repeated under one id and text one keeps it.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("sha", F.sha2("text", 256))
    rows = keep(d.select("doc_id", "id", "sha", F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")), "rows")
    size = rows.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))

    group = F.pmod(F.xxhash64("sha"), F.lit(parts)).cast("int").alias("g")
    once = d.filter(F.octet_length("text") >= LENGTH).select("id", "sha", "text").mapInArrow(_once, "id long, sha string, text string")
    name = f"texts_{uuid.uuid4().hex}"
    (once.select(group, "id", "sha", "text").repartition(parts, "g").write.bucketBy(parts, "g").sortBy("g").option("path", work_folder(spark, "texts")).saveAsTable(name))
    texts = spark.table(name)
    hashes = texts.select("g", "sha", "text").mapInArrow(_hashes(parts), "bucket int, g int, h binary, n binary")
    answers = hashes.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_recurring, "g int, h binary, hot binary")
    contexts = texts.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_contexts(parts), CONTEXTS)
    spans = contexts.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_sorted(strings_at_once), SPANS)
    cut = keep(texts.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(_cut, "sha string, n_removed long, n_spans long, kept_sha256 string"), "cut")
    spark.sql(f"DROP TABLE {name}")

    firsts = rows.groupBy("sha").agg(F.min(F.struct("id", "row")).alias("first")).join(cut, "sha", "left")
    own = F.struct("id", "row") == F.col("first")
    long_ = F.col("n_bytes") >= LENGTH

    def value(column: str, kept: Column, lost: Column) -> Column:
        return F.when(~long_, kept).when(own, F.coalesce(column, kept)).otherwise(lost).alias(column)

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return rows.join(firsts, "sha").select("doc_id", "n_bytes", value("n_removed", zero, F.col("n_bytes")), value("n_spans", zero, one), value("kept_sha256", F.col("sha"), F.lit(EMPTY)))
