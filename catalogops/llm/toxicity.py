"""Toxicity: a weighted lexicon, matched by one Aho-Corasick automaton per task.

Text is folded first: lower case, look-alike letters of other scripts, full-width forms and digits inside words.  Lexicon
entries are words or word beginnings; each has a log-odds weight learnt from labelled texts.  Hits inside an exception phrase do not
count.  The weight of all hits, absolute and per hundred words, goes through a fitted logistic curve.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogops.llm.common import fit_logistic, keep, map_texts, remainder, sigmoid

# Letters of other scripts that look like a Latin one, and digits and signs that stand for a letter inside a word.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁԛԝһӏαβεικνορτυχωɑɡıℓ", "abekmhopctyxijsdqwhlabeiknoptuxwagil", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
# Phrases in which a lexicon word means no offence.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "white trash bag", "loser bracket")
_FOLD = str.maketrans(LOOKALIKES | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {c: None for c in "­​‌‍⁠﻿"})
_INSIDE = re.compile(r"(?<=[^\W\d_])[0134578@$]|[0134578@$](?=[^\W\d_])")
_MAYBE = re.compile(r"[0134578@$]")
_WORD = re.compile(r"[^\W_]+")
LENGTHS = (4, 5, 6, 7, 8)


def fold(text: str) -> str:
    t = text.lower().translate(_FOLD) if not text.isascii() else text.lower()
    if _MAYBE.search(t):
        for _ in range(2):
            t = _INSIDE.sub(lambda m: SUBSTITUTES[m[0]], t)
    return t


def entries_of(text: str) -> set[str]:
    """Candidate entries of a text: its words (closed by a blank) and their beginnings."""
    out = set()
    for w in set(_WORD.findall(fold(text))):
        if len(w) >= 3:
            out.add(w + " ")
            out.update(w[:n] for n in LENGTHS if n <= len(w))
    return out


class Lexicon:
    """Entry -> weight.  An entry that ends in a blank is a whole word, any other the beginning of one."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.exceptions = dict(weights), tuple(fold(e) for e in exceptions)

    def automaton(self):
        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            key = entry.rstrip(" ")
            _, whole, begin = a.get(key, (key, 0.0, 0.0))
            a.add_word(key, (key, max(whole, w), begin) if entry.endswith(" ") else (key, whole, max(begin, w)))
        for e in self.exceptions:
            key, whole, begin = a.get(e, (e, 0.0, 0.0))
            a.add_word(e, (key, whole, begin, True))
        if len(a):
            a.make_automaton()
        return a

    def hits(self, automaton, text: str) -> list[tuple[int, float, str]]:
        """(start, weight, entry) of every word hit, the strongest entry of each word; exceptions removed.  Starts count in the folded text."""
        if not len(automaton):
            return []
        t = fold(text)
        found, free = {}, []
        for end, item in automaton.iter(t):
            key, whole, begin = item[:3]
            start = end - len(key) + 1
            if start and t[start - 1].isalnum():
                continue
            closed = end + 1 == len(t) or not t[end + 1].isalnum()
            if len(item) == 4 and closed:
                free.append((start, end))
            w = max(whole if closed else 0.0, begin)
            if w > found.get(start, (0.0,))[0]:
                found[start] = (w, key if begin == w else key + " ")
        return [(s, w, e) for s, (w, e) in sorted(found.items()) if not any(a <= s <= b for a, b in free)]


def features(hits: list[tuple[int, float, str]], text: str) -> list[float]:
    total = sum(h[1] for h in hits)
    words = text.count(" ") + text.count("\n") + 1
    return [np.log1p(total), np.log1p(100 * total / words)]


def learn_entries(counts, n_toxic: int, n_other: int, most: int = 5000, candidates: int = 0) -> dict[str, float]:
    """Log odds of (entry, toxic texts, other texts) rows that are too one-sided for chance.

    The likelihood ratio against an entry that ignores the label must exceed three times the log of the number of
    candidates (the rows, or more if so many were looked at).  A longer entry is dropped when a beginning of it is kept with nearly its weight.  `most` bounds the lexicon.
    """
    share = n_toxic / max(1, n_toxic + n_other)
    kept = {}
    for entry, t, n in counts:
        w = np.log((t + 0.5) / (n_toxic + 1)) - np.log((n + 0.5) / (n_other + 1))
        ratio = 2 * (t * np.log(t / ((t + n) * share)) + (n * np.log(n / ((t + n) * (1 - share))) if n else 0.0)) if t and 0 < share < 1 else 0.0
        if w > 1 and ratio > 3 * np.log(max(candidates, len(counts)) + 1):
            kept[entry] = (float(w), t)
    out = {}
    for entry, (w, t) in sorted(kept.items(), key=lambda x: (len(x[0]), x[0])):
        shorter = (out.get(entry[:k]) for k in range(3, len(entry)))
        if not any(s and s > w - 1 for s in shorter):
            out[entry] = w
    return dict(sorted(out.items(), key=lambda x: (-kept[x[0]][1], x[0]))[:most])


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, per_class: int = 6000) -> tuple[Lexicon, np.ndarray | None]:
    """Lexicon and curve from `docs(doc_id, text)` and `labels(doc_id, label)`, at most `per_class` texts of each label.

    Texts that share forty characters of their middle count once, so that copies do not vote.  The curve is fitted to each half of the
    texts with the entries of the other half; the lexicon itself learns from both.  None stands for the curve when a class is missing.
    """
    middle = F.xxhash64(F.expr("substring(text, greatest(1, cast(length(text) / 2 as int) - 20), 40)"))
    hashed = docs.filter("text is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    known = hashed.select("doc_id", "h", middle.alias("m")).join(labels.filter("label in (0, 1)").distinct(), "doc_id")
    once = keep(known.groupBy("label", "m").agg(F.min(F.struct("doc_id", "h")).alias("at")).select("label", "at.doc_id", "at.h"), "labelled")
    sizes = {r.label: r["count"] for r in once.groupBy("label").count().collect()}
    if set(sizes) != {0, 1}:
        return Lexicon({}, exceptions), None
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h"))
    order = F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 << 20))
    part = F.coalesce(*[F.when(F.col("label") == k, F.lit((1 << 20) * min(1.0, 1.2 * per_class / n))) for k, n in sizes.items()])
    chosen = once.filter(order < part).withColumn("rank", rank).filter(F.col("rank") <= per_class).select("doc_id", "h", "label")
    # at most per_class rows of three numbers a label; rows repeated under one id and text are one text
    texts = hashed.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h", "label").agg(F.first("text").alias("text"))
    texts = keep(texts.withColumn("half", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(2)).cast("int")), "toxicity-sample")

    def counts(batches):
        for b in batches:
            seen = [Counter() for _ in range(4)]
            for t, label, half in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seen[2 * half + label].update(entries_of(t))
            keys = list(seen[0] | seen[1] | seen[2] | seen[3])
            yield pa.RecordBatch.from_pydict({"entry": pa.array(keys, pa.string())} | {c: pa.array([s[e] for e in keys], pa.int64()) for c, s in zip(("n0", "t0", "n1", "t1"), seen, strict=True)})

    size = {(r.half, r.label): r["count"] for r in texts.groupBy("half", "label").count().collect()}
    rows = (texts.select("text", "label", "half").mapInArrow(counts, "entry string, n0 long, t0 long, n1 long, t1 long")
            .groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")]).filter("t0 + t1 >= 3 and t0 + t1 > n0 + n1").collect())  # bounded by the sample
    n_toxic, n_other = (size.get((0, k), 0) + size.get((1, k), 0) for k in (1, 0))
    first = learn_entries([(r.entry, r.t0 + r.t1, r.n0 + r.n1) for r in rows], n_toxic, n_other)
    free = learn_entries(distinct_evidence(texts, Lexicon(first, exceptions)), n_toxic, n_other, candidates=len(rows))
    both = Lexicon(free, exceptions)
    x = []
    for half in (0, 1):
        known = [(r.entry, r.t1 if half == 0 else r.t0, r.n1 if half == 0 else r.n0) for r in rows if r.entry in free]
        other = Lexicon(learn_entries(known, size.get((1 - half, 1), 0), size.get((1 - half, 0), 0)), exceptions)
        x += score_features(texts.filter(F.col("half") == half), ["doc_id", "label"], other).collect()
    x.sort(key=lambda r: (r.doc_id, r.label))
    return both, fit_logistic(np.array([r.x for r in x]), np.array([r.label for r in x], float))


def surroundings(text: str, hits: list[tuple[int, float, str]], reach: int = 1) -> list[tuple[str, str]]:
    """The entry of every hit with `reach` words before and after it."""
    words = [(m.start(), m[0]) for m in _WORD.finditer(fold(text))]
    at = {start: i for i, (start, _) in enumerate(words)}
    out = []
    for start, _, entry in hits:
        i = at.get(start)
        if i is not None:
            out.append((entry, " ".join(words[i + k][1] if 0 <= i + k < len(words) else "" for k in range(-reach, reach + 1) if k)))
    return out


def independent(around: list[str]) -> int:
    """Number of surroundings that do not repeat a counted one: two of its words in the same places make a repeat."""
    seen, n = set(), 0
    for s in sorted(set(around)):
        pairs = {p for p in combinations(enumerate(s.split(" ")), 2) if p[0][1] and p[1][1]}
        n += seen.isdisjoint(pairs)
        seen |= pairs
    return n


def distinct_evidence(texts: DataFrame, lexicon: Lexicon) -> list[tuple[str, int, int]]:
    """(entry, toxic, other) counts of its hits in `texts(text, label)`, with repeated surroundings counted once, so that edited copies do not vote."""
    cache = []

    def run(batches):
        if not cache:
            cache.append(lexicon.automaton())
        for b in batches:
            rows = [(e, label, a) for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for e, a in surroundings(t, lexicon.hits(cache[0], t), 2)]
            yield pa.RecordBatch.from_pydict({"entry": pa.array([r[0] for r in rows], pa.string()), "label": pa.array([r[1] for r in rows], pa.int32()), "around": pa.array([r[2] for r in rows], pa.string())})

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([independent(a) for a in b.column(2).to_pylist()], pa.int64())], ["entry", "label", "n"])

    sets = texts.select("text", F.col("label").cast("int")).mapInArrow(run, "entry string, label int, around string").groupBy("entry", "label").agg(F.collect_set("around").alias("around"))
    out: dict[str, list[int]] = {}
    for r in sets.mapInArrow(count, "entry string, label int, n long").collect():  # bounded by the lexicon
        out.setdefault(r.entry, [0, 0])[r.label] = r.n
    return [(e, t, n) for e, (n, t) in sorted(out.items())]


def score_features(docs: DataFrame, ids: list[str], lexicon: Lexicon) -> DataFrame:
    cache = []

    def run(part):
        if not cache:
            cache.append(lexicon.automaton())
        return {"x": [features(lexicon.hits(cache[0], t), t) if t else [0.0, 0.0] for t in part]}

    return map_texts(docs, ids, "text", run, "x array<double>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, hold_out: int = 5, threshold: float = 0.5) -> DataFrame:
    """Every row of `docs` with held_out, score and predicted.

    Labels of rows with crc32(doc_id) mod `hold_out` = 0 are not learnt from; null labels and texts are ignored in learning.  Null
    and empty texts have no hit and get the score of such texts; without labels of both classes every score is 0.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(F.col("label").isNotNull() & (remainder("doc_id", hold_out) != 0))
    lexicon, curve = fit(docs.select("doc_id", "text"), known)
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", hold_out) == 0, F.lit(False)).alias("held_out"), "text")
    cache = []

    def run(part):
        if not cache:
            cache.append(lexicon.automaton())
        x = np.array([features(lexicon.hits(cache[0], t), t) if t else [0.0, 0.0] for t in part]).reshape(-1, 2)
        p = sigmoid(x @ curve[:-1] + curve[-1]) if curve is not None else np.zeros(len(x))
        return {"score": p.tolist(), "predicted": (p >= threshold).astype(int).tolist()}

    return map_texts(rows, ["doc_id", "held_out"], "text", run, "score double, predicted int")
