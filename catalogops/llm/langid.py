"""Language identification with a byte convolutional network, trained and applied in numpy.

A text is lower-cased, encoded as UTF-8 and cut into windows of WINDOW bytes that do not overlap (the last one is padded with
zeros), so the whole text is read.  Filters of several widths slide over each window; a filter of width w adds one learned weight per byte and
offset.  Max pooling keeps each filter's strongest response, a softmax layer turns them into class scores, and the scores of a
text's windows are averaged by their share of bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogops.llm.common import map_texts, remainder

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 1024  # windows in memory at once


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW) bytes of a non-empty text and the number of real bytes in each window."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    n = -(-len(raw) // WINDOW)
    used = np.full(n, WINDOW)
    used[-1] = len(raw) - WINDOW * (n - 1)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW), used


@dataclass
class Network:
    languages: list[str]
    taps: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (filters of all widths, languages)
    out_bias: np.ndarray

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Per width the filter responses (windows, positions, FILTERS); every byte is followed by zeros to the window's end."""
        padded = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))
        out = []
        for t in self.taps:
            r = t[0][padded[:, :WINDOW]]
            for k in range(1, len(t)):
                r += t[k][padded[:, k:k + WINDOW]]
            out.append(r)
        return out

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([r.max(1) for r in self.responses(x)], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [np.maximum(self.hidden(x[i:i + 64]) + self.bias, 0) @ self.out + self.out_bias for i in range(0, len(x), 64)]
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], passes: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam over shuffled batches; the gradient of max pooling goes to the position that won."""
    rng = np.random.default_rng(seed)
    n_lang = len(languages)
    params = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    hidden = FILTERS * len(WIDTHS)
    params += [np.zeros(hidden, np.float32), rng.normal(0, 0.2, (hidden, n_lang)).astype(np.float32), np.zeros(n_lang, np.float32)]
    net = Network(languages, params[:len(WIDTHS)], *params[len(WIDTHS):])
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = np.bincount(y, minlength=n_lang).astype(np.float32)
    weight = (len(y) / n_lang / np.maximum(weight, 1))[y]
    rounds = max(passes, -(-passes * 1500 // max(1, len(x))))
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            rows = order[i:i + batch]
            b = np.pad(x[rows], ((0, 0), (0, max(WIDTHS) - 1)))
            res = net.responses(x[rows])
            at = [r.argmax(1) for r in res]
            pre = np.concatenate([np.take_along_axis(r, a[:, None], 1)[:, 0] for r, a in zip(res, at, strict=True)], 1) + net.bias
            h = np.maximum(pre, 0)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = p * weight[rows, None] / len(rows)
            gh = (g @ net.out.T) * (pre > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                gt = np.zeros_like(params[k])
                part, pos = gh[:, k * FILTERS:(k + 1) * FILTERS], at[k]
                for o in range(w):
                    np.add.at(gt[o], (np.take_along_axis(b, pos + o, 1), np.arange(FILTERS)[None, :]), part)
                grads.append(gt)
            grads += [gh.sum(0), h.T @ g + 1e-4 * net.out, g.sum(0)]
            step += 1
            for j, gr in enumerate(grads):
                first[j] += 0.1 * (gr - first[j])
                second[j] += 0.001 * (gr * gr - second[j])
                params[j] -= rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
        rate *= 0.85
    return net


def sample(labelled: DataFrame, per_language: int, windows_per_text: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """At most `per_language` different texts of each language, chosen by a hash of id and text, and some windows of each.

    Repeated rows count once, and one id on many texts is many texts, so the limit holds whatever the ids are.
    """
    h = F.xxhash64("doc_id", "text")
    hashed = labelled.filter("text is not null").withColumn("h", h)
    sizes = {r.lang: r.n for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one row per language
    # as long as the list of languages that the driver holds
    limits = labelled.sparkSession.createDataFrame([(k, min(1.0, 1.2 * per_language / max(1, n))) for k, n in sizes.items()], "lang string, part double")
    place = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = hashed.join(F.broadcast(limits), "lang").filter(place < F.col("part")).groupBy("lang", "doc_id", "h").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    texts = some.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("doc_id", "lang", "text")

    def pick(part):
        out = []
        for t in part:
            if not t or not _LETTER.search(t):
                out.append([])
                continue
            w, _ = windows(t)
            out.append([w[i].tobytes() for i in sorted({int(k) for k in np.linspace(0, len(w) - 1, windows_per_text)})])
        return {"windows": out}

    rows = map_texts(texts, ["doc_id", "lang"], "text", pick, "windows array<binary>").collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.windows))  # bounded by per_language
    languages = sorted({r.lang for r in rows if r.windows})
    pairs = [(w, languages.index(r.lang)) for r in rows for w in r.windows]
    x = np.frombuffer(b"".join(w for w, _ in pairs), np.uint8).reshape(-1, WINDOW)
    return x, np.array([k for _, k in pairs], int), languages


def predict(net: Network, texts: list) -> dict:
    lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    todo = [i for i, t in enumerate(texts) if t and net.languages and _LETTER.search(t)]
    start = 0
    while start < len(todo):
        group, parts, size = [], [], 0
        while start < len(todo) and (size < _BLOCK or not group):
            w, used = windows(texts[todo[start]])
            group.append(todo[start])
            parts.append((w, used))
            size += len(w)
            start += 1
        used = np.concatenate([u for _, u in parts]).astype(np.float32)
        z = net.logits(np.concatenate([w for w, _ in parts])) * used[:, None]
        at = np.cumsum([0] + [len(u) for _, u in parts[:-1]])
        mean = np.add.reduceat(z, at) / np.add.reduceat(used, at)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, k, s in zip(group, p.argmax(1), p.max(1), strict=True):
            lang[i], score[i] = net.languages[k], float(s)
    return {"lang_pred": lang, "score": score}


def identify(docs: DataFrame, hold_out: tuple[int, int] = (4, 2), per_language: int = 500, windows_per_text: int = 4) -> DataFrame:
    """Every row of `docs` with held_out, lang_pred and score.

    Learns from rows with a non-null lang whose crc32(doc_id) modulo the first number of `hold_out` is not the second, at most
    `per_language` texts of each language.  A text that is null or has no letter is `und` with score 0, as is every text when
    nothing could be learnt.
    """
    divisor, left = hold_out
    train_rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & (remainder("doc_id", divisor) != left))
    x, y, languages = sample(train_rows, per_language, windows_per_text)
    net = train(x, y, languages) if languages else Network([], [], *[np.zeros(0)] * 3)
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", divisor) == left, F.lit(False)).alias("held_out"), "text")
    return map_texts(rows, ["doc_id", "held_out"], "text", lambda part: predict(net, part), "lang_pred string, score double")
