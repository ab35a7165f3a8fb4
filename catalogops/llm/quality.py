"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every text becomes a vector of twelve statistics.  Per class a mean and a covariance are estimated; the covariance is
shrunk towards the pooled one and towards a scaled identity.  A score is the logistic of the difference of the two
Gaussian log densities (Mahalanobis distance and log determinant from a Cholesky factor that is computed once).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import keep, map_texts, remainder, sigmoid

DIM = 12
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_UPPER = slice(65, 91)
_LOWER = slice(97, 123)
_SYMBOLS = np.array([i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-!?()|"])


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one text; null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(DIM)
    codes = np.frombuffer(raw, np.uint8)
    count = np.bincount(codes, minlength=256).astype(float)
    upper, lower, high = count[_UPPER].sum(), count[_LOWER].sum(), count[128:].sum()
    letters = upper + lower + high / 2
    lengths = np.diff(np.flatnonzero(np.concatenate([[True], _SPACE[codes], [True]]))) - 1
    lengths = lengths[lengths > 0]
    ink = lengths.sum()
    again = sum(map(bytes.__eq__, words[1:], words))
    return np.array([
        np.log1p(n),
        np.log(ink / n),
        np.log1p(lengths.std()),
        np.arcsin(np.sqrt(min(1.0, upper / max(letters, 1)))),
        np.sqrt(count[_SYMBOLS].sum() / ink),
        np.sqrt(count[33] / ink),
        np.sqrt(count[124] / ink),
        np.sqrt((count[44] + count[46]) / n),
        np.sqrt(count[48:58].sum() / ink),
        np.log1p(len(set(words))) - np.log1p(n),
        np.sqrt(again / n),
        np.log1p(count[10]) - 0.5 * np.log1p(n),
    ])


def document_statistics(docs: DataFrame, ids: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The id columns with `stats`, one vector per row."""
    return map_texts(docs, ids, text, lambda part: {"stats": [statistics(t).tolist() for t in part]}, "stats array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians with cached Cholesky factors; `missing` scores rows when a class was not seen."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    missing: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.missing is not None:
            return np.full(len(x), self.missing)
        log_density = []
        for k in (0, 1):
            z = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)
            log_density.append(self.log_prior[k] - 0.5 * ((z * z).sum(0) + self.log_det[k]))
        return sigmoid(log_density[1] - log_density[0])


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.2, identity: float = 0.02) -> Discriminant:
    """From the count, sum and sum of outer products per class; `pooled` and `identity` are the shrinkage weights."""
    if set(sums) != {0, 1}:
        return Discriminant(*[np.zeros(0)] * 4, missing=float(next(iter(sums), 0.5)))
    n = {k: s[0] for k, s in sums.items()}
    mean = {k: s[1] / s[0] for k, s in sums.items()}
    cov = {k: s[2] / s[0] - np.outer(mean[k], mean[k]) for k, s in sums.items()}
    both = sum(n[k] * cov[k] for k in n) / sum(n.values())
    scale = np.diag(np.maximum(np.diag(both), 1e-4))
    factor, log_det = [], []
    for k in (0, 1):
        own = (1 - pooled - identity) * cov[k] + pooled * both + identity * scale + 1e-6 * np.eye(DIM)
        factor.append(np.linalg.cholesky(own))
        log_det.append(2 * np.log(np.diag(factor[-1])).sum())
    prior = np.log(np.array([n[0], n[1]]) / (n[0] + n[1]))
    return Discriminant(np.array([mean[0], mean[1]]), np.array(factor), np.array(log_det), prior)


def class_sums(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Sufficient statistics per label, added up by Spark over all labelled rows: DIM * (DIM + 1) + 1 numbers per class."""
    one = F.concat(F.array(F.lit(1.0)), "stats")
    cells = (labelled.select("label", one.alias("s"))
             .select("label", F.posexplode(F.flatten(F.transform("s", lambda a: F.transform("s", lambda b: a * b)))).alias("cell", "v"))
             .groupBy("label", "cell").agg(F.sum("v").alias("v")).collect())
    out = {}
    for k in {r.label for r in cells}:
        m = np.zeros((DIM + 1) ** 2)
        for r in cells:
            if r.label == k:
                m[r.cell] = r.v
        m = m.reshape(DIM + 1, DIM + 1)
        out[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, hold_out: int = 5, threshold: float = 0.3) -> DataFrame:
    """Every row of `docs` with held_out, score and predicted; a row counts as good from `threshold` on.

    Labels of rows with crc32(doc_id) mod `hold_out` = 0 are not learnt from.  Null and empty texts have zero statistics and
    are scored like any other row; null labels are ignored; several labels of one id all count; without labels of both
    classes every score is the class seen (0.5 if none).
    """
    stats = keep(document_statistics(docs.select("doc_id", "text")), "quality-stats")
    train = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & (remainder("doc_id", hold_out) != 0))
    model = fit(class_sums(stats.join(train, "doc_id")))
    rows = stats.select("doc_id", F.coalesce(remainder("doc_id", hold_out) == 0, F.lit(False)).alias("held_out"), "stats")
    return score_statistics(rows, model, threshold)


def score_statistics(rows: DataFrame, model: Discriminant, threshold: float) -> DataFrame:
    names = [c for c in rows.columns if c != "stats"]
    schema = rows.select(*names).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for b in batches:
            s = b.column(b.schema.get_field_index("stats"))
            p = model.score(np.array(s.flatten()).reshape(len(s), DIM)) if len(s) else np.zeros(0)
            cols = {c: b.column(b.schema.get_field_index(c)) for c in names}
            yield pa.RecordBatch.from_pydict({**cols, "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    return rows.select(*names, "stats").mapInArrow(run, schema)


def good_documents(docs: DataFrame, labels: DataFrame, hold_out: int = 5, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with their own columns.  Rows with a null id are scored too."""
    train = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (remainder("doc_id", hold_out) != 0))
    labelled = docs.select("doc_id", "text").filter("doc_id is not null")
    model = fit(class_sums(document_statistics(labelled).join(train, "doc_id")))
    return filter_batches(docs, model, threshold)


def filter_batches(docs: DataFrame, model: Discriminant, threshold: float) -> DataFrame:
    """Keep accepted rows while they stream by: no join, no shuffle, every column untouched."""
    def run(batches):
        for b in batches:
            t = b.column(b.schema.get_field_index("text"))
            x = np.array([statistics(v.as_py()) for v in t]).reshape(len(t), DIM)
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
