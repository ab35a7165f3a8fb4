"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.session import configure, work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the cluster's shared folder and read back: lineage ends here, columns stay prunable."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; the remainder decides which rows are held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % divisor


def lower_ascii(c: str | Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_texts(df: DataFrame, id_columns: Sequence[str], text: str, fn: Callable[[list], dict], schema: str, chunk: int = 4 << 20) -> DataFrame:
    """`fn` over lists of texts (None stays None), about `chunk` characters at a time; the id columns are carried along.

    `fn` returns the columns of `schema` as lists or arrays, one entry per text.
    """
    ids = list(id_columns)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids)
    full = f"{fields}, {schema}" if fields else schema
    out = df.sparkSession.createDataFrame([], full).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(ids))
            start = 0
            while start < len(texts):
                part, size = [], 0
                while start + len(part) < len(texts) and (size < chunk or not part):
                    part.append(texts[start + len(part)].as_py())
                    size += len(part[-1] or "")
                got = fn(part)
                cols = [batch.column(i).slice(start, len(part)) for i in range(len(ids))]
                cols = [c.cast(arrow.field(i).type) for i, c in enumerate(cols)]
                cols += [v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(name).type) for name, v in got.items()]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
                start += len(part)

    return df.select(*ids, text).mapInArrow(run, out)


def with_safe_names(docs: DataFrame, needed: Sequence[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`fn` over `docs` with every column but `needed` renamed out of the way, and the names restored afterwards.

    A column of `docs` that has the name of one that `fn` adds gives way to it.
    """
    held = {c: c if c in needed else f"_x{i}" for i, c in enumerate(docs.columns)}
    out = fn(docs.select([F.col(f"`{c}`").alias(v) for c, v in held.items()]))
    added = [c for c in out.columns if c not in held.values()]
    return out.select([F.col(v).alias(c) for c, v in held.items() if c not in added and v in out.columns] + added)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge-penalised logistic model by Newton steps; the last weight is the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.eye(a.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(a @ w)
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) / len(a) + penalty, a.T @ (p - y) / len(a) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
