"""Session settings and lineage cutting shared by all jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "catalogops", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; a machine-local one only where everything runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder (spark.checkpoint.dir)."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables inside the cluster's shared checkpoint folder."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder: lineage ends, columns stay prunable, and Spark knows the size, so it
    broadcasts what is small and shuffles the rest."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_dealt(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """The same in `parts` buckets of `key`: Spark knows how the rows are dealt, so what is grouped or joined by `key` moves nothing again."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", work_folder(spark, name)).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved, so the name can go; the files stay
    spark.sql(f"DROP TABLE {table}")
    return out
