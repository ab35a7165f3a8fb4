"""Directory trees as tables: inventories, dataset manifests, routed output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.functions.paths import review_folder

MANIFEST_DIGITS = 3


def list_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(name, path, size, modified[, content]) of every file below a first-level directory of `root`."""
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    rel = F.expr("replace(regexp_replace(path, '^file:/*', '/'), _root || '/', '')")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("_root", base)
    cols = [F.substring_index(rel, "/", 1).alias("name"), F.regexp_replace(rel, "^[^/]*/", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return raw.select(*cols, *(["content"] if content else [])).filter("path <> name")


def directory_inventory(files: DataFrame) -> DataFrame:
    """Bytes and newest file per first-level directory (the reader sees files, so an empty directory is absent)."""
    return files.groupBy("name").agg(F.sum("size").alias("bytes"), F.max("modified").alias("modified"), F.count(F.lit(1)).alias("files"))


def manifest_hash(files: DataFrame, cap: int = 0, digits: int = MANIFEST_DIGITS) -> DataFrame:
    """SHA-256 per dataset over (relative path, size, content); with a `cap` only that many first bytes.

    A hash of hashes in two levels: files are hashed where they are read, path buckets next, so neither contents
    nor the file list of a large dataset meet in one task.  `digits` hex digits of the path's MD5 name a bucket.
    """
    body = F.substring("content", 1, cap) if cap > 0 else F.col("content")
    f = files.filter("content is not null").select("name", "path", "size", F.sha2(body, 256).alias("h"), F.substring(F.md5("path"), 1, digits).alias("bucket"))

    def digest(rows: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: F.to_json(r)), "\n"), 256)

    b = f.groupBy("name", "bucket").agg(digest(F.struct("path", "size", "h")).alias("bh"), F.count(F.lit(1)).alias("n"))
    return b.groupBy("name").agg(digest(F.struct("bucket", "bh")).alias("manifest"), F.sum("n").alias("files"))


def route(rows: DataFrame) -> DataFrame:
    """Adds destination and folder: library for resolved rows without review, else review.

    `rows` (item_id, number, needs_review, reason, fingerprint).
    """
    lib = F.coalesce((F.col("number") > 0) & ~F.col("needs_review"), F.lit(False))
    dest = F.when(lib, "library").otherwise("review")
    return rows.withColumns({"destination": dest, "folder": F.when(~lib, review_folder(F.col("reason"), F.col("fingerprint"), F.col("item_id")))})


def write_routed(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Routed rows as Parquet, one partition folder per destination."""
    route(rows).write.mode(mode).partitionBy("destination").parquet(path)
