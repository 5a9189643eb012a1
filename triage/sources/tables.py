"""Parquet stores for the index and for vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("repo", "commit_sha")


def write_index(df: DataFrame, path: str) -> None:
    """Write one index table; only the (repo, commit) folders present in ``df`` are replaced."""
    (
        # even pieces of a key: a large commit is split, small ones share a task
        df.hint("rebalance", *KEYS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*KEYS)
        .parquet(path)
    )


def read_index(
    spark: SparkSession, path: str, repo: str | None = None, commit_sha: str | None = None
) -> DataFrame:
    """Read an index table; the keys prune folders and stay text, whatever they look like."""
    found = spark.read.parquet(path).schema
    keys_as_text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in KEYS else f for f in found])
    df = spark.read.schema(keys_as_text).parquet(path)
    if repo is not None:
        df = df.where(F.col("repo") == repo)
    if commit_sha is not None:
        df = df.where(F.col("commit_sha") == commit_sha)
    return df


def not_indexed(files: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """Files of commits the index does not hold yet (all of them with ``force``)."""
    if force:
        return files
    return files.join(index.select(*KEYS).distinct(), list(KEYS), "left_anti")


def unprocessed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose (repo, path, content hash) was not processed before.

    The key carries the hash, so no single value can dominate the join.
    """
    keys = ["repo", "path", "content_hash"]
    return files.join(done.select(*keys), keys, "left_anti")


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
