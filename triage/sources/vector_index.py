"""A vector index that is updated in place: keyed buckets, copy on write, tombstones.

Layout under ``root``:

* ``data/version=V/bucket=B``: the rows of a bucket as version V wrote them;
* ``files/version=V``: (repo, path, content_hash) of all files that are indexed as of V;
* ``manifest/version=V``: for every bucket the version whose folder holds it; written last.

A chunk belongs to the bucket of its (repo, chunk_id). An update rewrites the buckets of changed
chunks only and lists the rest as they are. A chunk that is gone stays as a tombstone (``removed``,
no vector), so that copies elsewhere can follow, until ``drop_tombstones``. A reader takes the
greatest version with a manifest: an update that died half way is never seen, and its folders
are overwritten by the next one. Older versions stay readable until their folders are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.functions.scale import stage, unstage
from triage.functions.vectors import embedder
from triage.operators.chunks import build_chunks
from triage.sources.tables import unprocessed

BUCKETS = 64
KEY = ("repo", "chunk_id")


def version_of(spark: SparkSession, root: str) -> int:
    """The version a reader sees; 0 before the first one."""
    try:
        return spark.read.parquet(f"{root}/manifest").agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return 0
        raise


def _manifest(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    """Version by bucket; as many rows as there are buckets."""
    if not version:
        return {}
    rows = spark.read.parquet(f"{root}/manifest/version={version}").collect()
    return {r["bucket"]: r["written"] for r in rows}


def read(spark: SparkSession, root: str, version: int | None = None, removed: bool = False) -> DataFrame:
    """The chunks of a version (the newest), with ``written``; with ``removed`` tombstones too."""
    version = version_of(spark, root) if version is None else version
    found = _read(spark, root, _manifest(spark, root, version))
    if found is None:
        raise FileNotFoundError(f"no version {version} of a vector index at {root}")
    return found if removed else found.where("not removed").drop("removed")


def _read(spark: SparkSession, root: str, buckets: dict[int, int]) -> DataFrame | None:
    folders = [f"{root}/data/version={v}/bucket={b}" for b, v in sorted(buckets.items())]
    return spark.read.parquet(*folders) if folders else None


def files_of(spark: SparkSession, root: str) -> DataFrame | None:
    """(repo, path, content_hash) of the files the newest version has indexed."""
    version = version_of(spark, root)
    return spark.read.parquet(f"{root}/files/version={version}") if version else None


def write(
    spark: SparkSession, root: str, changed: DataFrame, removed: DataFrame, files: DataFrame, buckets: int = BUCKETS
) -> int:
    """Put ``changed`` chunks (with vectors) and tombstones for ``removed`` (repo, chunk_id, path) on top.

    ``files`` are the file keys of the new version. ``buckets`` counts at creation only. Returns the version.
    """
    old = version_of(spark, root)
    held = _manifest(spark, root, old)
    buckets = len(held) or buckets
    new, bucket = old + 1, F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")
    delta = changed.withColumn("removed", F.lit(False)).unionByName(
        removed.select(*KEY, "path").withColumn("removed", F.lit(True)), allowMissingColumns=True
    ).withColumn("written", F.lit(new)).withColumn("_bucket", bucket)
    delta = stage(delta, "vector-delta")
    touched = {r["_bucket"] for r in delta.select("_bucket").distinct().collect()}  # at most one row per bucket
    if not held:
        touched = set(range(buckets))  # every bucket gets a folder once
    kept = _read(spark, root, {b: v for b, v in held.items() if b in touched})
    rows = delta
    if kept is not None:
        kept = kept.withColumn("_bucket", bucket).join(delta.select(*KEY), list(KEY), "left_anti")
        rows = kept.unionByName(delta, allowMissingColumns=True)
    out = f"{root}/data/version={new}"
    rows.repartition("_bucket").withColumn("bucket", F.col("_bucket")).drop("_bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
    written = {r["bucket"] for r in spark.read.parquet(out).select("bucket").distinct().collect()} if touched else set()
    schema = rows.drop("_bucket").schema
    for b in touched - written:  # no chunk fell into it
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/bucket={b}")
    files.select("repo", "path", "content_hash").write.mode("overwrite").parquet(f"{root}/files/version={new}")
    lines = [(b, new if b in touched else held[b]) for b in range(buckets)]
    spark.createDataFrame(lines, "bucket int, written int").coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest/version={new}")
    unstage(delta)
    return new


def update(
    spark: SparkSession, root: str, files: DataFrame, symbols: Callable[[DataFrame], DataFrame],
    provider: str | Callable[[Column], Column] = "hashed_terms", buckets: int = BUCKETS,
) -> int:
    """Bring the index to a new snapshot: ``files`` (with content_hash) are all files of their repositories.

    Only files whose (repo, path, content) the index does not hold are scanned and embedded. Chunks
    of edited or missing files that are not written anew are removed. Other repositories stay.
    """
    keys = ["repo", "path", "content_hash"]
    done = files_of(spark, root)
    todo = stage(files if done is None else unprocessed(files, done), "vector-todo")
    hashes = todo.select(*keys)
    fresh = build_chunks(todo, symbols(todo)).join(hashes, ["repo", "path"])
    fresh = stage(fresh.withColumn("embedding", embedder(provider)(F.col("embedding_text"))).drop("embedding_text"), "vector-fresh")
    now = files.select(*keys)
    repos = now.select("repo").distinct()
    if done is None:
        gone = fresh.where("false").select(*KEY, "path")
        all_files = now
    else:
        stale = read(spark, root).join(repos, "repo", "left_semi").join(now, keys, "left_anti")
        gone = stale.join(fresh.select(*KEY), list(KEY), "left_anti").select(*KEY, "path")
        all_files = done.join(repos, "repo", "left_anti").unionByName(now)
    version = write(spark, root, fresh, gone, all_files, buckets)
    for used in (todo, fresh):
        unstage(used)
    return version


def drop_tombstones(spark: SparkSession, root: str) -> int:
    """A new version in which the buckets that hold tombstones are written without them."""
    version = version_of(spark, root)
    held = _manifest(spark, root, version)
    found = _read(spark, root, held).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(len(held))).cast("int"))
    touched = {r["bucket"] for r in found.where("removed").select("bucket").distinct().collect()}
    if not touched:
        return version
    new = version + 1
    rows = found.where(F.col("bucket").isin(sorted(touched)) & ~F.col("removed"))
    out = f"{root}/data/version={new}"
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
    filled = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    for b in touched - filled:
        spark.createDataFrame([], rows.drop("bucket").schema).write.mode("overwrite").parquet(f"{out}/bucket={b}")
    spark.read.parquet(f"{root}/files/version={version}").write.mode("overwrite").parquet(f"{root}/files/version={new}")
    lines = [(b, new if b in touched else v) for b, v in held.items()]
    spark.createDataFrame(lines, "bucket int, written int").coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest/version={new}")
    return new
