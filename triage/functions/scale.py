"""Helpers that keep plans bounded when one key holds a large share of the rows.

* ``stage`` writes an intermediate table to the shared checkpoint folder, so a
  lost executor never forces a recomputation of the whole history.
* ``broadcast_if_small`` broadcasts only after counting.
* ``number_rows`` / ``lag_rows`` are ``row_number`` / ``lag`` for groups that may
  not fit into one task: the rows are range-partitioned on (key, order) and the
  per-partition results are joined up through a small carry table.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Largest table (narrow rows) that is broadcast.
MAX_BROADCAST_ROWS = 100_000

_local_dirs: dict[str, str] = {}


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    A session on one machine may run without the setting. It then gets a folder of its
    own, since driver and tasks share the disk there, which goes when Python ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="triage-stage-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_dir(spark).rstrip('/')}/triage/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def unstage(df: DataFrame) -> None:
    """Delete a table of ``stage`` that nothing reads any more, such as the last round of a loop."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Each query that ends inside takes its shuffle files with it; else they stay until the driver
    happens to collect its garbage, and the files of several stages add up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when a count proves the bound; otherwise a shuffle join."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def _segments(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Range-partition on (keys, order); ``_seg`` numbers the partitions in order. Rows are written
    once: the sample that finds the ranges reads what the last shuffle before has left."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return stage(ranged.withColumn("_seg", F.spark_partition_id()), "segments")


def _spanning(per_seg: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found in more than one segment.

    A segment is a contiguous range, so only its first and last key can also
    occur in another one: at most two rows per segment, whatever the data size.
    """
    spans = per_seg.groupBy(*keys).agg(F.min("_seg").alias("_a"), F.max("_seg").alias("_b"))
    hot = spans.where("_a < _b").select(*keys)
    return per_seg.join(F.broadcast(hot), keys, "left_semi")


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str,
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without hot tasks."""
    seg = _segments(df, keys, order)
    counts = seg.groupBy("_seg", *keys).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    offsets = _spanning(counts, keys).select(
        "_seg", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    local = F.row_number().over(W.partitionBy("_seg", *keys).orderBy(*order))
    return (
        seg.withColumn("_rn", local)
        .join(F.broadcast(offsets), ["_seg", *keys], "left")
        .withColumn(name, (F.col("_rn") + F.coalesce("_off", F.lit(0))).cast("int"))
        .drop("_rn", "_off", "_seg")
    )


def lag_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    columns: dict[str, str],
) -> DataFrame:
    """Add ``lag(col)`` for every ``{new: col}``; hot groups are split by range."""
    packed = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])

    def unpack(frame: DataFrame, extra: list[str]) -> DataFrame:
        return frame.select("*", *[F.col("_lag")[n].alias(n) for n in columns]).drop("_lag", *extra)

    seg = _segments(df, keys, order)
    inside = W.partitionBy("_seg", *keys).orderBy(*order)
    rows = seg.withColumn("_lag", F.lag(packed).over(inside)).withColumn(
        "_rn", F.row_number().over(inside)
    )
    last = (
        seg.withColumn(
            "_back",
            F.row_number().over(W.partitionBy("_seg", *keys).orderBy(*[_reverse(o) for o in order])),
        )
        .where("_back = 1")
        .select("_seg", *keys, packed.alias("_last"))
    )
    carry = _spanning(last, keys).select(
        "_seg", *keys, F.lag("_last").over(W.partitionBy(*keys).orderBy("_seg")).alias("_carry")
    )
    joined = rows.join(F.broadcast(carry), ["_seg", *keys], "left").withColumn(
        "_lag", F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    )
    return unpack(joined, ["_rn", "_carry", "_seg"])


def _reverse(order: Column) -> Column:
    # callers of lag_rows pass plain ascending columns
    return order.desc()
