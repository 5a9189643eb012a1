"""Jobs over inputs that keep arriving: test results and repository files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from triage.operators import files as fo
from triage.operators import imports as im
from triage.operators import symbols as sy
from triage.operators.reports import is_failing
from triage.sources.tables import unprocessed


def failure_counts(
    results: DataFrame,
    ts: str = "ts",
    window: str = "1 hour",
    slide: str | None = None,
    late: str | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Failing tests per exception type and time window (and the columns ``by``).

    ``results(ts, outcome, exception_type)``, streaming or not. The state is one count per
    window and type, and no row is too late. With ``late`` a stream forgets windows older than
    that and drops rows that come for them. Passing tests are filtered before any state is kept.
    """
    timed = results.withColumn(ts, F.col(ts).cast("timestamp"))
    failing = timed.where(is_failing(F.col("outcome")))
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        (failing.withWatermark(ts, late) if late else failing)
        .groupBy(span.alias("w"), "exception_type", *by)
        .agg(F.count("*").alias("failures"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "exception_type", *by, "failures",
        )
    )


def from_file() -> Column:
    """What tells the files of a file stream apart, a file that was written anew included."""
    return F.concat_ws(
        "|", "_metadata.file_path", F.col("_metadata.file_size").cast("string"),
        F.unix_micros("_metadata.file_modification_time").cast("string"),
    )


def count_failures(results: DataFrame, target: str, checkpoint: str, file: str = "file", **windows: str) -> StreamingQuery:
    """Partial ``failure_counts`` of a stream, a ledger with an entry per input file, window and type.

    ``file`` names a column that tells the input files apart (``from_file``). A file is read
    whole in one batch, so its entry is complete, and every query that reads the file writes the
    same entry: ``current_counts`` takes each once and adds them up. So any number of queries
    and checkpoints may share a target, over the same input or over different parts of it, and
    a batch that runs again or was left half written changes nothing. No state is kept.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        entries = failure_counts(batch, by=(file,), **windows).withColumnRenamed(file, "file")
        entries.write.mode("overwrite").parquet(_folder(batch, target, batch_id))

    return (
        results.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_counts(spark: SparkSession, target: str) -> DataFrame:
    """The failures of every window over all files in the ledger."""
    keys = ["window_start", "window_end", "exception_type"]
    entries = read_streamed(spark, target).groupBy("file", *keys).agg(F.max("failures").alias("failures"))
    return entries.groupBy(*keys).agg(F.sum("failures").alias("failures"))


def index_files(files: DataFrame, target: str, checkpoint: str, ts: str = "ts") -> StreamingQuery:
    """Index files as they arrive, however late; a row with null content says that the file is gone.

    Contents are indexed once: ``files``, ``symbols`` and ``imports`` are tables by (repo, path,
    content_hash), and a content that is there already is skipped. What a path holds at a time is
    a narrow log of its own, ``versions`` (repo, path, content_hash, ts); a file that returns to an
    earlier content only adds a line to it. ``current`` reads both.

    Folders are named by query and batch. The last thing a batch writes is its line in ``commits``,
    and nothing without that line is read: a batch that ended half way is as if it had not been,
    whether it runs again or another checkpoint goes on. A batch with its line does not run again.
    """
    spark = files.sparkSession
    keys = ["repo", "path", "content_hash"]

    def write(batch: DataFrame, batch_id: int) -> None:
        own = {t: _folder(batch, f"{target}/{t}", batch_id) for t in ("files", "symbols", "imports", "versions", "commits")}
        query, number = (x.split("=")[1] for x in own["commits"].rsplit("/", 2)[1:])
        commits = _read_or_none(spark, f"{target}/commits")
        if commits is not None:
            if not commits.where((F.col("query_id") == query) & (F.col("batch_id") == number)).isEmpty():
                return
        batch = batch.persist()
        try:
            batch.select(*keys, ts).distinct().withColumnRenamed(ts, "ts").write.mode("overwrite").parquet(own["versions"])
            todo = batch.where("content is not null").dropDuplicates(keys)
            if commits is not None:
                todo = unprocessed(todo, committed(spark, target, "files"))
            todo.drop(ts).write.mode("overwrite").parquet(own["files"])
        finally:
            batch.unpersist()
        # read back: symbols and imports then see exactly what was written
        written = spark.read.parquet(own["files"])
        sy.extract(written, keep=("content_hash",)).write.mode("overwrite").parquet(own["symbols"])
        im.extract(written, keep=("content_hash",)).write.mode("overwrite").parquet(own["imports"])
        spark.range(1).write.mode("overwrite").parquet(own["commits"])

    return (
        fo.index_files(files).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def committed(spark: SparkSession, target: str, name: str) -> DataFrame:
    """The rows of one table of ``index_files`` that committed batches wrote."""
    ids = ["query_id", "batch_id"]
    # one row per batch; the join prunes the folders of the table
    commits = read_streamed(spark, f"{target}/commits").select(*ids).distinct()
    return read_streamed(spark, f"{target}/{name}").join(commits, ids, "left_semi")


def versions(spark: SparkSession, target: str) -> DataFrame:
    """(repo, path, content_hash, ts): what each path holds, null for a file that is gone.

    The latest line wins; of lines with one ``ts`` a content wins over its removal, then the greater hash.
    """
    newest = F.max(F.struct("ts", F.col("content_hash").isNotNull().alias("there"), "content_hash")).alias("v")
    return committed(spark, target, "versions").groupBy("repo", "path").agg(newest).select(
        "repo", "path", "v.content_hash", "v.ts"
    )


def current(spark: SparkSession, target: str, name: str) -> DataFrame:
    """The rows of ``files``, ``symbols`` or ``imports`` that belong to what each path holds now."""
    keys, ids = ["repo", "path", "content_hash"], ["query_id", "batch_id"]
    # checkpoints that run at one time may both index a content: one of the batches stands for it
    owner = committed(spark, target, "files").groupBy(*keys).agg(F.min(F.struct(*ids)).alias("b"))
    held = versions(spark, target).where("content_hash is not null").select(*keys)
    owner = owner.join(held, keys, "left_semi").select(*keys, "b.query_id", "b.batch_id")
    return read_streamed(spark, f"{target}/{name}").join(owner, [*keys, *ids], "left_semi").drop(*ids)


def read_streamed(spark: SparkSession, path: str) -> DataFrame:
    """A table that batches wrote, with ``query_id`` and ``batch_id`` as text."""
    found = spark.read.parquet(path).schema
    ids = ("query_id", "batch_id")
    as_text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ids else f for f in found])
    return spark.read.schema(as_text).parquet(path)


def _folder(batch: DataFrame, path: str, batch_id: int) -> str:
    """A folder for each query and batch; the query's id lives in its checkpoint."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{path}/query_id={query}/batch_id={batch_id}"


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that may not be there yet."""
    try:
        return read_streamed(spark, path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
