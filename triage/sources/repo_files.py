"""Read repository snapshots laid out as ``<root>/<repo>/<commit>/<path>``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.functions.scale import stage, unstage


def scan_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """``repo, commit_sha, path, length, content`` of all files, or of those up to ``max_bytes``.

    The size test is pushed into the scan, so an oversized file is never read,
    and a query that does not use ``content`` reads no bytes at all.
    """
    tail = F.regexp_extract(F.col("path"), r"^(?:[a-z0-9]+:)?/*(.*)$", 1)
    base = root.rstrip("/").split(":", 1)[-1].strip("/")
    relative = F.substr(tail, F.lit(len(base) + 2))
    parts = F.split(relative, "/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_bytes is not None:
        found = found.where(F.col("length") <= max_bytes)
    return found.select(
        parts[0].alias("repo"),
        parts[1].alias("commit_sha"),
        F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "/").alias("path"),
        "length",
        "content",
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``folder, name, length`` of all files below ``root``, listed by tasks, a level of folders at a time.

    Every folder is a row, so folders spread over tasks and no list of names is ever on the driver.
    ``root`` is in a store that pyarrow reaches (local, shared, object stores); for others ``scan_files``.
    """
    tools = _tools()
    folders, found = spark.createDataFrame([(root.rstrip("/"),)], "folder string"), None
    while True:
        spread = folders.repartition("folder")
        level = stage(spread.mapInArrow(tools["list"], "folder string, name string, length long"), "listing")
        files = level.where("length is not null")
        found = files if found is None else found.unionByName(files)
        folders = level.where("length is null").select(F.concat_ws("/", "folder", "name").alias("folder"))
        if folders.isEmpty():
            return found


def scan_listed(spark: SparkSession, root: str, max_bytes: int | None = None, task_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``scan_files``, without a listing on the driver. Files are dealt evenly by size."""
    listed = list_files(spark, root)
    if max_bytes is not None:
        listed = listed.where(F.col("length") <= max_bytes)
    total = listed.agg(F.sum(F.col("length") + 4096)).first()[0] or 0
    dealt = listed.repartition(int(total // task_bytes) + 1, F.xxhash64("folder", "name"))
    read = dealt.mapInArrow(_tools()["read"], "folder string, name string, length long, content binary")
    inside = F.substr(F.concat_ws("/", "folder", "name"), F.lit(len(root.rstrip("/")) + 2))
    parts = F.split(inside, "/")
    return read.where(F.size(parts) > 2).select(
        parts[0].alias("repo"), parts[1].alias("commit_sha"),
        F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "/").alias("path"), "length", "content",
    )


def write_files(files: DataFrame, root: str) -> int:
    """Write ``repo, commit_sha, path, content`` as files below ``root``, by tasks; returns their number."""
    named = files.select(F.concat_ws("/", F.lit(root.rstrip("/")), "repo", "commit_sha", "path").alias("file"), "content")
    done = stage(named.mapInArrow(_tools()["write"], "files long"), "written-files")
    count = done.agg(F.sum("files")).first()[0] or 0
    unstage(done)
    return count


def _tools() -> dict[str, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """The functions that run in tasks, built here so that tasks need no import of this package."""

    def located(uri: str):
        import re

        from pyarrow import fs

        parts = re.match(r"([A-Za-z0-9]+):(?://([^/]*))?(/.*)?$", uri, re.S)
        if parts is None:
            return fs.LocalFileSystem(), uri
        # names are no URIs: only the store is looked up as one
        store, base = fs.FileSystem.from_uri(f"{parts[1]}://{parts[2] or ''}/")
        return store, base.rstrip("/") + (parts[3] or "")

    def list_folders(batches):
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                store, path = located(folder)
                infos = sorted(store.get_file_info(fs.FileSelector(path)), key=lambda i: i.base_name)
                for at in range(0, len(infos), 10_000):
                    part = infos[at : at + 10_000]
                    lengths = [i.size if i.type == fs.FileType.File else None for i in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([folder] * len(part)), pa.array([i.base_name for i in part]), pa.array(lengths, pa.int64())],
                        names=["folder", "name", "length"],
                    )

    def read_files(batches):
        for batch in batches:
            rows, held, size = [], [], 0
            for folder, name, length in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                store, path = located(f"{folder}/{name}")
                with store.open_input_stream(path, compression=None) as f:
                    held.append(f.read())
                rows.append((folder, name, length))
                size += length
                if size > 16 << 20:
                    yield packed(rows, held)
                    rows, held, size = [], [], 0
            if rows:
                yield packed(rows, held)

    def packed(rows, held):
        folders, names, lengths = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(folders), pa.array(names), pa.array(lengths, pa.int64()), pa.array(held, pa.binary())],
            names=["folder", "name", "length", "content"],
        )

    def write(batches):
        n = 0
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                store, path = located(file)
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path, compression=None) as f:
                    f.write(content.encode() if isinstance(content, str) else content or b"")
                n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return {"list": list_folders, "read": read_files, "write": write}


def decode(files: DataFrame) -> DataFrame:
    """Binary ``content`` to text; invalid bytes are replaced."""
    return files.withColumn("content", F.decode("content", "UTF-8"))
