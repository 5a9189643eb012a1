"""Helpers shared by the operators: normalised inputs, files in the shared folder, batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.functions.workers import ship  # noqa: F401  (used by the queries and the pipeline)

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) under fixed names; a null text is an empty one, other columns go."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def py_fold(doc_id: int | None, modulus: int) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a bounded slice at a time."""
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for at in range(0, batch.num_rows, 512):
            yield from zip(*[c.slice(at, 512).to_pylist() for c in columns], strict=True)


def emit(rows_: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows_:
        held.append(row)
        if len(held) >= size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _located(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return pafs.FileSystem.from_uri(uri)


def open_out(uri: str):
    """A new binary file in the shared folder; works for every store that pyarrow knows."""
    store, path = _located(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)  # else the name would decide


def open_in(uri: str):
    store, path = _located(uri)
    return store.open_input_file(path)


# Stores of a worker process by the module that fills them, and the module that used its own last.
_stores: dict[str, list] = {}
_using = [""]


def worker_store(fn: Callable) -> Callable:
    """One result of ``fn`` kept per worker, until an operator of another module needs a store: the
    stages of a pipeline share the workers, and what one has loaded should not outlive it."""
    kept = lru_cache(maxsize=1)(fn)
    _stores.setdefault(fn.__module__, []).append(kept)

    @wraps(fn)
    def get(*args):
        if _using[0] != fn.__module__:
            for module, stores in _stores.items():
                if module != fn.__module__:
                    for store in stores:
                        store.cache_clear()
            _using[0] = fn.__module__
        return kept(*args)

    return get
