"""Token ids as length-delimited binary records with a separate offset index.

A file is a run of frames: u64 length, u32 masked checksum of those eight bytes, payload,
u32 masked checksum of the payload (all little-endian; CRC-32, rotated and shifted by a
constant so that the checksum of data that holds checksums stays useful). A payload is one
document: id, whether the id is null, bytes per token id (2 or 4), the number of ids before
it in its part, its ids.

``write`` deals documents by id into parts, in ascending order, and returns the index: one
row per record with its file, offset and length. A reader that wants a shuffled epoch sorts
the index and seeks; ``read`` takes any rows of an index. Files get a new name on each
attempt and only the committed index names them, so a lost executor leaves no double record.

Defined cases: a null text is an empty document (only the end id); rows that repeat an id are
records of their own, in file order, a null id comes first; an empty table gives an empty index.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from triage.functions.scale import stage, stage_path
from triage.llm import common, tokens

FILE_BYTES = 256 << 20
_FRAME = struct.Struct("<QI")
_CHECK = struct.Struct("<I")
_HEAD = struct.Struct("<qBBQ")
# Fixed values of the masking: rotate right by 15, then add.
_MASK = 0xA282EAD8

_INDEX = pa.schema([
    ("part", pa.int32()), ("file", pa.string()), ("doc_id", pa.int64()), ("offset", pa.int64()),
    ("length", pa.int64()), ("n_tokens", pa.int64()),
])
INDEX = "part int, file string, doc_id long, offset long, length long, n_tokens long"
_READ = pa.schema([
    ("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()),
    ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32())),
])
READ = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long, ids array<int>"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + _CHECK.pack(masked(length)) + payload + _CHECK.pack(masked(payload))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; raises if a length or checksum is wrong."""
    length, check = _FRAME.unpack_from(data)
    if masked(data[:8]) != check or len(data) != _FRAME.size + length + _CHECK.size:
        raise ValueError("bad record length")
    payload = data[_FRAME.size : -_CHECK.size]
    if masked(payload) != _CHECK.unpack(data[-_CHECK.size :])[0]:
        raise ValueError("bad record checksum")
    return payload


def pack(doc_id: int | None, ids: np.ndarray, before: int) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    head = _HEAD.pack(doc_id or 0, doc_id is None, width, before)
    return head + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, int, np.ndarray]:
    doc_id, null, width, before = _HEAD.unpack_from(payload)
    return (None if null else doc_id), before, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size)


def write(docs: DataFrame, vocabulary: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every document's ids in ascending id order; returns the offset index (a staged table)."""
    spark = docs.sparkSession
    folder = stage_path(spark, "records")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        encoder = tokens.encoder(vocabulary)
        end = np.array([tokens.END_ID], dtype="<u4").tobytes()
        out, name, offset, before = None, "", 0, 0
        try:
            for batch in batches:
                held = []
                ids_of = encoder.encode_all(t for t, in common.rows([batch], "text"))
                for (doc_id,), raw in zip(common.rows([batch], "doc_id"), ids_of, strict=True):
                    ids = np.frombuffer(raw + end, dtype="<u4")
                    data = frame(pack(doc_id, ids, before))
                    if out is None or offset + len(data) > file_bytes and offset:
                        if out is not None:
                            out.close()
                        name = f"{folder}/part-{number:06d}-{uuid.uuid4().hex}.records"
                        out, offset = common.open_out(name), 0
                    out.write(data)
                    held.append((number, name, doc_id, offset, len(data), len(ids)))
                    offset += len(data)
                    before += len(ids)
                if held:
                    yield common.to_batch(held, _INDEX)
        finally:
            if out is not None:
                out.close()

    ordered = (
        common.texts(docs)
        .withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
    )
    return stage(ordered.select("doc_id", "text").mapInArrow(part, INDEX), "records-index")


def read(index: DataFrame, with_ids: bool = True) -> DataFrame:
    """The records that the rows of an index name, checked: READ's columns, in the order of the rows."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name = None, None
        try:
            for batch in batches:
                held, size = [], 0
                for part, path, offset, length in common.rows([batch], "part", "file", "offset", "length"):
                    if path != name:
                        if file is not None:
                            file.close()
                        file, name = common.open_in(path), path
                    file.seek(offset)
                    doc_id, before, ids = unpack(unframe(file.read(length)))
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    held.append((doc_id, part, before, len(ids), crc, ids.astype(np.int32) if with_ids else None))
                    size += length
                    if size > 8 << 20:
                        yield common.to_batch(held, _READ)
                        held, size = [], 0
                if held:
                    yield common.to_batch(held, _READ)
        finally:
            if file is not None:
                file.close()

    return index.select("part", "file", "offset", "length").mapInArrow(load, READ)


def with_start(records: DataFrame, index: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before each record. One row per part is broadcast."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = (
        index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
        .select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        records.join(F.broadcast(parts), F.col("part") == F.col("_part"))
        .withColumn("start", F.col("_before") + F.col("start_in_part"))
        .drop("_part", "_before")
    )
