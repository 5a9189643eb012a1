"""Web archives as seekable Zstandard bundles.

Records follow WARC 1.1. A bundle holds groups of records in independent Zstandard frames and
ends with a seek table in a skippable frame (the published seekable format), so any
Zstandard reader can unpack it whole and a reader with the index can unpack one frame. The
index maps each record to its bundle, frame, and place inside the unpacked frame.

Records with the same payload of at least ``min_bytes`` bytes are stored once: the one with the
largest id as ``response``, the others as ``revisit`` that refer to it.

Defined cases: a null payload is an empty one; a null address is left out of the record; rows
that repeat the largest id are all responses; a null id is smaller than any other, and if all
ids of a group are null all are responses; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.functions.scale import stage, stage_path
from triage.llm import common

FRAME_BYTES = 512 << 10
BUNDLE_BYTES = 256 << 20
MIN_BYTES = 1000
LEVEL = 3
# Fixed values of the seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, bundle string, frame int, offset long, length long"
_INDEX = pa.schema([
    ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()),
    ("length", pa.int64()),
])
READ = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary"
)
_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


# --- one record --------------------------------------------------------------------


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def _safe(url: str) -> str:
    """An address on one header line: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}", *([f"WARC-Target-URI: {_safe(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")[1:]
    return {name.lower(): value for name, _, value in (x.partition(": ") for x in lines)}


def parse(data: bytes) -> tuple:
    """READ's columns of one record; raises if lengths or the digest do not agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    body = rest[: int(warc["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n" or len(body) != int(warc["content-length"]):
        raise ValueError("bad record length")
    http, _, payload = body.partition(b"\r\n\r\n")
    n = int(_headers(http)["content-length"])
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    kind, refers = warc["warc-type"], warc.get("warc-refers-to")
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload does not match its digest")
    return (
        _id(warc["warc-record-id"]), warc.get("warc-target-uri"), kind, n, digest,
        _id(refers) if refers else None, payload if kind == "response" else None,
    )


# --- one bundle --------------------------------------------------------------------


class BundleWriter:
    """Frames into a stream, the seek table at the end."""

    def __init__(self, stream, level: int = LEVEL):
        import zstandard

        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.size = 0

    def add(self, data: bytes) -> int:
        """Write one frame; returns its number."""
        packed = self.packer.compress(data)
        self.stream.write(packed)
        self.frames.append((len(packed), len(data)))
        self.size += len(packed)
        return len(self.frames) - 1

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *x) for x in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.stream.close()


class BundleReader:
    def __init__(self, file):
        import zstandard

        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", file.read(8 * n)):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self.file.seek(at)
        return self.unpacker.decompress(self.file.read(packed), max_output_size=plain)


# --- the Spark side ----------------------------------------------------------------


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) for (page_id, url, html).

    Only payloads that occur more than once are joined back, by digest and length; Spark
    splits a digest that many pages share.
    """
    full = pages.withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary")).drop("html")
    full = full.withColumn("digest", F.sha1("payload"))
    same = (
        full.where(F.octet_length("payload") >= min_bytes)
        .groupBy(F.col("digest").alias("_digest"), F.octet_length("payload").alias("_bytes"))
        .agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_copies"))
        .where("_copies > 1")
    )
    on = (F.col("digest") == F.col("_digest")) & (F.octet_length("payload") == F.col("_bytes"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_keeper")), F.col("_keeper"))
    return full.join(same, on, "left").withColumn("refers_to", refers).drop("_digest", "_bytes", "_keeper", "_copies")


def write(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = MIN_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write bundles into the shared folder; returns the index (a staged table).

    Bundles get a new name on each attempt and only the committed index names them.
    """
    spark = pages.sparkSession
    folder = stage_path(spark, "warc")
    plain = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name = None, ""
        held: list[tuple] = []  # (page_id, offset, length) of the open frame
        data: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, name, held, data, size
            if out is None:
                name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                out = BundleWriter(common.open_out(name))
            number = out.add(b"".join(data))
            rows = [(p, name, number, o, n) for p, o, n in held]
            held, data, size = [], [], 0
            if out.size >= bundle_bytes:
                out.close()
                out = None
            return common.to_batch(rows, _INDEX)

        for page_id, url, payload, digest, refers in common.rows(batches, "page_id", "url", "payload", "digest", "refers_to"):
            one = record(page_id, url, payload, digest, refers, date)
            held.append((page_id, size, len(one)))
            data.append(one)
            size += len(one)
            if size >= frame_bytes:
                yield flush()
        if held:
            yield flush()
        if out is not None:
            out.close()

    return stage(decide(plain, min_bytes).mapInArrow(bundle, INDEX), "warc-index")


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of an index name, unpacked frame by frame and checked."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name, number, frame = None, None, -1, b""
        held, size = [], 0
        for bundle, want, offset, length in common.rows(batches, "bundle", "frame", "offset", "length"):
            if bundle != name:
                if reader is not None:
                    reader.file.close()
                reader, name, number = BundleReader(common.open_in(bundle)), bundle, -1
            if want != number:
                frame, number = reader.frame(want), want
            row = parse(frame[offset : offset + length])
            held.append(row if with_payload else (*row[:-1], None))
            size += length
            if size > 8 << 20:
                yield common.to_batch(held, _READ)
                held, size = [], 0
        if held:
            yield common.to_batch(held, _READ)
        if reader is not None:
            reader.file.close()

    return index.select("bundle", "frame", "offset", "length").mapInArrow(load, READ)
