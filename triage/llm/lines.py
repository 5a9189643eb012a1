"""Line deduplication by a sharded minimal perfect hash.

1. Every document reports the distinct keys of its lines as 128-bit hashes; Spark adds up in
   how many documents each occurs (partial sums per batch of documents come first, so that a
   line of every document costs one row per batch).
2. The hashes of lines found often enough are dealt into shards of bounded size. A shard gets
   a minimal perfect hash (levels of bit arrays: a key that is alone at its place of a level
   rests there, the others go on to the next level; the rank of its bit is its number), and
   under that number a 64-bit fingerprint and the count. One file per shard.
3. Documents probe these arrays; lines themselves are never joined or shuffled. A worker holds
   at most ``INDEX_BYTES`` of shards and loads others when a block of documents asks for them,
   so memory is bounded whatever the number of frequent lines.

Defined cases: a null text is one empty line; a line without characters beside white space has
no key and always stays; each row is a document of its own, also if it repeats an id; other
columns are handed through.
"""

from __future__ import annotations

import struct
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.functions.scale import stage, stage_path
from triage.llm import common

SPACE = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 18
INDEX_BYTES = 128 << 20
_BLOCK_CHARS = 16 << 20
_PARTIAL_KEYS = 300_000
_GAMMA = 2  # places per key and level

_COUNTS = pa.schema([("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64())])


def key(line: bytes) -> bytes:
    return line.strip(SPACE).translate(common.ASCII_LOWER)


def _long_enough(k: bytes, min_chars: int) -> bool:
    if min_chars <= 1 or len(k) < min_chars:
        return len(k) >= min_chars
    return len(k.decode("utf-8", "replace")) >= min_chars


# --- the minimal perfect hash of one shard -----------------------------------------


def _place(lo: np.ndarray, hi: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place below ``size`` for each 128-bit key, another one at each level."""
    x = lo ^ (hi * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers 0..n-1 for n distinct 128-bit keys; any number or -1 for other keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits
        self.sizes = [len(bits) * 8 for bits in levels]
        self.ranks, total = [], 0
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())

    @classmethod
    def build(cls, lo: np.ndarray, hi: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(lo):
            size = -(-max(64, _GAMMA * len(lo)) // 64) * 64
            at = _place(lo, hi, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = ~alone[at]
            lo, hi = lo[left], hi[left]
        return cls(levels)

    def number(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.full(len(lo), -1, dtype=np.int64)
        todo = np.arange(len(lo))
        for level, (bits, size, ranks) in enumerate(zip(self.levels, self.sizes, self.ranks, strict=True)):
            at = _place(lo[todo], hi[todo], level, size)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            held = bits[byte]
            hit = (held >> bit) & 1 == 1
            below = np.bitwise_count(held & ((np.uint8(1) << bit) - np.uint8(1)).astype(np.uint8))
            out[todo[hit]] = ranks[byte[hit]] + below[hit]
            todo = todo[~hit]
        return out


class Shard:
    """Perfect hash, fingerprints and counts of the frequent lines of one shard."""

    def __init__(self, function: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.function, self.prints, self.counts = function, prints, counts
        self.nbytes = prints.nbytes + counts.nbytes + sum(9 * len(x) for x in function.levels)

    @classmethod
    def build(cls, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> Shard:
        function = PerfectHash.build(lo, hi)
        at = function.number(lo, hi)
        prints, counts = np.empty(len(lo), np.uint64), np.empty(len(lo), np.uint32)
        prints[at], counts[at] = hi, np.minimum(n, 0xFFFFFFFF)
        return cls(function, prints, counts)

    def count(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """In how many documents each key was found; 0 for a key that is not in the shard."""
        at = self.function.number(lo, hi)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == hi[ok]
        out = np.zeros(len(lo), dtype=np.int64)
        out[ok] = self.counts[at[ok]]
        return out

    def dump(self) -> bytes:
        levels = self.function.levels
        head = struct.pack("<QQ", len(self.prints), len(levels))
        head += struct.pack(f"<{len(levels)}Q", *(len(x) for x in levels))
        return b"".join([head, *(x.tobytes() for x in levels), self.prints.tobytes(), self.counts.tobytes()])

    @classmethod
    def load(cls, data: bytes) -> Shard:
        n, n_levels = struct.unpack_from("<QQ", data)
        sizes = struct.unpack_from(f"<{n_levels}Q", data, 16)
        at, levels = 16 + 8 * n_levels, []
        for size in sizes:
            levels.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        prints = np.frombuffer(data, np.uint64, n, at)
        return cls(PerfectHash(levels), prints, np.frombuffer(data, np.uint32, n, at + 8 * n))


class Index:
    """The shards' files, of which a bounded part is held in memory."""

    def __init__(self, files: list[str | None], held_bytes: int = INDEX_BYTES):
        self.files, self.held_bytes = files, held_bytes
        self.held: OrderedDict[int, Shard] = OrderedDict()

    def _shard(self, number: int) -> Shard:
        if number not in self.held:
            with common.open_in(self.files[number]) as f:
                self.held[number] = Shard.load(f.read())
            while len(self.held) > 1 and sum(s.nbytes for s in self.held.values()) > self.held_bytes:
                self.held.popitem(last=False)
        self.held.move_to_end(number)
        return self.held[number]

    def count(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lo), dtype=np.int64)
        if not self.files:
            return out
        shard = hi.view(np.int64) % len(self.files)
        order = np.argsort(shard, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(rows) and self.files[shard[rows[0]]] is not None:
                out[rows] = self._shard(int(shard[rows[0]])).count(lo[rows], hi[rows])
        return out


# --- the Spark side ----------------------------------------------------------------


def line_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(lo, hi, n): in how many documents each key occurs, keys as 128-bit hashes."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for text, in common.rows(batches, "text"):
            keys = {key(x) for x in (text or "").encode().split(b"\n")}
            found.update([xxhash.xxh3_128_digest(k) for k in keys if k and _long_enough(k, min_chars)])
            if len(found) > _PARTIAL_KEYS:
                yield from _flush(found)
                found = Counter()
        yield from _flush(found)

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(partial, "lo long, hi long, n long")
    return counts.groupBy("lo", "hi").agg(F.sum("n").alias("n"))


def _flush(found: Counter[bytes]) -> Iterator[pa.RecordBatch]:
    words = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
    n = np.fromiter(found.values(), dtype=np.int64, count=len(found))
    for at in range(0, len(n), 50_000):
        part = slice(at, at + 50_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(words[part, 0])), pa.array(np.ascontiguousarray(words[part, 1])),
             pa.array(n[part])], schema=_COUNTS,
        )


def build_index(counts: DataFrame, shard_keys: int = SHARD_KEYS) -> list[str | None]:
    """Write one file per shard of (lo, hi, n) rows; the files by shard number."""
    spark = counts.sparkSession
    counts = stage(counts, "line-counts")
    shards = -(-counts.count() // shard_keys)
    if not shards:
        return []
    folder = stage_path(spark, "line-index")

    def build(group: pa.Table) -> pa.Table:
        lo, hi, n = (group.column(c).to_numpy() for c in ("lo", "hi", "n"))
        lo, hi = lo.astype(np.uint64), hi.astype(np.uint64)
        number = group.column("shard")[0].as_py()
        name = f"{folder}/shard-{number:06d}-{uuid.uuid4().hex}.index"
        with common.open_out(name) as f:
            f.write(Shard.build(lo, hi, n).dump())
        return pa.table({"shard": pa.array([number], pa.int64()), "file": pa.array([name], pa.string())})

    shard = F.pmod(F.col("hi"), F.lit(shards)).cast("long")
    files: list[str | None] = [None] * shards
    # one row per shard comes back
    made = counts.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard long, file string")
    for row in made.toLocalIterator():
        files[row["shard"]] = row["file"]
    return files


def drop_frequent(
    docs: DataFrame, files: list[str | None], text_col: str = "text", min_docs: int = 10, min_chars: int = 1,
    report: str | None = None,
) -> DataFrame:
    """``docs`` without the lines the index has found in ``min_docs`` documents or more.

    ``report`` names a column to add: struct<n_lines: long, n_dropped: long>.
    """
    schema = T.StructType([
        T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema
    ])
    kind = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64())])
    if report:
        inner = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        schema = schema.add(report, inner)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(files)
        for batch in batches:
            for part in _blocks(batch, text_col):
                at = part.schema.get_field_index(text_col)
                kept, counted = _probe(part.column(at).to_pylist(), index, min_docs, min_chars)
                out = part.set_column(at, text_col, pa.array(kept, pa.string()))
                yield out.append_column(report, pa.array(counted, kind)) if report else out

    return docs.mapInArrow(probe, schema)


def _blocks(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded amount of text."""
    begin = size = 0
    column = batch.column(batch.schema.get_field_index(text_col))
    for i in range(batch.num_rows):
        size += len(column[i].as_buffer() or b"") if column[i].is_valid else 0
        if size > _BLOCK_CHARS:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _probe(texts: list[str | None], index: Index, min_docs: int, min_chars: int) -> tuple[list[str], list[dict]]:
    lines = [(t or "").encode().split(b"\n") for t in texts]
    places, digests, at = [], [], 0
    for own in lines:
        for line in own:
            k = key(line)
            if k and _long_enough(k, min_chars):
                places.append(at)
                digests.append(xxhash.xxh3_128_digest(k))
            at += 1
    words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    drop = np.zeros(at, dtype=bool)
    if places:
        counts = index.count(np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1]))
        drop[np.array(places)] = counts >= min_docs
    kept, counted, at = [], [], 0
    for own in lines:
        out = drop[at : at + len(own)].tolist()
        at += len(own)
        n = sum(out)
        kept.append(b"\n".join([x for x, gone in zip(own, out, strict=True) if not gone] if n else own).decode())
        counted.append({"n_lines": len(own), "n_dropped": n})
    return kept, counted


def dedup(
    docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, report: str | None = None
) -> DataFrame:
    """Drop every line whose key occurs in at least ``min_docs`` documents, in all of them."""
    counts = line_counts(docs, text_col, min_chars).where(F.col("n") >= min_docs)
    return drop_frequent(docs, build_index(counts), text_col, min_docs, min_chars, report)
