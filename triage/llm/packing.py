"""Best-fit packing of token sequences under several capacities at once.

A piece asks for (tokens, one document, attention cost = its length squared) and a sequence
offers a capacity of each. The longest pieces go first; each takes the open sequence that has
room in every dimension and scores best: the smallest weighted norm of what would be left
(``rule="norm"``, the default) or the largest weighted dot product of what is left with what
is asked (``rule="dot"``).

Every demand follows from the length, so pieces of one length are alike. Spark counts the
pieces per length; the plan is made over these counts (at most ``capacity`` rows, whatever
the corpus) and handles all sequences with the same contents as one class with a count.
Pieces are then numbered per length and find sequence and offset through the plan's ranges.

Defined cases: a null text is an empty document and still has its end id; rows that repeat
an id are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from triage.functions.scale import stage
from triage.llm import common, tokens

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
    ("ids_crc32", pa.int64()),
])


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence and the weights of their residuals. The defaults for documents
    and attention cost are what 1024 tokens can reach at most; give less to bind them."""

    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    rule: str = "norm"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first."""
    first = (n - 1) % capacity + 1 if n else 0
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Encode every document, end id included, and cut the ones longer than ``capacity``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        end = np.array([tokens.END_ID], dtype="<u4").tobytes()
        for batch in batches:
            held = []
            coded = encoder.encode_all(t for t, in common.rows([batch], "text"))
            for (doc_id,), raw in zip(common.rows([batch], "doc_id"), coded, strict=True):
                raw += end
                for number, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    held.append((doc_id, number, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
            if held:
                yield common.to_batch(held, _PIECES)

    return common.texts(docs).mapInArrow(encode, PIECES)


def plan(counts: dict[int, int], limits: Limits = Limits()) -> list[tuple[tuple[int, ...], int]]:
    """Classes of sequences: (lengths in order, how many such sequences)."""
    cap = np.array([limits.tokens, limits.documents, limits.attention], dtype=float)
    weights = np.array(limits.weights)
    room = np.zeros((0, 3))
    contents: list[tuple[int, ...]] = []
    number: list[int] = []
    spare: list[int] = []  # places of classes that are used up
    known: dict[tuple[int, ...], int] = {}

    def put(lengths: tuple[int, ...], left: np.ndarray, n: int) -> None:
        nonlocal room
        at = known.get(lengths)
        if at is not None and number[at]:
            number[at] += n
            return
        if not spare:
            grown = max(64, 2 * len(room))
            spare.extend(range(grown - 1, len(room) - 1, -1))
            room = np.vstack([room, np.full((grown - len(room), 3), -1.0)])
            contents.extend([()] * (grown - len(contents)))
            number.extend([0] * (grown - len(number)))
        at = spare.pop()
        room[at], contents[at], number[at], known[lengths] = left, lengths, n, at

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        ask = np.array([length, 1, length * length], dtype=float)
        if (ask > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        alone = int((cap // ask).min())
        while todo:
            fits = (room >= ask).all(axis=1)
            if not fits.any():
                # nothing open has room: new sequences, filled with this length as far as it goes
                n = max(1, todo // alone)
                many = min(alone, todo)
                put((length,) * many, cap - many * ask, n)
                todo -= n * many
                continue
            places = np.flatnonzero(fits)
            left = (room[places] - ask) / cap
            if limits.rule == "norm":
                best = places[np.argmin((weights * left**2).sum(axis=1))]
            else:
                best = places[np.argmax((weights * (room[places] / cap) * (ask / cap)).sum(axis=1))]
            n = min(todo, number[best])
            lengths, rest = (*contents[best], length), room[best] - ask
            number[best] -= n
            if not number[best]:
                known.pop(contents[best], None)
                room[best] = -1
                spare.append(int(best))
            put(lengths, rest, n)
            todo -= n
    return sorted((c, n) for c, n in zip(contents, number, strict=True) if n)


def slots(spark: SparkSession, classes: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """For each length, which numbers go where: numbers low..high-1 to sequences first, first+1, ..."""
    given: dict[int, int] = {}
    rows, first = [], 0
    for lengths, n in classes:
        offset = 0
        for length in lengths:
            low = given.get(length, 0)
            given[length] = low + n
            rows.append((length, low, low + n, first, offset))
            offset += length
        first += n
    return spark.createDataFrame(rows, "length int, low long, high long, first long, offset long")


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "_number") -> DataFrame:
    """Number the rows of each key from 0. A frequent key spans several ranges; one row per range
    and key, at most the number of ranges plus the number of keys, carries the count on."""
    seg = stage(
        rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
        .withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()),
        "numbered",
    )
    counts = seg.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_p")).agg(
        F.count("*").alias("_n"), F.min("_row").alias("_first")
    )
    before = W.partitionBy("_key").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    carry = counts.select(
        "_key", "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        seg.join(F.broadcast(carry), (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_p")))
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_key", "_p", "_part", "_row", "_shift")
    )


def pack(items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Place pieces (doc_id, piece, length, ...): adds sequence_id and offset."""
    spark = items.sparkSession
    items = stage(items, "pieces")
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().toLocalIterator()}
    places = slots(spark, plan(counts, limits)).withColumnRenamed("length", "_length")
    # the plan has a row per class and place, far below the number of sequences: its size
    # follows the number of lengths, not of pieces
    ranked = numbered(items, "length", ["doc_id", "piece"])
    here = (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("low")) & (F.col("_number") < F.col("high"))
    return (
        ranked.join(F.broadcast(places), here)
        .withColumn("sequence_id", F.col("first") + F.col("_number") - F.col("low"))
        .drop("_length", "_number", "low", "high", "first")
    )
