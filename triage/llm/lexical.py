"""Ranked lexical search in norm buckets, in the manner of LEMP, with exact integer scores.

A document is a vector of impacts, one for each term of any item that it holds; an item is a
vector of weighted counts, and a score is an inner product. Terms that no item holds add
nothing, so they only count for a document's length.

Documents are dealt by the length (norm) of their vectors, longest first, ties by id, so that
copies in any number spread over tasks. A task cuts its range into buckets. For an item and its
threshold, the k-th best score known so far:

1. Cauchy-Schwarz: a bucket whose longest vector times the item's length stays below the
   threshold ends the search in this range, as all others are shorter.
2. Coordinate bounds: terms are ordered by the most they can add in the bucket. A document that
   holds none of the first ones cannot reach the threshold if the rest cannot; the others are
   followed term by term and leave as soon as what is missing cannot lift them to it.
3. What survives has been scored in 64-bit integers, and the best k are kept.

Bounds are floating point with a margin, so they only ever let too much through. Thresholds come
from one range first (that of the longest vectors) and go along to all others, in files of a
bounded number of items; so does the vocabulary. More items than one block holds make more
passes over the vectors, never a larger block.

Defined cases: a null text has no terms; items without terms, or whose terms no document holds,
have no rows; documents without terms are not counted in N; rows that repeat an id are documents
(or items) of their own; a null id ranks behind others and stays null; empty tables give no rows.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from triage.functions.scale import stage, stage_path, unstage
from triage.llm import common

K = 10
BUCKET = 4096
# Term places of items in one block: what a task holds of them is some tens of bytes for each.
BLOCK_TERMS = 1_000_000
FIRST = 65_536  # vectors of the first range, which gives the thresholds
_SAFE = 1 + 1e-9

# Bytes to what terms are made of: 0-9, A-Z as a-z, a-z, everything outside ASCII; the rest parts them.
TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

VECTORS = "row long, doc_id long, n long, terms array<int>, counts array<int>"
_VECTORS = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
    ("counts", pa.list_(pa.int32())),
])
FOUND = "item long, row long, doc_id long, score long"
_FOUND = pa.schema([("item", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def _read(uri: str) -> dict:
    with common.open_in(uri) as f:
        return json.loads(f.read())


def _save(folder: str, held: dict) -> str:
    name = f"{folder}/{uuid.uuid4().hex}.json"
    with common.open_out(name) as f:
        f.write(json.dumps(held).encode())
    return name


def item_blocks(items: DataFrame, block_terms: int) -> list[str]:
    """Files of (item row, terms with counts), each of a bounded number of terms or one item; written by tasks."""
    folder = stage_path(items.sparkSession, "lexical-items")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for item, text in common.rows(batches, "item", "text"):
            counted = Counter(terms(text))
            if held and size + len(counted) > block_terms:
                yield pa.RecordBatch.from_pydict({"file": [_save(folder, {"items": held})]})
                held, size = [], 0
            if counted:
                held.append((item, {t.decode("utf-8", "surrogatepass"): n for t, n in counted.items()}))
                size += len(counted)
        if held:
            yield pa.RecordBatch.from_pydict({"file": [_save(folder, {"items": held})]})

    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    made = items.repartition(int(total // (8 * block_terms)) + 1).mapInArrow(write, "file string")
    return sorted(r["file"] for r in made.collect())


class Items:
    """The items of one block; a term's number is its place in ``vocabulary``."""

    def __init__(self, held: dict):
        self.rows = [item for item, _ in held["items"]]
        self.vocabulary: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        for _, counted in held["items"]:
            own = [self.vocabulary.setdefault(t.encode("utf-8", "surrogatepass"), len(self.vocabulary)) for t in counted]
            self.terms.append(np.array(own, dtype=np.int64))
            self.counts.append(np.array(list(counted.values()), dtype=np.int64))


@common.worker_store
def _items(file: str) -> Items:
    return Items(_read(file))


def vectors(docs: DataFrame, file: str) -> DataFrame:
    """(row, doc_id, n, terms, counts) of each document with a term, over the terms of a block's items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _items(file).vocabulary.get

        def made() -> Iterator[tuple]:
            for row, doc_id, text in common.rows(batches, "row", "doc_id", "text"):
                own = terms(text)
                if own:
                    counted = Counter(map(get, own))
                    counted.pop(None, None)
                    yield row, doc_id, len(own), list(counted), list(counted.values())

        yield from common.emit(made(), _VECTORS)

    return docs.select("row", "doc_id", "text").mapInArrow(count, VECTORS)


def impact(tf, n, docs: int, length: int):
    """What one count of a term adds to a score for each unit of the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))


class Search:
    """One block's items with the weights of their terms, and the best documents so far."""

    def __init__(self, items: Items, weights: np.ndarray, k: int, least: list[int]):
        self.items, self.k = items, k
        self.root = np.sqrt(weights.astype(float))
        self.queries = []
        for own, counts, floor in zip(items.terms, items.counts, least, strict=True):
            factor = counts * weights[own]
            keep = factor > 0
            length = float(np.sqrt((counts[keep] ** 2 * weights[own][keep].astype(float)).sum()))
            self.queries.append((own[keep], factor[keep], length))
        self.floor = list(least)
        self.best: list[list[tuple[int, bool, int, int]]] = [[] for _ in items.rows]  # (-score, null, id, row)
        self.done = [not len(own) for own, _, _ in self.queries]

    def bucket(self, rows: np.ndarray, ids: list[int | None], norms: np.ndarray, place: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Documents of falling norm; ``value`` is the impact of ``term`` in the document at ``place``."""
        order = np.argsort(term, kind="stable")  # places stay ascending inside a term
        term, place, value = term[order], place[order], value[order]
        used, begins = np.unique(term, return_index=True)
        ends = np.append(begins[1:], len(term))
        most = np.zeros(len(self.root), dtype=np.int64)
        low, high = np.zeros(len(most), dtype=np.int64), np.zeros(len(most), dtype=np.int64)
        if len(used):
            most[used], low[used], high[used] = np.maximum.reduceat(value, begins), begins, ends
        longest = float(norms[0]) if len(norms) else 0.0
        scores = np.zeros(len(rows), dtype=np.int64)
        for i, (own, factor, length) in enumerate(self.queries):
            if self.done[i]:
                continue
            floor = self.floor[i]
            if longest * length * _SAFE < floor:
                self.done[i] = True  # shorter vectors follow
                continue
            bound = factor * most[own]
            by = np.argsort(-bound, kind="stable")
            own_, factor_, bound = own[by], factor[by], bound[by]
            left = np.append(np.cumsum(bound[::-1])[::-1], 0)  # what the terms from here on can add
            if left[0] < max(floor, 1):
                continue
            # documents with one of the first terms; the later terms alone stay below the threshold
            first = int(np.searchsorted(-left, -max(floor, 1), "right"))
            scores[:] = 0
            for t, f in zip(own_[:first].tolist(), factor_[:first].tolist(), strict=True):
                scores[place[low[t] : high[t]]] += f * value[low[t] : high[t]]
            alive = np.flatnonzero((scores > 0) & (scores + left[first] >= floor))
            for n in range(first, len(own_)):
                if not len(alive):
                    break
                t = int(own_[n])
                a, b = int(low[t]), int(high[t])
                at = np.searchsorted(place[a:b], alive)
                hit = at < b - a
                hit[hit] = place[a:b][at[hit]] == alive[hit]
                scores[alive[hit]] += int(factor_[n]) * value[a:b][at[hit]]
                alive = alive[scores[alive] + left[n + 1] >= floor]
            if len(alive):
                self._keep(i, alive, scores[alive], rows, ids)

    def _keep(self, i: int, alive: np.ndarray, scores: np.ndarray, rows: np.ndarray, ids: list[int | None]) -> None:
        if len(alive) > self.k:  # the k best, and all that equal the last of them
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            alive, scores = alive[scores >= least], scores[scores >= least]
        new = [
            (-s, ids[a] is None, ids[a] or 0, int(rows[a])) for s, a in zip(scores.tolist(), alive.tolist(), strict=True)
        ]
        self.best[i] = sorted(self.best[i] + new)[: self.k]
        if len(self.best[i]) == self.k:
            self.floor[i] = max(self.floor[i], -self.best[i][-1][0])

    def rows(self) -> Iterator[tuple]:
        for item, own in zip(self.items.rows, self.best, strict=True):
            for score, null, doc_id, row in own:
                yield item, row, None if null else doc_id, -score


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()


def search(ranged: DataFrame, items_file: str, model_file: str, least_file: str | None, k: int) -> DataFrame:
    """The best k of each item in every partition of (row, doc_id, n, terms, counts, norm), longest norm first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, model = _items(items_file), _read(model_file)
        weights = np.array(model["weights"], dtype=np.int64)
        least = _read(least_file)["least"] if least_file else [1] * len(items.rows)
        found = Search(items, weights, k, least)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                part = batch.slice(at, BUCKET)
                sizes, own = _flat(part.column("terms"))
                _, counts = _flat(part.column("counts"))
                n = np.repeat(part.column("n").to_numpy(), sizes)
                value = impact(counts.astype(np.int64), n, model["docs"], model["length"])
                found.bucket(
                    part.column("row").to_numpy(), part.column("doc_id").to_pylist(), part.column("norm").to_numpy(),
                    np.repeat(np.arange(part.num_rows), sizes), own.astype(np.int64), value,
                )
        yield from common.emit(found.rows(), _FOUND)

    return ranged.mapInArrow(find, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(spark: SparkSession, docs: DataFrame, items_file: str, k: int, first: int) -> DataFrame:
    """(item, rank, doc_id, row, score) of one block's items."""
    folder = stage_path(spark, "lexical-model")
    held = stage(vectors(docs, items_file), "lexical-vectors")
    total = held.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    n_docs, length = total["docs"], total["length"] or 1
    in_docs = {
        r["term"]: r["df"]
        for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator()
    }  # one row for each term of the block's items
    size = len(_items(items_file).vocabulary)
    weights = [
        int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * in_docs[t] + 1)))) if t in in_docs else 0 for t in range(size)
    ]
    model_file = _save(folder, {"weights": weights, "docs": n_docs, "length": length})

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _read(model_file)
        root = np.sqrt(np.array(model["weights"], dtype=float))
        for batch in batches:
            sizes, own = _flat(batch.column("terms"))
            _, counts = _flat(batch.column("counts"))
            n = np.repeat(batch.column("n").to_numpy(), sizes)
            squares = (root[own] * impact(counts.astype(np.int64), n, n_docs, length)) ** 2
            at = np.repeat(np.arange(batch.num_rows), sizes)
            norm = np.sqrt(np.bincount(at, weights=squares, minlength=batch.num_rows))
            yield batch.append_column("norm", pa.array(norm, pa.float64()))

    order = [F.col("norm").desc(), F.col("doc_id"), F.col("row")]
    # the range of the longest vectors is a partition, or the first few, of a staged order
    ranged = stage(
        held.where(F.size("terms") > 0).mapInArrow(norms, VECTORS + ", norm double")
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()),
        "lexical-ranges",
    )
    sizes = ranged.groupBy("part").count().orderBy("part").collect()
    front, taken = 0, 0
    for r in sizes:
        if taken and taken + r["count"] > first:
            break
        front, taken = r["part"], taken + r["count"]
    columns = [c for c in ranged.columns if c != "part"]
    head = stage(
        _ranked(search(ranged.where(F.col("part") <= front).sortWithinPartitions(*order).select(*columns), items_file, model_file, None, k), k),
        "lexical-head",
    )
    places = {item: i for i, item in enumerate(_items(items_file).rows)}
    least = [1] * len(places)
    for r in head.where(F.col("rank") == k).toLocalIterator():
        least[places[r["item"]]] = r["score"]
    least_file = _save(folder, {"least": least})
    rest = search(
        ranged.where(F.col("part") > front).sortWithinPartitions(*order).select(*columns), items_file, model_file, least_file, k
    )
    out = stage(_ranked(head.drop("rank").unionByName(rest), k), "lexical-found")
    for used in (held, ranged, head):
        unstage(used)
    return out


def top_documents(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", k: int = K, block_terms: int = BLOCK_TERMS, first: int = FIRST,
) -> DataFrame:
    """(item id, rank, document id, score): the k best documents of every item."""
    spark = docs.sparkSession
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )
    # rows of items are told apart by a number that stays: it is written first
    own = stage(
        items.select(
            F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text).alias("text")
        ),
        "lexical-numbered",
    )
    files = item_blocks(own.select("item", "text"), block_terms)
    found = spark.createDataFrame([], "item long, row long, doc_id long, score long, rank int")
    for file in files:
        found = found.unionByName(_search_block(spark, numbered, file, k, first).select(*found.columns))
    return found.join(own.select("item", "item_id"), "item").select(
        "item", F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score"
    )
