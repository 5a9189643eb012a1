"""Benchmark decontamination by greedy string tiling.

Words are compared (letters, digits and bytes outside ASCII; A-Z lower-cased, punctuation
apart), so that another layout of a passage makes no difference. A document is compared with
an item only if both hold the same run of ``run`` words (a seed). Then tiles are marked:
running Karp-Rabin hashes give the runs of unmarked words that both sides share, the longest
is marked on both sides, and again, until no shared unmarked run of ``run`` words is left.
Each word of an item is covered once, in whatever order its passages stand in the document.
A document is contaminated by an item if its tiles cover at least ``coverage`` of the item's
words. An item shorter than ``run`` words must occur whole.

Items go to the tasks in blocks of bounded size, of which a worker holds one at a time, so a
benchmark of any size is compared whole. Documents are not shuffled.

Defined cases: a null or empty text is never contaminated; an item without words contaminates
nothing; a repeated item id counts as items of their own and the best one is returned; a null
item id is an id like others; each row of documents is compared on its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.functions.scale import stage_path
from triage.llm import common
from triage.llm.toxicity import WORDS

RUN = 5
COVERAGE = 0.5
BLOCK_CHARS = 16 << 20
_PAIRS = 1_000_000
_PILE = 64 << 20  # bytes of documents compared with a block at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)

HITS = "array<struct<item_id: long, coverage: double, n_tiles: int, n_words: int>>"
_HITS = pa.list_(pa.struct([
    ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("n_words", pa.int32()),
]))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``n`` numbers, modulo 2**64."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    mixed ^= mixed >> np.uint64(29)
    for k in range(n):
        out = out * _BASE + mixed[k : k + len(out)]
    return out


def shared_runs(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, run: int) -> np.ndarray:
    """Maximal shared runs of unmarked words: rows (length, place in item, place in document)."""

    def open_runs(ids: np.ndarray, free: np.ndarray) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(taken[run:] == taken[:-run]) if len(ids) >= run else np.zeros(0, np.int64)

    at_item, at_doc = open_runs(item, free_item), open_runs(doc, free_doc)
    hash_item, hash_doc = rolling(item, run)[at_item], rolling(doc, run)[at_doc]
    order = np.argsort(hash_item, kind="stable")
    low = np.searchsorted(hash_item[order], hash_doc, "left")
    n = np.searchsorted(hash_item[order], hash_doc, "right") - low
    found = [np.zeros((0, 3), dtype=np.int64)]
    # seeds that repeat many times make many pairs: a bounded number of them at a time
    piles = np.cumsum(n) // _PAIRS
    for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(piles)) + 1):
        d = np.repeat(at_doc[part], n[part])
        if not len(d):
            continue
        inner = np.arange(len(d)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        i = at_item[order][inner + np.repeat(low[part], n[part])]
        # only where a shared run begins: the words before differ or are marked
        before = (i > 0) & (d > 0)
        before[before] = (
            (item[i[before] - 1] == doc[d[before] - 1]) & free_item[i[before] - 1] & free_doc[d[before] - 1]
        )
        i, d = i[~before], d[~before]
        length = np.zeros(len(i), dtype=np.int64)
        on = np.arange(len(i))
        while len(on):
            x, y = i[on] + length[on], d[on] + length[on]
            ok = (x < len(item)) & (y < len(doc))
            ok[ok] = (item[x[ok]] == doc[y[ok]]) & free_item[x[ok]] & free_doc[y[ok]]
            on = on[ok]
            length[on] += 1
        keep = length >= run  # equal hashes are only candidates
        found.append(np.stack([length[keep], i[keep], d[keep]], axis=1))
    return np.concatenate(found)


def tile(item: np.ndarray, doc: np.ndarray, run: int = RUN) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in document, length), longest first, ties by item and document."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles = []
    while True:
        found = shared_runs(item, doc, free_item, free_doc, run)
        if not len(found):
            return tiles
        found = found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))]
        longest = found[0, 0]
        for length, i, d in found[found[:, 0] == longest].tolist():
            # an earlier tile of this round may have taken words of this one
            if free_item[i : i + length].all() and free_doc[d : d + length].all():
                free_item[i : i + length] = False
                free_doc[d : d + length] = False
                tiles.append((i, d, length))


class Benchmark:
    """The items of one block: word numbers, and which items hold a seed."""

    def __init__(self, items: list[tuple[int | None, str | None]], run: int = RUN):
        self.run, self.known = run, {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        for item_id, text in items:
            own = words(text)
            if own:
                numbers = [self.known.setdefault(w, len(self.known) + 1) for w in own]
                self.items.append((item_id, np.array(numbers, dtype=np.int64)))
        self.sizes = sorted({min(run, len(x)) for _, x in self.items})
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in self.sizes:
            pairs = [
                (h, n) for n, (_, x) in enumerate(self.items) if min(run, len(x)) == size
                for h in np.unique(rolling(x, size)).tolist()
            ]
            pairs.sort()
            self.seeds[size] = (
                np.array([h for h, _ in pairs], dtype=np.uint64), np.array([n for _, n in pairs], dtype=np.int64)
            )

    def numbers(self, text: str | None) -> np.ndarray:
        """A text's word numbers; 0 for words of no item."""
        get = self.known.get
        return np.array([get(w, 0) for w in words(text)], dtype=np.int64)

    def candidates(self, doc: np.ndarray) -> list[int]:
        found: set[int] = set()
        for size, (hashes, owners) in self.seeds.items():
            inside = np.concatenate([[0], np.cumsum(doc == 0)])
            at = np.flatnonzero(inside[size:] == inside[:-size]) if len(doc) >= size else []
            if not len(at):
                continue
            own = np.unique(rolling(doc, size)[at])
            low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for a, b in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True):
                found.update(owners[a:b].tolist())
        return sorted(found)

    def hits(self, text: str | None, coverage: float) -> list[dict]:
        doc = self.numbers(text)
        out = []
        for n in self.candidates(doc):
            item_id, item = self.items[n]
            # parts of the document without any word of an item cannot hold tiles
            tiles = tile(item, doc, min(self.run, len(item)))
            share = sum(length for _, _, length in tiles) / len(item)
            if share >= coverage:
                out.append({"item_id": item_id, "coverage": share, "n_tiles": len(tiles), "n_words": len(item)})
        return out


def write_blocks(benchmark: DataFrame, id_col: str, text_col: str, chars: int = BLOCK_CHARS) -> list[str]:
    """The items in files of at most ``chars`` characters (or one item) in the shared folder, written by the tasks."""
    folder = stage_path(benchmark.sparkSession, "benchmark")

    def save(held: list[tuple]) -> pa.RecordBatch:
        name = f"{folder}/block-{uuid.uuid4().hex}.json"
        with common.open_out(name) as f:
            f.write(json.dumps(held).encode())
        return pa.RecordBatch.from_pydict({"file": [name]})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for item_id, text in common.rows(batches, "item_id", "text"):
            if held and size + len(text or "") > chars:
                yield save(held)
                held, size = [], 0
            held.append((item_id, text))
            size += len(text or "")
        if held:
            yield save(held)

    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    # as many tasks as blocks are needed, so that small partitions do not make small blocks
    made = items.repartition(int(total // chars) + 1).mapInArrow(write, "file string")
    return sorted(r["file"] for r in made.collect())


@common.worker_store
def _block(file: str, run: int) -> Benchmark:
    with common.open_in(file) as f:
        return Benchmark(json.loads(f.read()), run)


def piles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches of about ``size`` bytes together: a block is read and indexed once for them."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    run: int = RUN, coverage: float = COVERAGE, name: str = "hits", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` with the items that contaminate each row, an array<struct> named ``name``."""
    files = write_blocks(benchmark, item_col, item_text, block_chars)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(HITS))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pile in piles(batches, _PILE if len(files) > 1 else 0):
            found: list[list[list[dict]]] = [[[] for _ in range(batch.num_rows)] for batch in pile]
            for file in files:
                items = _block(file, run)
                for batch, lists in zip(pile, found, strict=True):
                    for own, (text,) in zip(lists, common.rows([batch], text_col), strict=True):
                        own += items.hits(text, coverage)
            for batch, lists in zip(pile, found, strict=True):
                yield batch.append_column(name, pa.array(lists, _HITS))

    return docs.mapInArrow(compare, schema)
