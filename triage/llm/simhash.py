"""SimHash near-duplicates over a Gray-order hierarchical index.

``fingerprints`` gives every text the 64-bit majority of its shingle hashes. ``links`` finds
all distinct fingerprints within ``max_diff`` bits. The bits are cut into max_diff + 1 blocks;
two linked fingerprints agree in at least one, so they are dealt by (block, its bits). Inside
such a group fingerprints stand in Gray order, where neighbours share most bits. Nodes of
eight hold the bits on which all below them agree; a search goes down from the root, adds up the
differences in the bits that each node adds, and drops the whole group below a node once they
exceed ``max_diff``. A group larger than ``group_rows`` is dealt again by blocks of its other
bits, so no task holds a large group and no pair is lost.

Only the edges of a spanning forest leave a group, never all its pairs, and each fingerprint
counts once however many texts have it. Components come from alternating star contraction,
in rounds over tables in the shared folder.

Defined cases: a null text is an empty one; a text without words has fingerprint zero; a row
with a null id has a fingerprint, no component, and links nothing; rows that repeat an id are
texts of their own under one id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.functions.scale import stage
from triage.llm import common

BITS = 64
GROUP_ROWS = 2048
FANOUT = 8
SEED = 42
_STEP = 8192  # shingles counted at a time
_PAIRS = 2_000_000  # pairs of the index search held at a time


# --- fingerprints ------------------------------------------------------------------


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included."""
    words = (text or "").encode().translate(common.ASCII_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    whole = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype=np.uint64)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[: n - 1]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(whole[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)]
    return np.array(hashes, dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 without any."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _STEP):
        part = np.ascontiguousarray(hashes[at : at + _STEP])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print long) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(t, width)) for t, in common.rows([batch], "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], schema=schema
            )

    return common.texts(docs, id_col, text_col).mapInArrow(compute, "doc_id long, print long")


# --- the index of sorted groups ----------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of a code in the Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Groups of fingerprints in Gray order, with the shared bits of ever larger runs."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes, group = codes[self.order], group[self.order]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])) if len(group) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(group)))
        self.own = np.repeat(np.arange(len(starts)), sizes)  # dense group numbers
        self.sizes = sizes
        # level 0: the codes themselves; level j: runs of FANOUT**j inside a group
        self.base, self.count = [starts], [sizes]
        self.shared, self.value = [np.full(len(codes), ~np.uint64(0))], [self.codes]
        first = starts
        while len(sizes) and self.count[-1].max() > 1:
            below_first, below_count = self.base[-1], self.count[-1]
            count = -(-below_count // FANOUT)
            base = np.cumsum(count) - count
            local = np.arange(count.sum()) - np.repeat(base, count)
            begins = np.repeat(below_first, count) + local * FANOUT
            ones = np.bitwise_and.reduceat(self.value[-1] & self.shared[-1], begins)
            zeros = np.bitwise_and.reduceat(~self.value[-1] & self.shared[-1], begins)
            self.shared.append(ones | zeros)
            self.value.append(ones)
            self.base.append(base)
            self.count.append(count)
        self.first = first

    def forest(self, max_diff: int) -> np.ndarray:
        """For each code, in the given order, the place of a code of its component (its own if alone)."""
        n = len(self.codes)
        labels = np.arange(n)
        if n:
            weight = np.cumsum(self.sizes[self.own])
            for part in np.split(np.arange(n), np.flatnonzero(np.diff(weight // _PAIRS)) + 1):
                a, b = self._near(part[self.sizes[self.own[part]] > 1], max_diff)
                unite(labels, a, b)
        out = np.empty(n, dtype=np.int64)
        out[self.order] = self.order[labels]
        return out

    def _near(self, who: np.ndarray, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places (a < b) within ``max_diff`` bits, for a in ``who``."""
        level = len(self.base) - 1
        node = self.base[level][self.own[who]]
        diff = np.bitwise_count((self.codes[who] ^ self.value[level][node]) & self.shared[level][node]).astype(np.int64)
        who, node, diff = who[diff <= max_diff], node[diff <= max_diff], diff[diff <= max_diff]
        while level:
            group = self.own[who]
            local = (node - self.base[level][group]) * FANOUT
            n = np.minimum(FANOUT, self.count[level - 1][group] - local)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            child = np.repeat(self.base[level - 1][group] + local, n) + inner
            above, who, diff = np.repeat(node, n), np.repeat(who, n), np.repeat(diff, n)
            fresh = self.shared[level - 1][child] & ~self.shared[level][above]
            diff = diff + np.bitwise_count((self.codes[who] ^ self.value[level - 1][child]) & fresh)
            # the last code below the child: each pair is met once, from its smaller place
            span = FANOUT ** (level - 1)
            last = self.first[self.own[who]] + (child - self.base[level - 1][self.own[who]] + 1) * span - 1
            keep = (diff <= max_diff) & (last > who)
            who, node, diff = who[keep], child[keep], diff[keep]
            level -= 1
        return who, node


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of each pair; ``labels`` holds the smallest place of each component."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(labels, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels[:] = further


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never cut a group; the input is sorted by ``keys``."""
    held: list[pa.Table] = []
    n, limit = 0, rows
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < limit:
            continue
        table = pa.concat_tables(held)
        last = np.ones(len(table), dtype=bool)
        for k in keys:
            column = table.column(k).to_numpy()
            last &= column == column[-1]
        cut = len(table) - int(last.sum())
        if cut:
            yield table.slice(0, cut)
        held, n = [table.slice(cut)], len(table) - cut
        limit = max(rows, 2 * n)  # a group above the limit is put together a few times only
    if held:
        yield pa.concat_tables(held)


# --- links and components ----------------------------------------------------------


def split_mask(mask: int, parts: int) -> list[int]:
    """``mask`` with one of ``parts`` blocks of its free bits added, for each block."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, max_diff: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) that join all distinct ``print`` within ``max_diff`` bits of each other."""
    spark = prints.sparkSession
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["mask", "key"]):
            mask, key = table.column("mask").to_numpy(), table.column("key").to_numpy()
            group = np.cumsum(np.concatenate([[True], (np.diff(mask) != 0) | (np.diff(key) != 0)]))
            codes = table.column("print").to_numpy()
            many = np.bincount(group)[group] > 1
            codes, group = codes[many], group[many]
            root = GrayIndex(codes.view(np.uint64), group).forest(max_diff)
            linked = root != np.arange(len(root))
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(codes[root[linked]]), pa.array(codes[linked])], schema=edge)

    masks = split_mask(0, max_diff + 1)
    with_key = lambda df: df.withColumn("key", F.col("print").bitwiseAND(F.col("mask")))
    rows = with_key(prints.select("print", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")))
    found = None
    while True:
        full = stage(rows.groupBy("mask", "key").count().where(F.col("count") > group_rows).drop("count"), "full-groups")
        any_full = not full.isEmpty()
        fit = rows.join(full, ["mask", "key"], "left_anti") if any_full else rows
        edges = fit.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(search, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if not any_full:
            return found.distinct()
        # only masks of full groups go on: at most max_diff + 1 for each mask of the level before
        used = {r["mask"] for r in full.select("mask").distinct().toLocalIterator()}
        children = {m: split_mask(m, max_diff + 1) for m in masks if _signed(m) in used}
        masks = sorted({c for own in children.values() for c in own})
        table = spark.createDataFrame(
            [(_signed(m), _signed(c)) for m, own in children.items() for c in own], "mask long, child long"
        )
        again = rows.join(full, ["mask", "key"], "left_semi").join(F.broadcast(table), "mask")
        rows = with_key(stage(again.select("print", F.col("child").alias("mask")), "split-groups"))


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root): the smallest node of the component of every node with an edge.

    Alternating large and small stars: each round points nodes at the smallest neighbour, until
    every component is a star around its smallest node. The minimum of a node's neighbours is a
    combinable aggregate, and a node with many neighbours is split in the join.
    """
    current = stage(
        edges.where("a != b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            return current.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
                current.select("low", "low").distinct()
            )
        before = tuple(mark)
        both = current.select(F.col("low").alias("u"), F.col("high").alias("v")).union(current.select("high", "low"))
        least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.col("c"), F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, F.col("u") == F.col("c"))
            .select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()
        )
        small = large.groupBy(F.col("high").alias("c")).agg(F.min("low").alias("m"))
        joined = large.join(small, F.col("high") == F.col("c"))
        current = stage(
            joined.select(F.least("m", "low").alias("low"), F.greatest("m", "low").alias("high"))
            .union(small.select(F.col("m").alias("low"), F.col("c").alias("high"))).where("low != high").distinct(),
            "edges",
        )
    raise RuntimeError("components did not settle")


def classes(prints: DataFrame, max_diff: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, print, component_id) for (doc_id, print): the smallest id reachable over links."""
    prints = stage(prints, "prints")
    distinct = stage(
        prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints"
    )
    roots = components(links(distinct, max_diff, group_rows))
    named = distinct.join(roots, F.col("print") == F.col("node"), "left").withColumn("root", F.coalesce("root", "print"))
    named = stage(named.select("print", "least", "root"), "rooted")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    each = named.join(smallest, "root").select(F.col("print").alias("_print"), "component_id")
    return prints.join(each, F.col("print") == F.col("_print"), "left").select(
        "doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
