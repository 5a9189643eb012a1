"""Exact top-k inner products with a KD-tree per shard.

Vectors are dealt into shards of bounded size: the first median splits, found on a sample of
``SAMPLE_ROWS`` vectors, part the space into cells, and a cell of more than a shard (many copies of one
vector) is dealt by id. Every vector is in a shard, so the sample decides how tight the boxes are and
nothing else. In each shard a KD-tree splits at the median of the widest dimension and keeps tight
bounding boxes. It is written once to the shared folder. No point of a box can score more than the sum
over dimensions of max(q * low, q * high); a query visits boxes best first and stops when the bound
falls below its k-th score so far. Ties at the k-th score are kept, the smaller id wins.

Each query searches its own shard first. With its k-th score there it is held against the outer boxes
of all shards, in blocks, and goes only to those that can reach that score. Queries come in blocks, so
one task holds one shard and one block.

Defined cases: vectors that are null or hold a null or a number that is not finite take no part,
nor do rows without an id; a shorter vector counts as filled up with zeros; rows that repeat an
id count once, with the smallest vector; a query with fewer than k others gets all of them.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from triage.functions.scale import stage, stage_path
from triage.llm import common

SHARD_ROWS = 8192
BLOCK_ROWS = 2048
LEAF_ROWS = 128
BOX_ROWS = 4096  # outer boxes of shards that a block of queries meets at a time
SAMPLE_ROWS = 4096
_PER_CELL = 64  # rows of the sample that a cell holds at least
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND = "query_id long, vec_id long, score long"


@dataclass
class Tree:
    ids: np.ndarray  # in leaf order
    points: np.ndarray
    bounds: np.ndarray  # first and last point of each node; node i has the children 2i+1 and 2i+2
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
        order = np.arange(len(ids))
        bounds = np.zeros((2 ** (depth + 1) - 1, 2), dtype=np.int64)
        bounds[0] = 0, len(ids)
        for node in range(2**depth - 1):
            a, b = bounds[node]
            own = order[a:b]
            middle = (b - a) // 2
            if b - a > 1:
                widest = np.argmax(np.ptp(points[own], axis=0))
                order[a:b] = own[np.argpartition(points[own, widest], middle)]
            bounds[2 * node + 1], bounds[2 * node + 2] = (a, a + middle), (a + middle, b)
        points = points[order]
        low = np.array([points[a:b].min(axis=0) if b > a else np.zeros(points.shape[1]) for a, b in bounds])
        high = np.array([points[a:b].max(axis=0) if b > a else np.zeros(points.shape[1]) for a, b in bounds])
        return cls(ids[order], points, bounds, low, high)

    def search(self, query_id: int, q: np.ndarray, bound: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best that reach ``floor``; ``bound`` has a bound for each node."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.points.dtype)
        inner = len(self.bounds) // 2
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < floor:
                break
            if node < inner:
                for child in (2 * node + 1, 2 * node + 2):
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.bounds[node]
            here = self.points[a:b] @ q
            keep = (here >= floor) & (self.ids[a:b] != query_id)
            if not keep.any():
                continue
            ids, scores = np.append(ids, self.ids[a:b][keep]), np.append(scores, here[keep])
            if len(ids) >= k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                floor = max(floor, scores[-1])
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]

    def search_all(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> pa.Table:
        """``search`` for a block of queries; the bounds of all boxes come from two products."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bound = up @ self.high.T + down @ self.low.T
        bound[:, self.bounds[:, 0] == self.bounds[:, 1]] = -np.inf if bound.dtype.kind == "f" else np.iinfo(np.int64).min
        out = [self.search(i, q, b, k, f) for i, q, b, f in zip(query_ids.tolist(), queries, bound, floors.tolist(), strict=True)]
        n = [len(i) for i, _ in out]
        columns = [np.repeat(query_ids, n), np.concatenate([i for i, _ in out]), np.concatenate([s for _, s in out])]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], schema=_FOUND)


def _flat(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), dtype=kind)
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    out[np.repeat(np.arange(len(lists)), sizes), places] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Floats while products are exact in them, else integers."""
    out = _flat(column, width, np.int64)
    peak = int(np.abs(out).max(initial=0))
    return out if peak * peak * width >= 1 << 52 else out.astype(np.float64)


def _save(name: str, tree: Tree) -> None:
    held = io.BytesIO()
    np.savez(held, ids=tree.ids, points=tree.points, bounds=tree.bounds, low=tree.low, high=tree.high)
    with common.open_out(name) as f:
        f.write(held.getvalue())


@common.worker_store
def _tree(name: str) -> Tree:
    with common.open_in(name) as f:
        kept = np.load(io.BytesIO(f.read()))
    return Tree(*[kept[n] for n in ("ids", "points", "bounds", "low", "high")])


def splits(sample: np.ndarray, cells: int) -> tuple[list[int], list[int]]:
    """Dimension and least value of the upper half for each inner node of the first median splits."""
    depth = max(0, int(np.ceil(np.log2(max(1, min(cells, len(sample) // _PER_CELL))))))
    groups, dims, cuts = [sample], [], []
    for _ in range(depth):
        below = []
        for own in groups:
            widest = int(np.argmax(np.ptp(own, axis=0))) if len(own) else 0
            cut = int(np.ceil(np.median(own[:, widest]))) if len(own) else 0
            dims.append(widest)
            cuts.append(cut)
            upper = own[:, widest] >= cut
            below += [own[~upper], own[upper]]
        groups = below
    return dims, cuts


def cell_of(v: Column, dims: list[int], cuts: list[int]) -> Column:
    """The cell of a vector: down the splits, missing components being zero."""
    if not dims:
        return F.lit(0)
    depth = len(dims).bit_length()
    dim, cut = F.lit(dims), F.lit([int(c) for c in cuts])

    def step(node: Column, _: Column) -> Column:
        value = F.coalesce(F.get(v, F.get(dim, node)), F.lit(0))
        return 2 * node + 1 + F.when(value >= F.get(cut, node), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the usable rows, floor(scale * x) per component, one row per id."""
    x = F.col("v")
    usable = x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    return (
        vectors.select(
            F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
        )
        .where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))
        .select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def reaching(
    asked: DataFrame, trees: DataFrame, width: int, numbers: Callable[[int], Column], blocks: int, box_rows: int = BOX_ROWS
) -> DataFrame:
    """(query_id, shard, file): the shards other than its own whose outer box can reach a query's k-th score."""
    box_blocks = max(1, -(-trees.count() // box_rows))
    boxes = trees.withColumn("_boxes", F.pmod(F.xxhash64("shard"), F.lit(box_blocks)))
    boxes = boxes.withColumn("_block", F.explode(numbers(blocks)))
    held = asked.withColumn("_boxes", F.explode(numbers(box_blocks)))
    schema = pa.schema([("query_id", pa.int64()), ("shard", pa.int64()), ("file", pa.string())])

    def prune(queries: pa.Table, own: pa.Table) -> pa.Table:
        if not queries.num_rows or not own.num_rows:
            return schema.empty_table()
        q = _flat(queries.column("q"), width, np.float64)
        low, high = _flat(own.column("low"), width, np.float64), _flat(own.column("high"), width, np.float64)
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        floor = np.array([-np.inf if f is None else f for f in queries.column("kth").to_pylist()])
        # room for rounding where sums are beyond exact doubles
        reach = bound + np.abs(bound) * 1e-9 >= floor[:, None]
        reach &= queries.column("shard").to_numpy()[:, None] != own.column("shard").to_numpy()[None, :]
        at, box = np.nonzero(reach)
        columns = [queries.column("query_id").take(pa.array(at)), *[own.column(c).take(pa.array(box)) for c in ("shard", "file")]]
        return pa.table(columns, schema=schema)

    return (
        held.select(F.col("block").alias("_block"), "_boxes", "query_id", "q", "kth", "shard").groupBy("_boxes", "_block")
        .cogroup(boxes.select("_boxes", "_block", "shard", "file", "low", "high").groupBy("_boxes", "_block"))
        .applyInArrow(prune, "query_id long, shard long, file string")
    )


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id",
    vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (a condition on vec_id) holds."""
    points = stage(quantised(vectors, id_col, vector_col, scale), "vectors")
    size = points.agg(
        F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q"), F.max(F.size("v")).alias("width")
    ).first()
    n, n_queries, width = size["n"], size["q"] or 0, size["width"] or 0
    blocks = max(1, -(-n_queries // block_rows))
    folder = stage_path(points.sparkSession, "trees")
    deal = lambda c, m, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(m))
    numbers = lambda m: F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))

    drawn = points.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS) if n > shard_rows else points.limit(0)
    dims, cuts = splits(_flat(drawn.select("v").toArrow().column("v"), width, np.int64), -(-n // shard_rows))
    cells = points.withColumn("cell", cell_of(F.col("v"), dims, cuts))
    sizes = cells.groupBy("cell").count()  # at most SAMPLE_ROWS / _PER_CELL cells
    piles = F.ceil(F.col("count") / F.lit(shard_rows)).cast("long")
    cells = cells.join(F.broadcast(sizes.select("cell", piles.alias("piles"))), "cell")
    # cells have numbers below 2 ** 20
    points = stage(
        cells.select("vec_id", "v", (F.shiftleft(F.pmod(F.xxhash64(F.lit(1), "vec_id"), "piles"), 20) + F.col("cell")).alias("shard")),
        "shards",
    )
    queries = points.where(is_query).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "shard", deal(F.col("vec_id"), blocks, 2).alias("block")
    )

    def build(held: pa.Table) -> pa.Table:
        tree = Tree.build(held.column("vec_id").to_numpy(), _matrix(held.column("v"), width), leaf_rows)
        name = f"{folder}/{uuid.uuid4().hex}.npz"
        _save(name, tree)
        low, high = tree.points.min(axis=0).astype(float), tree.points.max(axis=0).astype(float)
        return pa.table({
            "shard": held.column("shard").slice(0, 1), "file": [name],
            "low": pa.array([low], pa.list_(pa.float64())), "high": pa.array([high], pa.list_(pa.float64())),
        })

    def search(asked: pa.Table) -> pa.Table:
        tree, queries_ = _tree(asked.column("file")[0].as_py()), _matrix(asked.column("q"), width)
        if tree.points.dtype != queries_.dtype:  # exact only in integers
            whole = [x.astype(np.int64) for x in (tree.points, tree.low, tree.high)]
            tree, queries_ = Tree(tree.ids, whole[0], tree.bounds, *whole[1:]), queries_.astype(np.int64)
        floors = np.array([-np.inf if f is None else f for f in asked.column("kth").to_pylist()])
        return tree.search_all(asked.column("query_id").to_numpy(), queries_, k, floors)

    trees = stage(
        points.groupBy("shard").applyInArrow(build, "shard long, file string, low array<double>, high array<double>"), "boxes"
    )
    at_home = queries.join(trees.select("shard", "file"), "shard").withColumn("kth", F.lit(None).cast("long"))
    at_home = at_home.select("shard", "file", "block", "query_id", "q", "kth")
    # little data, much work: the partitions stay as many as the session asks for
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(spread, "shard", "block").groupBy("shard", "block")
    found = first = stage(dealt(at_home).applyInArrow(search, FOUND), "home-hits")
    if trees.count() > 1:
        kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        asked = stage(queries.join(kth, "query_id", "left"), "queries")
        pairs = reaching(asked, trees, width, numbers, blocks)
        sent = asked.drop("shard").join(pairs, "query_id").select("shard", "file", "block", "query_id", "q", "kth")
        found = first.unionByName(dealt(sent).applyInArrow(search, FOUND))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
