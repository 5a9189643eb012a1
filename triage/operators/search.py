"""Exact top-k search over cells, without comparing all pairs.

A block holds at most about ``chunk_block`` vectors of a scope and is one group of an Arrow cogroup
with the queries that meet it, so vectors travel once per block and not once per cell. A scope that
fits into a block is one, and one round finds its hits. The vectors of a larger scope are dealt to
their nearest pivot (about the square root of their number, chosen by a hash); the pivots, halved
along their widest dimension, make blocks of cells that lie together.

Inside a block, too, vectors stand in cells. A cell keeps its radius, its number of vectors and its
box: the least and the greatest value of every dimension, which for counts of terms are the block
maxima of inverted lists. Bounds follow for a query: from the ball by the triangle inequality, and
from the box dimension by dimension.

1. A query first meets the blocks of the cells with the best bounds, as many as hold ``k`` vectors.
2. With the k-th score found there, it meets all other blocks with a cell whose bound reaches it.

In a block a query meets cells from the best bound on, ever more at a time, as long as bounds reach
the k-th score it knows. A cell of more than ``chunk_block`` vectors (many copies of one vector) and
queries of more than ``query_block`` in one block are split. Vectors in many dimensions without
clusters still meet most cells: every query then visits every block, in bounded memory.
Nothing is broadcast but what a count has proved small.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from triage.functions.scale import broadcast_if_small, stage
from triage.functions.vectors import normalize

CHUNK_BLOCK = 16384
QUERY_BLOCK = 8192
_VECTOR = T.ArrayType(T.DoubleType())
_HASHED = 1 << 30


def _cogroup(left: DataFrame, right: DataFrame, keys: list[str]) -> PandasCogroupedOps:
    """Both sides by key. Those of the right get names of their own, as both may come from one table."""
    renamed = right.select(*[F.col(c).alias(f"_r{c}" if c in keys else c) for c in right.columns])
    return left.groupBy(*keys).cogroup(renamed.groupBy(*[f"_r{c}" for c in keys]))


class CellSearch:
    """One search; ``probes`` are the (query, cell) pairs of its rounds, ``cells`` their sizes."""

    def __init__(
        self, queries: DataFrame, chunks: DataFrame, k: int, metric: str, scope: tuple[str, ...], digits: int,
        chunk_block: int = CHUNK_BLOCK, query_block: int = QUERY_BLOCK,
    ):
        """``queries``: scope, _qid, _qv; ``chunks``: scope, _cid, _cv; vectors of one length, none null."""
        self.scope, self.keys = list(scope), list(scope) or ["_all"]
        self.k, self.chunk_block, self.query_block = k, chunk_block, query_block
        self.tools = _tools(metric, digits, k, self.keys, chunk_block)
        unit = (lambda v: normalize(v)) if metric == "cosine" else (lambda v: v.cast("array<double>"))
        whole = [] if scope else [F.lit(0).alias("_all")]
        self.asks = stage(
            queries.select(*scope, *whole, F.monotonically_increasing_id().alias("_q"), "_qid", unit(F.col("_qv")).alias("_qv")),
            "search-queries",
        )
        self.points = stage(chunks.select(*scope, *whole, "_cid", unit(F.col("_cv")).alias("_cv")), "search-vectors")
        self.cid = self.points.schema["_cid"].dataType
        self.met: list[DataFrame] = []

    def _fields(self, *more: tuple[str, T.DataType]) -> T.StructType:
        own = [T.StructField(k, self.points.schema[k].dataType) for k in self.keys]
        return T.StructType([*own, *[T.StructField(n, t) for n, t in more]])

    @property
    def cells(self) -> DataFrame:
        """(scope, _cell, _n) of all cells that a block with queries holds."""
        held = reduce(DataFrame.unionByName, [m.where("_n is not null") for m in self.met])
        return held.groupBy(*self.keys, "_cell", "_part").agg(F.max("_n").alias("_n")).groupBy(*self.keys, "_cell").agg(F.sum("_n").alias("_n"))

    @property
    def probes(self) -> list[DataFrame]:
        each = F.explode(F.expr("sequence(1L, _asked)"))
        return [m.where("_asked > 0").select(*self.keys, "_cell", each.alias("_at")) for m in self.met]

    # --- blocks --------------------------------------------------------------------

    def _split(self, row_id: str, count: str, size: int) -> Column:
        return F.pmod(F.xxhash64(row_id), F.greatest(F.lit(1), F.ceil(F.col(count) / size))).cast("int")

    def _copies(self, count: str, size: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.ceil(F.col(count) / size).cast("int") - 1))

    def _make_cells(self, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(vectors of large scopes with their cells, cells with their blocks)."""
        keys, size = self.keys, self.chunk_block
        first = self.points.groupBy(*keys).agg(F.min(F.struct(F.xxhash64("_cid"), "_cid"))["_cid"].alias("_first"))
        points = self.points.join(broadcast_if_small(stage(large.join(first, keys), "search-large")), keys)
        # about the square root of the rows, at most a block's worth, and one at least
        wanted = F.least(F.sqrt("_rows"), F.lit(float(size))) / F.col("_rows")
        chosen = (F.pmod(F.xxhash64("_cid", F.lit(1)), F.lit(_HASHED)) < wanted * _HASHED) | (F.col("_cid") == F.col("_first"))
        pivots = points.where(chosen).groupBy(*keys, "_cid", "_rows").agg(F.min("_cv").alias("_pv"))
        pivots = pivots.select(*keys, F.col("_cid").alias("_pid"), "_pv", self._copies("_rows", size).alias("_b"))
        dealt = points.withColumn("_b", self._split("_cid", "_rows", size)).select(*keys, "_b", "_cid", "_cv")
        assigned = stage(
            _cogroup(dealt, pivots, [*keys, "_b"]).applyInArrow(
                self.tools["assign"],
                self._fields(("_cid", self.cid), ("_cv", _VECTOR), ("_cell", self.cid), ("_pv", _VECTOR), ("_far", T.DoubleType()),
                             ("_n", T.LongType()), ("_lo", _VECTOR), ("_hi", _VECTOR)),
            ),
            "search-assigned",
        )
        parts = assigned.where("_n is not null").select(*keys, "_cell", "_pv", "_far", "_n", "_lo", "_hi")
        cells = stage(
            parts.groupBy(*keys, "_cell").applyInArrow(self.tools["merge"], self._fields(*[(f.name, f.dataType) for f in parts.schema[len(keys):]])),
            "search-cells",
        )
        blocks = cells.select(*keys, "_cell", "_n", "_pv").groupBy(*keys).applyInArrow(
            self.tools["blocks"], self._fields(("_cell", self.cid), ("_block", T.IntegerType()), ("_parts", T.IntegerType()))
        )
        return assigned.where("_n is null").select(*keys, "_cid", "_cv", "_cell"), stage(cells.join(blocks, [*keys, "_cell"]), "search-blocks")

    # --- rounds --------------------------------------------------------------------

    def _choose(self, asks: DataFrame, cells: DataFrame, first: bool) -> DataFrame:
        """(scope, _q, _qv, _least, _blocks) of the queries of large scopes that have blocks to meet."""
        size = self.chunk_block
        sizes = broadcast_if_small(stage(asks.groupBy(*self.keys).agg(F.count("*").alias("_asked")), "search-asked"))
        dealt = asks.join(sizes, self.keys).withColumn("_b", self._split("_q", "_asked", size))
        spread = cells.join(sizes, self.keys).withColumn("_b", self._copies("_asked", size)).drop("_asked", "_parts")
        both = _cogroup(dealt.select(*self.keys, "_b", "_q", "_qv", "_least", "_before"), spread, [*self.keys, "_b"])
        out = self._fields(("_q", T.LongType()), ("_qv", _VECTOR), ("_least", T.DoubleType()), ("_blocks", T.ArrayType(T.IntegerType())))
        return stage(both.applyInArrow(self.tools["first" if first else "rest"], out), "search-dealt")

    def _round(self, dealt: DataFrame, placed: DataFrame) -> DataFrame:
        """(scope, _q, _cid, score): the best k of each query in each block it meets.

        ``dealt``: scope, _q, _qv, _least, _blocks; ``placed``: scope, _cid, _cv, _cell, _block, _parts.
        """
        keys = [*self.keys, "_block"]
        asks = dealt.withColumn("_block", F.explode("_blocks")).drop("_blocks")
        met = asks.groupBy(*keys).agg(F.ceil(F.count("*") / self.query_block).cast("int").alias("_qb"))
        parts = placed.select(*keys, "_parts").distinct()
        met = broadcast_if_small(stage(met.join(parts, keys), "search-met"))
        asks = asks.join(met, keys).select(
            *keys, F.pmod(F.xxhash64("_q"), "_qb").cast("int").alias("_qi"), F.explode(F.expr("sequence(0, _parts - 1)")).alias("_part"),
            "_q", "_qv", "_least",
        )
        rows = placed.join(met.drop("_parts"), keys).select(
            *keys, F.explode(F.expr("sequence(0, _qb - 1)")).alias("_qi"), F.pmod(F.xxhash64("_cid"), "_parts").cast("int").alias("_part"),
            "_cid", "_cv", "_cell",
        )
        out = self._fields(("_q", T.LongType()), ("_cid", self.cid), ("score", T.DoubleType()),
                           ("_cell", self.cid), ("_part", T.IntegerType()), ("_n", T.LongType()), ("_asked", T.LongType()))
        both = _cogroup(asks, rows, [*keys, "_qi", "_part"]).applyInArrow(self.tools["search"], out)
        made = stage(both, "search-found")
        self.met.append(made.where("_q is null").select(*self.keys, "_cell", "_part", "_n", "_asked"))
        return made.where("_q is not null").select("_q", "_cid", "score")

    def _ranked(self, found: DataFrame) -> DataFrame:
        best = W.partitionBy("_q").orderBy(F.col("score").desc(), "_cid")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= self.k)

    def run(self) -> DataFrame:
        """(scope, _qid, _cid, score, rank)."""
        keys, none = self.keys, F.lit(None)
        asked = self.asks.select(*keys).distinct()
        sizes = stage(self.points.groupBy(*keys).agg(F.count("*").alias("_rows")).join(asked, keys, "left_semi"), "search-scopes")
        few = broadcast_if_small(sizes.where(F.col("_rows") <= self.chunk_block).select(*keys))
        dealt = self.asks.join(few, keys, "left_semi").select(
            *keys, "_q", "_qv", none.cast("double").alias("_least"), F.array(F.lit(0)).alias("_blocks")
        )
        placed = self.points.join(few, keys, "left_semi").select(
            *keys, "_cid", "_cv", none.cast(self.cid).alias("_cell"), F.lit(0).alias("_block"), F.lit(1).alias("_parts")
        )
        large = sizes.where(F.col("_rows") > self.chunk_block)
        if large.isEmpty():
            found = self._round(dealt, placed)
        else:
            vectors, cells = self._make_cells(large)
            blocks = broadcast_if_small(cells.select(*keys, "_cell", "_block", "_parts"))
            vectors = vectors.join(blocks, [*keys, "_cell"]).select(placed.columns)
            asks = self.asks.join(broadcast_if_small(large.select(*keys)), keys, "left_semi")
            begin = asks.withColumn("_least", none.cast("double")).withColumn("_before", F.expr("cast(array() as array<int>)"))
            home = self._choose(begin, cells, True)
            found = self._round(dealt.unionByName(home), placed.unionByName(vectors))
            least = self._ranked(found).where(F.col("rank") == self.k).select("_q", F.col("score").alias("_least"))
            rest = home.drop("_least").withColumnRenamed("_blocks", "_before").join(least, "_q", "left")
            rest = self._choose(rest, cells, False)
            if not rest.isEmpty():
                found = found.unionByName(self._round(rest, vectors))
        return self._ranked(found).join(self.asks.select(*self.scope, "_q", "_qid"), "_q").select(*self.scope, "_qid", "_cid", "score", "rank")


def _tools(metric: str, digits: int, k: int, keys: list[str], chunk_block: int) -> dict[str, Callable[[pa.Table, pa.Table], pa.Table]]:
    """The functions that run in tasks, built here so that tasks need no import of this package."""
    step_rows, slack, grain = 512, 10.0**-digits, 1e-9

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        values = column.combine_chunks().flatten() if len(column) else pa.array([], pa.float64())
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)

    def lists(m: np.ndarray) -> pa.Array:
        wide = m.shape[1] if m.ndim == 2 else 0
        return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * wide, pa.array(m.ravel()))

    def table(like: pa.Table, n: int, columns: dict[str, pa.Array]) -> pa.Table:
        """``n`` rows with the key of ``like``, one side of a group."""
        held = {name: like.column(name if name in like.column_names else f"_r{name}") for name in keys}
        own = {name: pa.repeat(c[0], n) if len(c) else c.combine_chunks() for name, c in held.items()}
        return pa.table({**own, **columns})

    def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)

    def assign(points: pa.Table, pivots: pa.Table) -> pa.Table:
        """The vectors with their cells, and behind them a row for each cell: radius, count and box here."""
        v, p = matrix(points.column("_cv")), matrix(pivots.column("_pv"))
        near = np.zeros(len(v), dtype=np.int64)
        for at in range(0, len(v), step_rows):
            near[at : at + step_rows] = np.argmin(squares(v[at : at + step_rows], p), axis=1)
        far = np.linalg.norm(v - p[near], axis=1)
        order = np.argsort(near, kind="stable")
        used, begins, counts = np.unique(near[order], return_index=True, return_counts=True)
        pid, vector, double = pivots.column("_pid").combine_chunks(), pa.list_(pa.float64()), pa.float64()
        none = lambda kind, n: pa.nulls(n, kind)
        rows = table(points, len(v), {
            "_cid": points.column("_cid").combine_chunks(), "_cv": points.column("_cv").combine_chunks().cast(vector),
            "_cell": pid.take(pa.array(near)), "_pv": none(vector, len(v)), "_far": pa.array(far),
            "_n": none(pa.int64(), len(v)), "_lo": none(vector, len(v)), "_hi": none(vector, len(v)),
        })
        if not len(v):
            return rows
        parts = table(points, len(used), {
            "_cid": none(points.column("_cid").type, len(used)), "_cv": none(vector, len(used)),
            "_cell": pid.take(pa.array(used)), "_pv": lists(p[used]), "_far": pa.array(np.maximum.reduceat(far[order], begins), double),
            "_n": pa.array(counts, pa.int64()), "_lo": lists(np.minimum.reduceat(v[order], begins)),
            "_hi": lists(np.maximum.reduceat(v[order], begins)),
        })
        return pa.concat_tables([rows, parts.cast(rows.schema)])

    def merge(parts: pa.Table) -> pa.Table:
        """A cell from its parts."""
        one = parts.slice(0, 1)
        return table(one, 1, {
            "_cell": one.column("_cell").combine_chunks(), "_pv": one.column("_pv").combine_chunks(),
            "_far": pa.array([pc.max(parts.column("_far")).as_py()], pa.float64()),
            "_n": pa.array([pc.sum(parts.column("_n")).as_py()], pa.int64()),
            "_lo": lists(matrix(parts.column("_lo")).min(axis=0, keepdims=True)),
            "_hi": lists(matrix(parts.column("_hi")).max(axis=0, keepdims=True)),
        })

    def blocks(cells: pa.Table) -> pa.Table:
        """The cells of a scope, halved along the widest dimension of their pivots until a block holds them."""
        cells = cells.take(pc.sort_indices(cells, sort_keys=[("_cell", "ascending")]))
        n, p = cells.column("_n").to_numpy(), matrix(cells.column("_pv"))
        block, parts = np.zeros(len(n), np.int32), np.ones(len(n), np.int32)
        todo, made = [np.arange(len(n))], 0
        while todo:
            at = todo.pop()
            total = n[at].sum()
            if total <= chunk_block or len(at) == 1:
                block[at], parts[at] = made, -(-total // chunk_block)
                made += 1
                continue
            wide = np.argmax(np.ptp(p[at], axis=0))
            at = at[np.argsort(p[at, wide], kind="stable")]
            half = min(max(1, int(np.searchsorted(np.cumsum(n[at]), total / 2))), len(at) - 1)
            todo += [at[half:], at[:half]]
        return table(cells, len(n), {"_cell": cells.column("_cell").combine_chunks(), "_block": pa.array(block), "_parts": pa.array(parts)})

    def bounds(q: np.ndarray, p: np.ndarray, far: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """No score of a query in a cell is greater."""
        if metric == "cosine":
            ball = q @ p.T + np.linalg.norm(q, axis=1)[:, None] * far[None, :]
            box = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
            return np.minimum(ball, box) + grain
        ball = np.maximum(0, np.sqrt(np.maximum(0, squares(q, p))) - far[None, :] - grain)
        box = np.zeros_like(ball)
        for d in range(q.shape[1]):
            out = np.maximum(0, np.maximum(lo[:, d][None, :] - q[:, d][:, None], q[:, d][:, None] - hi[:, d][None, :]))
            box += out * out
        return 1.0 - np.maximum(ball * ball, box) + grain

    def places(bound: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each cell from the best bound on, how many of the first ones hold k vectors)."""
        order = np.argsort(-bound, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(bound.shape[1])[None, :], axis=1)
        return place, (np.cumsum(n[order], axis=1) < k).sum(axis=1) + 1

    def choose(asks: pa.Table, cells: pa.Table, first: bool) -> pa.Table:
        cells = cells.take(pc.sort_indices(cells, sort_keys=[("_block", "ascending"), ("_cell", "ascending")]))
        n, q = cells.column("_n").to_numpy(), matrix(asks.column("_qv"))
        names, begins = np.unique(cells.column("_block").to_numpy(), return_index=True)
        held = [matrix(cells.column("_pv")), cells.column("_far").to_numpy(), matrix(cells.column("_lo")), matrix(cells.column("_hi"))]
        before = asks.column("_before").to_pylist()
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, min(step_rows, (1 << 22) // max(1, len(n))))
        for at in range(0, len(q) if len(n) else 0, step):
            bound = bounds(q[at : at + step], *held)
            if first:
                place, needed = places(bound, n)
                wanted = place < needed[:, None]
            else:
                least = asks.column("_least").slice(at, step).to_numpy()
                wanted = bound + slack >= np.where(np.isnan(least), -np.inf, least)[:, None]
            wanted = np.logical_or.reduceat(wanted, begins, axis=1)
            for i, met in enumerate(before[at : at + step]):
                wanted[i, np.searchsorted(names, met)] = False
            i, j = np.nonzero(wanted)
            rows.append(i + at)
            cols.append(j)
        at, counts = np.unique(np.concatenate(rows), return_counts=True)
        named = pa.array((names if len(names) else np.zeros(0))[np.concatenate(cols)], pa.int32())
        lists_ = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), named)
        taken = {c: asks.column(c).combine_chunks().take(pa.array(at)) for c in ("_q", "_qv", "_least")}
        return table(asks if len(asks) else cells, len(at), {**taken, "_blocks": lists_})

    def cells_of(points: pa.Table, v: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """(cell of each vector, ids of the cells): as given, or around evenly taken vectors."""
        given = points.column("_cell").combine_chunks()
        if not given.null_count:
            found = given.dictionary_encode()
            return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
        n = int(np.sqrt(len(v)))
        picked = np.arange(n) * len(v) // n
        near = [np.argmin(squares(v[at : at + step_rows], v[picked]), axis=1) for at in range(0, len(v), step_rows)]
        return np.concatenate(near), points.column("_cid").combine_chunks().take(pa.array(picked))

    def first_k(score: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """The k greatest kept scores of each row, of equal ones the first."""
        score = np.where(keep, score, -np.inf)
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k][:, None]
        same = keep & (score == least)
        return keep & ((score > least) | (same & (np.cumsum(same, axis=1, dtype=np.int32) <= k)))

    def search(asks: pa.Table, points: pa.Table) -> pa.Table:
        """The best k vectors of each query, ties to the smaller id; behind them a row for each cell: size and queries."""
        points = points.take(pc.sort_indices(points, sort_keys=[("_cid", "ascending")]))
        q, v = matrix(asks.column("_qv")), matrix(points.column("_cv"))
        rows, cols, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        names, begins, counts, asked = pa.nulls(0, points.column("_cid").type), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(q) and len(v):
            near, names = cells_of(points, v)
            rank = np.argsort(near, kind="stable")  # places in the order of ids
            v = v[rank]
            used, begins, counts = np.unique(near[rank], return_index=True, return_counts=True)
            names, asked = names.take(pa.array(used)), np.zeros(len(used), np.int64)
            centre = np.add.reduceat(v, begins) / counts[:, None]
            far = np.maximum.reduceat(np.linalg.norm(v - np.repeat(centre, counts, axis=0), axis=1), begins)
            held = centre, far, np.minimum.reduceat(v, begins), np.maximum.reduceat(v, begins)
            given = asks.column("_least").to_numpy()
            known = np.where(np.isnan(given), -np.inf, given)
        for at in range(0, len(q) if len(v) else 0, step_rows):
            part, low = q[at : at + step_rows], known[at : at + step_rows].copy()
            bound = bounds(part, *held) + slack
            place, end = places(bound, counts)
            begin, more = np.zeros_like(end), 1
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            while ((place >= begin[:, None]) & (bound >= low[:, None])).any():
                wanted = (place >= begin[:, None]) & (place < end[:, None]) & (bound >= low[:, None])
                new = [best]
                for c in np.flatnonzero(wanted.any(axis=0)):
                    mine, cell = np.flatnonzero(wanted[:, c]), slice(begins[c], begins[c] + counts[c])
                    asked[c] += len(mine)
                    score = part[mine] @ v[cell].T if metric == "cosine" else 1.0 - squares(part[mine], v[cell])
                    keep = score >= (low[mine] - slack)[:, None]
                    if counts[c] > k and keep.sum() > 4 * k * len(mine):
                        score = score.round(digits) + 0.0
                        keep = first_k(score, keep)
                    i, j = np.nonzero(keep)
                    new.append((mine[i], rank[begins[c] + j], score[i, j].round(digits) + 0.0))
                i, j, s = (np.concatenate(x) for x in zip(*new, strict=True))
                fits = s >= low[i]
                i, j, s = i[fits], j[fits], s[fits]
                order = np.lexsort((j, -s, i))
                i, j, s = i[order], j[order], s[order]
                at_ = np.arange(len(i)) - np.searchsorted(i, np.arange(len(part)))[i]
                low[i[at_ == k - 1]] = s[at_ == k - 1]
                best = i[at_ < k], j[at_ < k], s[at_ < k]
                begin, end, more = end, end + more, more * 2
            rows.append(best[0] + at)
            cols.append(best[1])
            values.append(best[2])
        at, like = pa.array(np.concatenate(rows)), asks if len(asks) else points
        n, of = len(at), len(asked)
        whole = len(asks) and len(points) and asks.column("_qi")[0].as_py() == 0
        hits = table(like, n, {
            "_q": asks.column("_q").combine_chunks().take(at),
            "_cid": points.column("_cid").combine_chunks().take(pa.array(np.concatenate(cols))),
            "score": pa.array(np.concatenate(values)), "_cell": pa.nulls(n, points.column("_cid").type),
            "_part": pa.nulls(n, pa.int32()), "_n": pa.nulls(n, pa.int64()), "_asked": pa.nulls(n, pa.int64()),
        })
        if not of:
            return hits
        cells = table(like, of, {
            "_q": pa.nulls(of, pa.int64()), "_cid": pa.nulls(of, points.column("_cid").type), "score": pa.nulls(of, pa.float64()),
            "_cell": names, "_part": pa.repeat(asks.column("_part")[0], of),
            "_n": pa.array(counts, pa.int64()) if whole else pa.nulls(of, pa.int64()), "_asked": pa.array(asked, pa.int64()),
        })
        return pa.concat_tables([hits, cells.cast(hits.schema)])

    return {
        "assign": assign, "merge": merge, "blocks": blocks, "search": search,
        "first": lambda asks, cells: choose(asks, cells, True), "rest": lambda asks, cells: choose(asks, cells, False),
    }
