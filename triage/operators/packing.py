"""Greedy packing of ordered units into a budget, for groups that may not fit into one task.

Which units fit depends on what was taken before, so a running sum is wrong after the first skip.
The rows are dealt in order of group and place, once. A task reads its range from front to back:

* A group that begins inside the range has all of the budget left there, so its units are decided
  at once.
* The first group of a range may have begun before it. Its units are kept open, and a step function
  tells what they leave of any room: for each room from which on, how much they take.
* The functions of a group, one per range it reaches over, are applied in turn (the carry). Then the
  open units are read a second time with the room they really had.

A group of any size is so split over tasks; a unit is read twice at most, and the carry has at most two
rows per range. A function has at most one step per unit of budget, and few once a range has filled it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.functions.scale import stage
from triage.functions.workers import ship

_STEPS = T.ArrayType(T.StructType([T.StructField("since", T.LongType()), T.StructField("uses", T.LongType())]))
_ARROW_STEPS = pa.list_(pa.struct([("since", pa.int64()), ("uses", pa.int64())]))
_TOGETHER = 64  # units applied to a step function between two looks at the rooms that are left


def take(sizes: np.ndarray, room: int) -> tuple[np.ndarray, int]:
    """Places of the units taken in order, and the room that is left."""
    taken, todo = [], np.flatnonzero(sizes <= room)
    while len(todo):
        ends = np.cumsum(sizes[todo])
        n = int(np.searchsorted(ends, room, "right"))
        taken.append(todo[:n])
        if n:
            room -= int(ends[n - 1])
        todo = todo[n:]
        todo = todo[sizes[todo] <= room]
    return np.concatenate(taken) if taken else np.zeros(0, np.int64), room


class Steps:
    """What is left of every room from 0 to ``budget`` after the units seen so far."""

    def __init__(self, budget: int):
        self.left = np.arange(budget + 1)  # the distinct rooms that are left
        self.place = np.arange(budget + 1)  # for each room, which of them

    def apply(self, sizes: np.ndarray) -> None:
        while len(sizes):
            sizes = sizes[sizes <= self.left[-1]]
            for size in sizes[:_TOGETHER].tolist():
                self.left = np.where(self.left >= size, self.left - size, self.left)
            self.left, at = np.unique(self.left, return_inverse=True)
            self.place = at[self.place]
            sizes = sizes[_TOGETHER:]

    def pieces(self) -> list[dict[str, int]]:
        uses = np.arange(len(self.place)) - self.left[self.place]
        since = np.flatnonzero(np.diff(uses, prepend=-1))
        return [{"since": s, "uses": u} for s, u in zip(since.tolist(), uses[since].tolist(), strict=True)]


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Rows at which the values of the columns change, nulls being equal to each other."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        same = pc.fill_null(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b))) if n > 1 else None
        if same is not None:
            missing = pc.not_equal(pc.cast(pc.is_null(a), pa.int8()), pc.cast(pc.is_null(b), pa.int8()))
            new[1:] |= ~same.to_numpy(zero_copy_only=False) | missing.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether a new group begins, rows of one group) in order; a group may come in several pieces."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        starts = _starts(columns).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = [c[a].as_py() for c in columns]
            yield key != before, batch.slice(a, b - a)
            before = key


def pack(units: DataFrame, keys: list[str], order: list[str], budget: int, tokens: str) -> DataFrame:
    """Rows of ``units`` that fit the budget, taken greedily in order.

    A unit that would exceed what is left is skipped and later, smaller ones are still tried;
    exactly filling the budget fits. ``order`` must be unique within ``keys``. Units without tokens
    always fit; units of unknown size, or of a group or place that is null, never do.
    """
    if budget < 0:
        raise ValueError("budget must not be negative")
    ship(units.sparkSession)
    size = F.col(tokens)
    slim = units.where((size > 0) & (size <= budget)).select(
        *keys, F.struct(*order).alias("_ref"), size.cast("long").alias("_t")
    )
    dealt = slim.repartitionByRange(*keys, "_ref").sortWithinPartitions(*keys, "_ref")
    dealt = dealt.withColumn("_range", F.spark_partition_id())
    fields = [T.StructField(f.name, f.dataType) for f in dealt.schema]
    fields += [T.StructField("_open", T.BooleanType()), T.StructField("_steps", _STEPS)]

    def line(head: pa.RecordBatch, steps: list[dict[str, int]]) -> pa.RecordBatch:
        """A row of the carry: what a range takes of the group of ``head``."""
        one = head.slice(0, 1)
        none = {n: pa.nulls(1, one.schema.field(n).type) for n in ("_ref", "_t")}
        columns = [none.get(n, one.column(n)) for n in one.schema.names]
        columns += [pa.nulls(1, pa.bool_()), pa.array([steps], _ARROW_STEPS)]
        return pa.RecordBatch.from_arrays(columns, names=[*one.schema.names, "_open", "_steps"])

    def units_of(rows: pa.RecordBatch, is_open: bool) -> pa.RecordBatch:
        n = rows.num_rows
        columns = [*rows.columns, pa.array(np.full(n, is_open)), pa.nulls(n, _ARROW_STEPS)]
        return pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "_open", "_steps"])

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, steps, head, room = True, Steps(budget), None, budget
        for begins, rows in _runs(batches, keys):
            sizes = rows.column("_t").to_numpy()
            if begins and head is not None:
                if first:
                    yield line(head, steps.pieces())
                first, room = False, budget
            if begins:
                head = rows
            if first:
                steps.apply(sizes)
                yield units_of(rows, True)
            elif room:
                places, room = take(sizes, room)
                if len(places):
                    yield units_of(rows.take(pa.array(places)), False)
        if head is not None:  # the last group may go on in the next range
            yield line(head, steps.pieces() if first else [{"since": 0, "uses": budget - room}])

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = 0
        for begins, rows in _runs(batches, ["_range"]):
            if begins:
                room = rows.column("_room")[0].as_py()
            if room:
                places, room = take(rows.column("_t").to_numpy(), room)
                if len(places):
                    yield rows.take(pa.array(places)).select([*keys, "_ref"])

    seen = stage(dealt.mapInArrow(first_pass, T.StructType(fields)), "pack-units")

    def after(state, x):  # the room a range finds, and what it leaves
        step = F.element_at(F.filter(x["_steps"], lambda p: p["since"] <= state["room"]), -1)
        return F.struct(
            (state["room"] - step["uses"]).alias("room"),
            F.array_append(state["found"], F.struct(x["_range"].alias("_range"), state["room"].alias("_room"))).alias("found"),
        )

    ranges = F.sort_array(F.collect_list(F.struct("_range", "_steps")))
    none = F.expr("cast(array() as array<struct<_range:int,_room:bigint>>)")
    begin = F.struct(F.lit(budget).cast("long").alias("room"), none.alias("found"))
    carry = seen.where("_steps is not null").groupBy(*keys).agg(ranges.alias("_ranges"))
    rooms = carry.select(*keys, F.explode(F.aggregate("_ranges", begin, after)["found"]).alias("_f")).select(*keys, "_f.*")
    is_open = seen.where("_open").join(F.broadcast(rooms), [*keys, "_range"]).where(F.col("_t") <= F.col("_room"))
    is_open = is_open.select(*keys, "_ref", "_t", "_range", "_room")
    # a range is read from front to back again
    again = is_open.repartition("_range").sortWithinPartitions("_range", "_ref")
    late = again.mapInArrow(second_pass, T.StructType([f for f in fields if f.name in [*keys, "_ref"]]))
    chosen = seen.where("not _open").select(*keys, "_ref").unionByName(late).select(*keys, "_ref.*")
    free = units.where(size == 0)
    return units.where(size > 0).join(chosen, [*keys, *order], "left_semi").unionByName(free)
