"""Periodic runs of words: stretches in which the words a period apart are the same.

A run is a maximal stretch of ``times`` periods or more (and of ``least`` words or more) whose
smallest period is q. Its words form one long piece of a diagonal of lag q: from the second
period on every word has an earlier occurrence q words before. The runs are found by an online
diagonal dynamic programme that is kept sparse: reading left to right, the earlier occurrences
of what is read lengthen the matches of their lags; a lag that is not lengthened ends, and if
its match is long enough, it is a run.

One word at a time would look at every pair of equal words, which is quadratic for a text that
repeats one word. So the programme for lags of 2^k to 2^(k+1) - 1 reads blocks of 2^k words. A
run matches (times - 1) * q >= 3 * 2^k words or less by one, so it covers at least two whole
blocks, and a block has at most 2^k earlier occurrences in that range: n per k, n log n in all.
Ends are completed word by word through the shorter blocks. Blocks are named exactly (equal
name, equal words, by doubling), never by a hash alone, and only for stretches that occur
twice in a document, so that ordinary text leaves the programme after two or three k. A lag that
is a multiple of a run's period ends with the same stretch, and the smallest lag is kept.

Many documents go through one pass; names hold the document, so nothing matches across.

Defined cases: a null or empty text has no words and no runs and collapses to an empty text;
a text without runs keeps all its words; rows that repeat an id are rows of their own; a null
id stays; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.llm import common

TIMES = 4
LEAST = 6
SPACE = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start: long, length: long, period: long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
# Words that go through the programme together: more in one document, if it has more.
_TOGETHER = 400_000


def _names(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(name at each of n places or -1, places that have one) for keys found more than once."""
    codes, _ = pd.factorize(keys)
    often = np.bincount(codes)[codes] > 1 if len(codes) else np.zeros(0, bool)
    kept = at[often]
    names = np.full(n, -1, dtype=np.int32)
    names[kept] = codes[often]
    return names, kept


def runs(words: np.ndarray, owner: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) by start, then period; ``words`` are numbers, ``owner`` the
    document of each word, ascending."""
    if times < 4:
        raise ValueError("a run of fewer than four periods need not cover two blocks")
    n = len(words)
    found = [np.zeros((0, 3), dtype=np.int64)]
    longest = int(np.bincount(owner).max()) if n else 0
    levels: list[np.ndarray] = []
    names, alive = _names(words.astype(np.int64) * (int(owner[-1]) + 1 if n else 1) + owner, np.arange(n), n)
    while len(alive) and times << len(levels) <= longest:
        block = 1 << len(levels)
        levels.append(names)
        q, first, end = _diagonals(names, alive, block, n)
        first, end = _to_the_ends(levels, q, first, end)
        length = end - first + q
        keep = (length >= times * q) & (length >= least)
        found.append(np.stack([(first - q)[keep], length[keep], q[keep]], axis=1))
        # windows of twice the length are named by their halves, where both occur again
        both = alive[(alive + block < n)]
        both = both[names[both + block] >= 0]
        names, alive = _names(names[both].astype(np.int64) * n + names[both + block], both, n)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (np.diff(rows[:, :2], axis=0, prepend=-1) == 0).all(axis=1)  # a multiple of the period
    rows = rows[~same]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _diagonals(names: np.ndarray, alive: np.ndarray, block: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, first word, end) of the matches of two blocks or more with lags of block to 2 * block - 1."""
    order = np.argsort(names[alive], kind="stable")
    places = names[alive[order]].astype(np.int64) * (n + 1) + alive[order]
    read = alive[alive % block == 0]
    base = names[read].astype(np.int64) * (n + 1)
    low = np.searchsorted(places, base + np.maximum(read - 2 * block + 1, 0), "left")
    high = np.searchsorted(places, base + np.maximum(read - block, -1), "right")
    count = np.maximum(high - low, 0)
    at = np.repeat(read, count)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    lag = at - places[inner + np.repeat(low, count)] % (n + 1)
    by = np.lexsort((at, lag))
    at, lag = at[by], lag[by]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + block)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(at)) - 1
    long = ends > begins
    begins, ends = begins[long], ends[long]
    return lag[begins], at[begins], at[ends] + block


def _to_the_ends(
    levels: list[np.ndarray], q: np.ndarray, first: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Matches lengthened on both sides by less than a block, through blocks of half the size each time."""
    for k in range(len(levels) - 2, -1, -1):
        step, names = 1 << k, levels[k]
        at = np.flatnonzero(end + step <= len(names))
        e = end[at]
        end[at[(names[e] >= 0) & (names[e] == names[e - q[at]])]] += step
        at = np.flatnonzero(first - step - q >= 0)
        f = first[at] - step
        first[at[(names[f] >= 0) & (names[f] == names[f - q[at]])]] -= step
    return first, end


def kept_words(n: int, rows: np.ndarray) -> np.ndarray:
    """Which of n words stay: not those of a run after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def collapse_all(texts: list[str | None], times: int = TIMES, least: int = LEAST) -> Iterator[tuple[np.ndarray, str]]:
    """(runs, text without the repetitions) of each text."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    numbers, _ = pd.factorize(np.array([w for own in split for w in own], dtype=object))
    owner = np.repeat(np.arange(len(split)), sizes)
    rows = runs(numbers, owner, times, least)
    places = owner[rows[:, 0]] if len(rows) else rows[:, 0]
    low = np.searchsorted(places, np.arange(len(split)), "left")
    high = np.searchsorted(places, np.arange(len(split)), "right")
    for k, own in enumerate(split):
        mine = rows[low[k] : high[k]] - [begins[k], 0, 0]
        if len(mine):
            own = [own[i] for i in np.flatnonzero(kept_words(len(own), mine)).tolist()]
        yield mine, b" ".join(own).decode("utf-8", "surrogatepass")


def collapse(
    docs: DataFrame, text_col: str = "text", times: int = TIMES, least: int = LEAST, name: str = "runs"
) -> DataFrame:
    """``docs`` with the runs of each text as an array named ``name`` (by start, then period) and the
    text, its words joined by one space, without what repeats. Rows stay where they are."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType()), T.StructField(name, T._parse_datatype_string(RUNS))])
    others = [f.name for f in kept]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col)
            for at, size in _slices(column):
                texts, lists = [], []
                for found, text in collapse_all(column.slice(at, size).to_pylist(), times, least):
                    lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()])
                    texts.append(text)
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in others], pa.array(texts, pa.string()), pa.array(lists, _RUNS)],
                    names=[*others, text_col, name],
                )

    return docs.select(*others, text_col).mapInArrow(compute, schema)


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts with a bounded number of bytes, or one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and held + size > 6 * _TOGETHER:
            yield at, i - at
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes) - at


def repeated(text: Column, doc_id: Column) -> Column:
    """The texts that op12 reads: those with crc32(doc_id) divisible by ten repeat a passage to their end."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    n = F.size(words)
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    passage = F.slice(words, a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(passage, times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)
