"""Language-model scores by prediction by partial matching over bytes.

A text is its words (lower-cased A-Z, parted at ASCII white space), each followed by a space or,
after the last, by the end mark. The trie holds for each context of up to ``order`` bytes which
bytes followed it how often in the training texts. A byte is coded in the longest known
context; if it never followed there, an escape is coded (method D: half a count per distinct
byte) and the next shorter context is tried, without the bytes already excluded by the longer
one. What no context knows is spread over the rest of the alphabet. The code length of a text is
the sum over its bytes; the trie is trained once and not changed while it scores.

Counts come from all training texts, and every counted node stays. The trie is dealt by the last
three bytes of the contexts: such a shard holds all nodes of these and of longer contexts, and the
nodes of shorter ones, of which the alphabet allows few, are read whole by each worker. Each part
of the documents sends its own distinct contexts to the shards and gets their code lengths back
as a file, so nothing that a worker holds is bounded by leaving nodes out. A shard of more than
``hot_rows`` rows (a frequent trigram, a long run of one byte) is coded from its distinct contexts
instead, dealt by one more byte; such a group is bounded by the alphabet, the few nodes of its shortest
context go along with each, and the codes are joined to what the parts asked. With ``depth`` given, a
node stays only if it has at least the ``2**-depth`` part of all counts; the counts of dropped
nodes are kept as escape mass of their context.

Beside it stands the word model with one added count per word. Its table has a row for each
distinct word of the corpus and stays distributed: a part of the documents gets the counts of
its own words, from a file per part, so neither words nor texts are joined row by row.

Defined cases: a null text is an empty one: only the end mark; a null id belongs to the training
texts; without training texts every byte is spread over the alphabet and no word is known;
rows that repeat an id are texts of their own.
"""

from __future__ import annotations

import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import ExitStack
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from triage.functions.scale import broadcast_if_small, freed_shuffles, stage, stage_path, unstage
from triage.llm import common
from triage.llm.simhash import whole_groups

ORDER = 5
LOW = 3  # orders below stand in files for all workers
ALPHABET = 252  # 256 bytes without four that only part words
END = b"\n"
DISCOUNT = 0.5
HOT_ROWS = 500_000
_CHUNK = 1 << 19  # bytes coded at a time
_HELD = 1_500_000  # distinct contexts held before they are put together
_CODED = 250_000  # contexts of parts coded at a time
_WORDS = 200_000  # distinct words of parts counted at a time
_HELD_WORDS = 1_500_000  # words with their counts held before they are put together
_CODES = pa.schema([("key", pa.uint64()), ("code", pa.float64())])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(common.ASCII_LOWER).split()


# --- contexts ----------------------------------------------------------------------


def contexts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, the ``order`` bytes before it and itself as one number; and the
    number of bytes of each text. Before a text stand end marks."""
    lead = END * order
    data = np.frombuffer(b"".join([lead + t for t in texts]), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    keys = np.zeros(len(data) - order, dtype=np.uint64)
    for k in range(order + 1):
        keys = (keys << np.uint64(8)) | data[k : len(data) - order + k]
    mine = np.ones(len(data), dtype=bool)
    starts = np.cumsum(sizes + order) - sizes - order
    for k in range(order):
        mine[starts + k] = False
    return keys[mine[order:]], sizes


def chunks(rows: Iterator[tuple], size: int = _CHUNK) -> Iterator[tuple[list, list[bytes]]]:
    """(other values, words with spaces and end mark) of rows (..., words), about ``size`` bytes at a time."""
    rest, texts, n = [], [], 0
    for *other, words in rows:
        rest.append(other)
        texts.append(b" ".join(words) + END)
        n += len(texts[-1])
        if n >= size:
            yield rest, texts
            rest, texts, n = [], [], 0
    if texts:
        yield rest, texts


def shorter(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The same counts with contexts of ``order`` bytes."""
    cut = keys & np.uint64((1 << 8 * (order + 1)) - 1)
    out, at = np.unique(cut, return_inverse=True)
    return out, np.bincount(at, counts, len(out)).astype(np.int64)


def grouped(keys: np.ndarray, tags: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the first place of each among the sorted keys, and the tags in that order.

    A key of up to six bytes and a tag below 2^16 are sorted as one number, several times faster than an argsort.
    """
    if order <= 5 and (not len(tags) or tags.max() < 1 << 16):
        both = np.sort(keys << np.uint64(16) | tags.astype(np.uint64))
        keys, tags = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
    else:
        at = np.argsort(keys, kind="stable")
        keys, tags = keys[at], tags[at].astype(np.int64)
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[first], first, tags


def merged(held: list[tuple[np.ndarray, np.ndarray]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of several (keys, counts) of contexts of ``order`` bytes as one."""
    keys, first, counts = grouped(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]), order)
    return keys, np.add.reduceat(counts, first) if len(first) else counts


# --- the trie ----------------------------------------------------------------------


class Level:
    """Contexts of one order: which bytes follow how often, and what an escape leaves."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, contexts_: np.ndarray, totals: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].astype(np.float64)
        order = np.argsort(contexts_)
        contexts_, totals = contexts_[order], totals[order]
        self.contexts, first = np.unique(self.keys >> np.uint64(8), return_index=True)
        self.totals = totals[np.searchsorted(contexts_, self.contexts)].astype(np.float64)
        self.first = first
        self.kept = np.add.reduceat(self.counts, first) if len(first) else np.zeros(0)
        self.distinct = np.diff(np.append(first, len(self.keys))).astype(np.float64)
        self.excluded = np.zeros(len(first))  # counts that the bytes seen here have one order below

    def below(self, level: Level, order: int) -> None:
        if len(self.keys):
            at = np.searchsorted(level.keys, self.keys & np.uint64((1 << 8 * order) - 1))
            self.excluded = np.add.reduceat(level.counts[at], self.first)


class Trie:
    def __init__(self, levels: list[Level]):
        self.levels = levels
        for order in range(1, len(levels)):
            levels[order].below(levels[order - 1], order)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each key after the bytes before it."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        gone, gone_distinct = np.zeros(len(keys)), np.zeros(len(keys))  # excluded by the longer context
        for order in range(len(self.levels) - 1, -1, -1):
            level = self.levels[order]
            if not len(level.keys) or not len(todo):
                continue
            key = keys[todo] & np.uint64((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(level.contexts, key >> np.uint64(8)), len(level.contexts) - 1)
            known = level.contexts[at] == key >> np.uint64(8)
            place = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            hit = (level.keys[place] == key) & known
            total = level.totals[at] - gone[todo]
            left = level.distinct[at] - gone_distinct[todo]
            escape = level.totals[at] - level.kept[at] + DISCOUNT * left
            out[todo[hit]] += np.log10((level.counts[place[hit]] - DISCOUNT) / total[hit])
            away = known & ~hit & (total > 0)
            out[todo[away]] += np.log10(np.maximum(escape[away], 1e-12) / total[away])
            on = known & ~hit
            gone[todo[on]], gone_distinct[todo[on]] = level.excluded[at[on]], level.distinct[at[on]]
            todo = todo[~hit]
        if len(todo):
            seen = self.levels[0].distinct[0] if len(self.levels[0].distinct) else 0
            out[todo] -= np.log10(max(1, ALPHABET - seen))
        return out


def _dump(*arrays: np.ndarray) -> bytes:
    return b"".join([struct.pack("<Q", len(a)) + np.ascontiguousarray(a).tobytes() for a in arrays])


def _load(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n, = struct.unpack_from("<Q", data, at)
        out.append(np.frombuffer(data, kind, n, at + 8))
        at += 8 + out[-1].nbytes
    return out


def level(keys: np.ndarray, counts: np.ndarray, least: float) -> Level:
    """The level of all counts of one order; nodes counted less than ``least`` are escape mass."""
    contexts_, at = np.unique(keys >> np.uint64(8), return_inverse=True)
    keep = counts >= least
    return Level(keys[keep], counts[keep], contexts_, np.bincount(at, counts, len(contexts_)))


@common.worker_store
def _low_levels(files: tuple[str, ...], base: int, least: float) -> list[Level]:
    """The levels of the orders below ``base`` from files of the counts of the last of them."""
    held = [(np.zeros(0, "u8"), np.zeros(0, "i8"))]
    for name in files:
        with common.open_in(name) as f:
            held.append(tuple(_load(f.read(), "u8", "i8")))
    keys, counts = merged(held, base - 1)
    levels = []
    for order in range(base - 1, -1, -1):
        if order < base - 1:
            keys, counts = shorter(keys, counts, order)
        levels.append(level(keys, counts, least))
    return levels[::-1]


def count_contexts(parts: DataFrame, order: int) -> DataFrame:
    """(part, key, n): the contexts of each part of (part, text, held_out), and how often its
    training texts have them; a part may report a context in several rows."""
    schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def emit(part: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 100_000):
            k, n = keys[at : at + 100_000], counts[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), part, np.int32)), pa.array(k.view(np.int64)), pa.array(n)], schema=schema
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in groupby(common.rows(batches, "part", "text", "held_out"), lambda r: r[0]):
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for out, texts in chunks((held_out, words_of(t)) for _, t, held_out in own):
                keys, sizes = contexts(texts, order)
                learned = np.repeat([not x for x, in out], sizes)
                distinct, first, learned = grouped(keys, learned, order)
                held.append((distinct, np.add.reduceat(learned, first)))
                if sum(len(k) for k, _ in held) > _HELD:
                    held = [merged(held, order)]
                    if len(held[0][0]) > _HELD // 2:
                        yield from emit(part, *held[0])
                        held = []
            if held:
                yield from emit(part, *merged(held, order))

    return parts.select("part", "text", "held_out").mapInArrow(count, "part int, key long, n long")


def code_files(parts: DataFrame, order: int = ORDER, depth: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(part, codes): for each part a file with its contexts in order and the log10 probability of each."""
    spark = parts.sparkSession
    counts = stage(count_contexts(parts, order), "contexts")
    base = min(order, LOW)
    folder = stage_path(spark, "codes")

    def write_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if tables:
            table = pa.concat_tables(tables)
            name = f"{folder}/low-{uuid.uuid4().hex}.counts"
            with common.open_out(name) as f:
                f.write(_dump(table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()))
            n = int(table.column("n").to_numpy().sum())
            yield pa.RecordBatch.from_pydict({"file": [name], "n": [n]})

    low = counts.where("n > 0").groupBy(F.col("key").bitwiseAND((1 << 8 * max(base, 1)) - 1).alias("key"))
    made = low.agg(F.sum("n").alias("n")).mapInArrow(write_low, "file string, n long").collect()
    files = tuple(sorted(r["file"] for r in made)) if base else ()
    least = 1.0 if depth is None else max(1.0, sum(r["n"] for r in made) / 2.0**depth)
    schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("code", pa.float64())])

    def trie(held: tuple[np.ndarray, np.ndarray], base_nodes: tuple[np.ndarray, np.ndarray] | None = None) -> Trie:
        """All levels from the nodes of the longest contexts; those of order ``base`` may be given."""
        levels = []
        for k in range(order, base - 1, -1):
            if k < order:
                held = base_nodes if k == base and base_nodes else shorter(*held, k)
            levels.append(level(*held, least))
        return Trie([*_low_levels(files, base, least), *levels[::-1]])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["shard"], _CODED):
            part, n = table.column("part").to_numpy(), table.column("n").to_numpy()
            distinct, at = np.unique(table.column("key").to_numpy().view(np.uint64), return_inverse=True)
            counted = np.bincount(at, n, len(distinct)).astype(np.int64)
            codes = trie((distinct[counted > 0], counted[counted > 0])).log10(distinct)
            for x in range(0, len(part), 100_000):
                own = at[x : x + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[x : x + 100_000]), pa.array(distinct[own].view(np.int64)), pa.array(codes[own])],
                    schema=schema,
                )

    def code_distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["fine"], _CODED):
            key, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
            shared = table.column("shared").to_numpy().astype(bool)
            nodes, first = np.unique(key[shared], return_index=True)  # each fine shard brings them
            own, counted = key[~shared], n[~shared]
            codes = trie((own[counted > 0], counted[counted > 0]), (nodes, n[shared][first])).log10(own)
            for x in range(0, len(own), 100_000):
                part = own[x : x + 100_000].view(np.int64), codes[x : x + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], names=["key", "code"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, ExitStack()
        for batch in batches:
            parts_ = batch.column("part").to_numpy()
            key, coded_ = batch.column("key").to_numpy().view(np.uint64), batch.column("code")
            for own in np.split(np.arange(len(parts_)), np.flatnonzero(np.diff(parts_)) + 1):
                if not len(own):
                    continue
                if parts_[own[0]] != part:
                    stack.close()
                    part = parts_[own[0]]
                    name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.codes"
                    f = stack.enter_context(common.open_out(name))
                    out = stack.enter_context(pa.ipc.new_stream(f, _CODES, options=pa.ipc.IpcWriteOptions(compression="zstd")))
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "codes": [name]})
                out.write(pa.record_batch([pa.array(key[own]), coded_.slice(own[0], len(own))], schema=_CODES))
        stack.close()

    # a shard holds all nodes of the contexts that end in its bytes
    tail = lambda n: F.shiftrightunsigned("key", 8).bitwiseAND((1 << 8 * n) - 1)
    asked = counts.withColumn("shard", tail(base))
    hot = stage(asked.groupBy("shard").count().where(F.col("count") > hot_rows).select("shard"), "hot-shards")
    split = not hot.isEmpty()
    cold = asked.join(broadcast_if_small(hot), "shard", "left_anti") if split else asked
    dealt = cold.repartition("shard").sortWithinPartitions("shard")
    coded = dealt.mapInArrow(code, "part int, key long, code double")
    if split:
        asked = asked.join(broadcast_if_small(hot), "shard", "left_semi")
        nodes = stage(asked.groupBy("shard", "key").agg(F.sum("n").alias("n")), "hot-nodes")
        fine = nodes.withColumn("fine", tail(min(base + 1, order)))
        short = F.col("key").bitwiseAND((1 << 8 * (base + 1)) - 1).alias("key")
        shared = nodes.where("n > 0").groupBy("shard", short).agg(F.sum("n").alias("n"))
        shared = fine.select("shard", "fine").distinct().join(shared, "shard").withColumn("shared", F.lit(1))
        wanted = ["fine", "key", "n", "shared"]
        rows = fine.withColumn("shared", F.lit(0)).select(*wanted).unionByName(shared.select(*wanted))
        rows = rows.repartition("fine").sortWithinPartitions("fine")
        codes = rows.mapInArrow(code_distinct, "key long, code double")
        coded = coded.unionByName(asked.join(codes, "key").select("part", "key", "code"))
    coded = coded.repartition("part").sortWithinPartitions("part", "key")
    files_of_parts = stage(coded.mapInArrow(write, "part int, codes string"), "code-files")
    unstage(counts)
    return files_of_parts


@common.worker_store
def _codes(file: str) -> tuple[np.ndarray, np.ndarray]:
    with common.open_in(file) as f, pa.ipc.open_stream(f) as rows:
        table = rows.read_all()
    return table.column("key").to_numpy(), table.column("code").to_numpy()


# --- words -------------------------------------------------------------------------


def count_words(parts: DataFrame) -> DataFrame:
    """(part, word, n): the words of each part of (part, text, held_out), and how often its training
    texts have them. A part reports a word once, or once for every ``_HELD_WORDS // 2`` distinct ones."""
    schema = pa.schema([("part", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])

    def told(learned: Counter[bytes], other: set[bytes]) -> pa.Table:
        words = [*learned, *(w for w in other if w not in learned)]
        counts = np.zeros(len(words), np.int64)
        counts[: len(learned)] = np.fromiter(learned.values(), np.int64, len(learned))
        learned.clear()
        other.clear()
        return pa.table([pa.array(words, pa.binary()), pa.array(counts)], ["word", "n"])

    def as_one(held: list[pa.Table]) -> pa.Table:
        if len(held) == 1:
            return held[0]
        table = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return table.rename_columns({"n_sum": "n"}).select(["word", "n"])

    def emit(part: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in table.to_batches(20_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), *batch.columns], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what coding left in this worker
        for part, own in groupby(common.rows(batches, "part", "text", "held_out"), lambda r: r[0]):
            learned, other, held = Counter(), set(), []

            for _, text, held_out in own:
                (other if held_out else learned).update(words_of(text))
                if len(learned) + len(other) > _WORDS:
                    held.append(told(learned, other))
                    if sum(t.num_rows for t in held) > _HELD_WORDS:
                        held = [as_one(held)]
                        if held[0].num_rows > _HELD_WORDS // 2:
                            yield from emit(part, held[0])
                            held = []
            if learned or other:
                held.append(told(learned, other))
            if held:
                yield from emit(part, as_one(held))

    return parts.mapInArrow(count, "part int, word binary, n long")


def word_files(parts: DataFrame) -> DataFrame:
    """(part, file, n, distinct): for each part a file with its words and their counts in the whole
    training corpus; n and distinct add up to the corpus's words and distinct words.

    ``parts`` is (part, text, held_out). The rows of one word are about the number of parts.
    """
    spark, one = parts.sparkSession, count_words(parts)
    # one order serves both values; the splits of a part that report the same word go on as one row
    by_word = W.partitionBy("word").orderBy("part")
    counted = one.select(
        "part", "word", F.sum("n").over(by_word.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
        F.lag("part").over(by_word).alias("_before"),
    ).where("_before is null or _before <> part")
    first = F.col("_before").isNull()
    folder = stage_path(spark, "words")

    def write(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.words"
        counts, first = table.column("total").to_numpy(), table.column("first").to_numpy()
        with common.open_out(name) as f:
            f.write(_dump(counts) + b"\n".join(table.column("word").to_pylist()))
        # a word counts for the corpus in the first part that reports it
        n, distinct = int(counts[first].sum()), int((counts[first] > 0).sum())
        return pa.table({"part": pa.array([part], pa.int32()), "file": [name], "n": [n], "distinct": [distinct]})

    rows = counted.select("part", "word", "total", first.alias("first"))
    return stage(rows.groupBy("part").applyInArrow(write, "part int, file string, n long, distinct long"), "word-files")


@common.worker_store
def _word_logs(file: str | None) -> dict[bytes, float]:
    """log10(count + 1) of the words of a part; 0 for a word that the training corpus lacks.
    A part without words has no file."""
    if file is None:
        return {}
    with common.open_in(file) as f:
        data = f.read()
    counts, = _load(data, "i8")
    words = data[8 + counts.nbytes :].split(b"\n") if len(counts) else []
    return dict(zip(words, np.log10(counts + 1.0).tolist(), strict=True))


# --- scores ------------------------------------------------------------------------


def score(
    docs: DataFrame, held_out: Column, order: int = ORDER, depth: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``held_out`` is a condition on doc_id; all other documents train both models.
    """
    plain = common.texts(docs).withColumn("held_out", held_out).withColumn("part", F.spark_partition_id())
    parts = stage(plain, "parts")
    with freed_shuffles(docs.sparkSession):
        codes = code_files(parts, order, depth, hot_rows)
        words = word_files(parts.select("part", "text", "held_out"))
        sums = words.agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct")).first()
    ends = parts.where(~F.col("held_out")).count()
    n_train, n_distinct = (sums["n"] or 0) + ends, (sums["distinct"] or 0) + (ends > 0)
    log_end, log_all = float(np.log10(ends + 1)), float(np.log10(n_train + n_distinct + 1))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "doc_id", "held_out", "text", "file", "codes"
        for (file, codes_file), part in groupby(common.rows(batches, *names), lambda r: r[3:]):
            get, (known_keys, code) = _word_logs(file), _codes(codes_file)

            def rows(part: Iterator[tuple] = part, get: dict[bytes, float] = get) -> Iterator[tuple]:
                for doc_id, out, text, *_ in part:
                    own = words_of(text)
                    logs = list(map(get.__getitem__, own))
                    known = len(logs) - logs.count(0.0) + (ends > 0)
                    base = sum(logs) + log_end - (len(own) + 1) * log_all
                    yield doc_id, out, len(own) + 1, known, n_train, base, own

            for other, texts in chunks(rows()):
                keys, sizes = contexts(texts, order)
                distinct, first, at = grouped(keys, np.repeat(np.arange(len(texts)), sizes), order)
                each = np.repeat(code[np.searchsorted(known_keys, distinct)], np.diff(first, append=len(at)))
                scores = np.bincount(at, each, len(texts)).tolist()
                yield common.to_batch([(*o, s) for o, s in zip(other, scores, strict=True)], schema)

    # one row per part: the broadcasts are bounded by the number of parts
    named = parts.join(F.broadcast(codes), "part").join(F.broadcast(words.select("part", "file")), "part", "left")
    return named.select("doc_id", "held_out", "text", "file", "codes").mapInArrow(
        rate,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
