"""Words are counted a bounded number at a time."""

import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from triage.functions.scale import freed_shuffles
from triage.functions.workers import ship
from triage.llm import common, ppm


def read(files):
    """(n, distinct) of the corpus and the counts that the files of all parts hold."""
    rows, held = files.collect(), {}
    for r in rows:
        with common.open_in(r.file) as f:
            data = f.read()
        counts, = ppm._load(data, "i8")
        held |= dict(zip(data[8 + counts.nbytes :].split(b"\n"), counts.tolist(), strict=True))
    return sum(r.n for r in rows), sum(r.distinct for r in rows), held


def test_few_words_at_a_time_give_the_same_counts(spark, monkeypatch):
    ship(spark)
    texts = [(p, f"a b w{i % 40} w{i % 7} x{i} {'only' if out else 'in'}", out) for p in (0, 1) for i in range(90) for out in [i % 5 == 0]]
    parts = spark.createDataFrame(texts, "part int, text string, held_out boolean").coalesce(1)
    whole = read(ppm.word_files(parts))
    assert whole[0] == 2 * 72 * 6 and whole[2][b"a"] == 144 and whole[2][b"only"] == 0
    monkeypatch.setattr(ppm, "_WORDS", 5)
    assert read(ppm.word_files(parts)) == whole


def test_a_word_reaches_its_part_in_one_row_and_is_ordered_once(spark, monkeypatch):
    ship(spark)
    texts = [(p, f"a w{i % 3} x{i}", False) for p in (0, 1) for i in range(30)]
    parts = spark.createDataFrame(texts, "part int, text string, held_out boolean").coalesce(1)
    monkeypatch.setattr(ppm, "_WORDS", 5)
    sent = []
    monkeypatch.setattr(ppm, "stage", lambda df, name: sent.append(df) or df)
    files = ppm.word_files(parts).collect()
    for r in files:
        with common.open_in(r.file) as f:
            data = f.read()
        words = data[8 + 8 * int.from_bytes(data[:8], "little") :].split(b"\n")
        assert len(words) == len(set(words)) == 34
    assert (sum(r.n for r in files), sum(r.distinct for r in files)) == (180, 34)
    plan = sent[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_keys_are_grouped_with_their_tags_in_one_sort():
    rng = np.random.default_rng(1)
    keys, tags = rng.integers(0, 1 << 48, 200, np.uint64)[rng.integers(0, 200, 5000)], rng.integers(0, 300, 5000)
    for order, more in ((5, 0), (5, 1 << 16), (6, 0)):
        distinct, first, held = ppm.grouped(keys, tags + more, order)
        want, at = np.unique(keys, return_inverse=True)
        assert (distinct == want).all() and (first == np.searchsorted(np.sort(keys), want)).all()
        assert (np.add.reduceat(held, first) == np.bincount(at, tags + more).astype(int)).all()


def test_a_part_reports_a_word_once_however_few_are_counted_at_a_time(spark, monkeypatch):
    ship(spark)
    texts = [(p, f"a b w{i % 40} x{i}", i % 5 == 0) for p in (0, 1) for i in range(90)]
    parts = spark.createDataFrame(texts, "part int, text string, held_out boolean").coalesce(1)
    monkeypatch.setattr(ppm, "_WORDS", 5)
    rows = ppm.count_words(parts).collect()
    assert len({(r.part, bytes(r.word)) for r in rows}) == len(rows) == 2 * (2 + 40 + 90)
    assert sum(r.n for r in rows) == 2 * 72 * 4
    monkeypatch.setattr(ppm, "_HELD_WORDS", 20)
    assert sum(r.n for r in ppm.count_words(parts).collect()) == 2 * 72 * 4


def test_a_query_takes_its_shuffle_files_with_it(spark, tmp_path):
    def files():
        blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(blocks.size()) if (f := blocks.apply(i).getName()).startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    outside, before = spark.conf.get(name, None), files()
    with freed_shuffles(spark):
        spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / "out"))
    end = time.time() + 20  # they go in the background
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(name, None) == outside


def test_merged_contexts_keep_their_counts():
    rng = np.random.default_rng(2)
    held = [(np.unique(rng.integers(0, 1 << 48, 300, np.uint64) % np.uint64(500)), n) for n in (3, 70_000)]
    held = [(k, np.full(len(k), n)) for k, n in held]
    keys, counts = ppm.merged(held, 5)
    want = Counter()
    for k, n in held:
        want.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    assert keys.tolist() == sorted(want) and counts.tolist() == [want[k] for k in keys.tolist()]
    empty = ppm.merged([(np.zeros(0, "u8"), np.zeros(0, "i8"))], 2)
    assert not len(empty[0]) and not len(empty[1])


def test_codes_are_read_back_in_order_from_a_smaller_file(spark):
    ship(spark)
    texts = [(0, " ".join(f"w{i * i % 997} and the" for i in range(j, j + 300)), False) for j in range(20)]
    parts = spark.createDataFrame(texts, "part int, text string, held_out boolean").coalesce(1)
    row, = ppm.code_files(parts).collect()
    keys, codes = ppm._codes(row.codes)
    assert (np.diff(keys.astype(np.int64)) > 0).all() and (codes < 0).all()
    with common.open_in(row.codes) as f:
        assert f.size() < 12 * len(keys)
