"""The byte model keeps every counted context, however large the training corpus."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from test_ppm_toxicity import Plain, coded
from triage.llm import ppm


class Weighted(Plain):
    """The same without a least count, for texts that repeat."""

    def __init__(self, texts, order):
        self.order = order
        counts = [defaultdict(Counter) for _ in range(order + 1)]
        for t, times in texts.items():
            data = b"\n" * order + coded(t)
            for i in range(order, len(data)):
                for k in range(order + 1):
                    counts[k][data[i - k : i]][data[i]] += times
        self.total = [{c: sum(n.values()) for c, n in own.items()} for own in counts]
        self.kept = counts


def test_rare_contexts_stay_in_a_large_corpus(spark):
    common_text = " ".join(f"word{i}" for i in range(1000))
    times = 1400
    rare = ["a quixotic zephyr", "jumbled", "Übergröße voxel", None]
    texts = [common_text] * times + rare
    rows = [*enumerate(texts), (-1, "quixotic voxels jumble words"), (-2, "zephyr\x7f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert times * len(coded(common_text)) > 2**23
    got = {r.doc_id: r.score for r in ppm.score(docs, F.col("doc_id") < 0).collect()}
    model = Weighted(Counter(texts), 5)
    assert len(got) == len(rows)
    for i, t in [*rows[-6:], rows[0]]:
        assert abs(got[i] - model.score(t)) < 1e-6


def test_parts_without_words_keep_their_rows(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string").coalesce(1)
    docs = docs.union(spark.createDataFrame([(2, ""), (3, None)], "doc_id long, text string").coalesce(1))
    assert {r.doc_id for r in ppm.score(docs, F.lit(False)).collect()} == {1, 2, 3}


def test_hot_contexts_are_split(spark):
    rows = [(i, "a" * 60 + f" the theme then {i} " + "ab" * (i % 7)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "zzz"), (103, "the the the"), (104, "é" * 9), (105, "a" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held_out = F.col("doc_id") % 5 == 2
    train = Counter(t for i, t in rows if i % 5 != 2)
    for order in (5, 4, 3, 2, 0):
        model = Weighted(train, order)
        # 0: every shard is split; 12: some are
        for hot_rows in (0, 12) if order == 5 else (3,):
            got = {r.doc_id: r.score for r in ppm.score(docs, held_out, order, hot_rows=hot_rows).collect()}
            assert len(got) == len(rows)
            for i, t in rows:
                assert abs(got[i] - model.score(t)) < 1e-6, (order, hot_rows, i)
