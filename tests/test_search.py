"""Search over cells against all pairs, and how many pairs it compares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from triage.operators import vectors as ve
from triage.operators.search import CellSearch


def plain(queries, chunks, k, metric, digits=6):
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    out = []
    for scope, qid, q in queries:
        scored = []
        for s, cid, c in chunks:
            if s == scope:
                a, b = np.array(q, float), np.array(c, float)
                score = unit(a) @ unit(b) if metric == "cosine" else 1 - ((a - b) ** 2).sum()
                scored.append((-round(float(score), digits) + 0.0, cid))
        out += [(scope, qid, cid, -s, r) for r, (s, cid) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("blocks", [(8192, 16384), (40, 30)])
def test_equals_all_pairs(spark, metric, blocks):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5))
    point = lambda: (centres[rng.integers(6)] + rng.normal(scale=0.1, size=5)).round(3).tolist()
    chunks = [(f"s{i % 3}", i, point()) for i in range(400)]
    chunks += [("s0", 1000 + i, chunks[0][2]) for i in range(150)]  # a third of a scope is one vector
    chunks += [("s1", 2000, [0.0] * 5), ("few", 2001, point()), ("few", 2002, point())]
    queries = [(s, i, v) for i, (s, _, v) in enumerate(chunks[::9])] + [("s1", 900, [0.0] * 5), ("few", 901, point()), ("none", 902, point())]
    q = spark.createDataFrame(queries, "repo string, query_id long, embedding array<double>")
    c = spark.createDataFrame(chunks, "repo string, chunk_id long, embedding array<double>").repartition(4)
    got = ve.top_k(q, c, 7, metric, scope=("repo",), chunk_block=blocks[0], query_block=blocks[1])
    rows = sorted((r.repo, r.query_id, r.chunk_id, r.score, r.rank) for r in got.collect())
    assert rows == plain(queries, chunks, 7, metric)


def compared(spark, n, metric):
    """Pairs that a search of n vectors among themselves compares, pivots included."""
    points = np.random.default_rng(n).normal(size=(n, 3)).tolist()
    df = spark.createDataFrame(list(enumerate(points)), "id long, v array<double>")
    search = CellSearch(
        df.select(F.col("id").alias("_qid"), F.col("v").alias("_qv")), df.select(F.col("id").alias("_cid"), F.col("v").alias("_cv")),
        5, metric, (), 6,
    )
    assert search.run().count() == 5 * n
    sizes = search.cells.select("_cell", "_n")
    pairs = sum(p.join(sizes, "_cell").agg(F.sum("_n")).first()[0] or 0 for p in search.probes)
    return pairs + n * search.cells.count()


def test_pairs_grow_far_slower_than_the_square(spark):
    small, large = compared(spark, 1000, "l2"), compared(spark, 4000, "l2")
    assert large < 4000**2 / 5 and large < 10 * small, (small, large)  # all pairs: 16 times


def test_a_block_of_term_counts_that_shares_nothing_is_left_out(spark):
    """Term vectors: cells whose greatest counts cannot reach the k-th score are not met."""
    texts = [(g * 100 + i, [float(i % 3 + 1) if d // 4 == g else 0.0 for d in range(64)]) for g in range(16) for i in range(60)]
    df = spark.createDataFrame(texts, "id long, v array<double>")
    q = df.where("id % 100 = 7").select(F.col("id").alias("_qid"), F.col("v").alias("_qv"))
    search = CellSearch(q, df.select(F.col("id").alias("_cid"), F.col("v").alias("_cv")), 5, "cosine", (), 6)
    found = search.run().collect()
    assert len(found) == 80 and all(r._cid // 100 == r._qid // 100 and r.score == 1.0 for r in found)
    met = sum(p.join(search.cells.select("_cell", "_n"), "_cell").agg(F.sum("_n")).first()[0] or 0 for p in search.probes)
    assert met <= 16 * 60 * 3  # of 16 * 960 pairs
