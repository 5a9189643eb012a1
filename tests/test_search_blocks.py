"""Vectors that travel: once per block and query at most, whatever the number of cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from triage.operators import search as se


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_no_row_with_a_vector_per_query_and_cell(spark, monkeypatch, metric):
    """Without clusters every query meets nearly every cell; its vector must not be written for each."""
    held, plain = [], se.stage

    def stage(df, name="stage"):
        out = plain(df, name)
        if "_qv" in out.columns:
            held.append((name, out.count()))
        return out

    monkeypatch.setattr(se, "stage", stage)
    points = np.random.default_rng(5).normal(size=(600, 24)).round(3).tolist()
    df = spark.createDataFrame(list(enumerate(points)), "id long, v array<double>")
    q, c = df.select(F.col("id").alias("_qid"), F.col("v").alias("_qv")), df.select(F.col("id").alias("_cid"), F.col("v").alias("_cv"))
    found = se.CellSearch(q, c, 4, metric, (), 6, chunk_block=250, query_block=100).run()
    got = {(r._qid, r["rank"]): r._cid for r in found.collect()}
    m = np.array(points)
    if metric == "cosine":
        m = m / np.linalg.norm(m, axis=1)[:, None]
    score = m @ m.T if metric == "cosine" else 1 - ((m[:, None] - m[None]) ** 2).sum(axis=2)
    best = np.lexsort((np.broadcast_to(np.arange(600), (600, 600)), -score.round(6)))[:, :4]
    assert got == {(i, r + 1): best[i, r] for i in range(600) for r in range(4)}
    assert held and all(n <= 600 for _, n in held), held
