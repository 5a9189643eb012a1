"""Vectors: embedding, upsert and exact top-k search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from triage.functions.vectors import embedder
from triage.operators.chunks import build_chunks
from triage.operators.search import CHUNK_BLOCK, QUERY_BLOCK, CellSearch
from triage.sources.tables import unprocessed

METRICS = ("cosine", "l2")


def embed(
    df: DataFrame,
    text: str = "embedding_text",
    provider: str | Callable[[Column], Column] = "hashed_terms",
    name: str = "embedding",
) -> DataFrame:
    return df.withColumn(name, embedder(provider)(F.col(text)))


def upsert(store: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("repo", "chunk_id"), version: str = "version") -> DataFrame:
    """Insert or replace by key; the highest version wins.

    ``row_number() = 1`` is a limit per key, so each map task sends on at most
    one row of a key however often it was rewritten.
    """
    newest = W.partitionBy(*keys).orderBy(F.col(version).desc())
    return (
        store.unionByName(new)
        .withColumn("_rn", F.row_number().over(newest))
        .where("_rn = 1")
        .drop("_rn")
    )


def index(
    files: DataFrame,
    symbols: DataFrame,
    done: DataFrame | None = None,
    provider: str | Callable[[Column], Column] = "hashed_terms",
) -> DataFrame:
    """Chunks with vectors for all files, or only for those not in ``done``."""
    todo = files if done is None else unprocessed(files, done)
    return embed(build_chunks(todo, symbols), provider=provider)


def top_k(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    scope: tuple[str, ...] = (),
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    digits: int = 6,
    chunk_block: int = CHUNK_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact search: the ``k`` best chunks of every query inside its scope.

    ``scope, query_id, chunk_id, score, rank``. ``cosine`` is the inner product
    of normalised vectors, ``l2`` is 1 - squared distance. Scores are rounded
    to ``digits`` before ranking, ties go to the smaller chunk id, and fewer than
    ``k`` chunks give fewer rows.

    Only cells whose bound reaches a query's k-th score are compared (``operators/search.py``).
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")
    if k < 1:
        raise ValueError("k must be positive")
    q = queries.select(*scope, F.col(query_id).alias("_qid"), F.col(vector).alias("_qv")).where(F.col(vector).isNotNull())
    c = chunks.select(*scope, F.col(chunk_id).alias("_cid"), F.col(vector).alias("_cv")).where(F.col(vector).isNotNull())
    found = CellSearch(q, c, k, metric, scope, digits, chunk_block, query_block).run()
    return found.select(*scope, F.col("_qid").alias(query_id), F.col("_cid").alias(chunk_id), "score", "rank")
