"""A training corpus from raw documents: five of the numbered operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
before the next one. All but the last return the columns of ``documents``; null ids and texts
pass through every stage, a null text counting as an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.functions.scale import stage, stage_path
from triage.llm import lines, packing, simhash, tiling, tokens, toxicity
from triage.llm.common import fold, ship, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(fn: Stage) -> Stage:
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row number under a name that no column has."""
    name = f"_row_{uuid.uuid4().hex[:8]}"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5. The model learns as in op10: from labelled
    documents of four of five folds, all of them of the given documents."""
    labels = table(spark, sf_dir, "labels")
    score = f"_score_{uuid.uuid4().hex[:8]}"
    scored = toxicity.fit_and_score(docs, docs, labels, fold(F.col("doc_id"), 5) != 0, name=score)
    return scored.where(F.col(score) < 0.5).drop(score)


@_stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars follows the text."""
    out = lines.dedup(docs, min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies as in op1: fingerprints over shingles of three words,
    linked at three differing bits or fewer. The smallest id stays (a null id is the greatest)."""
    kept, row = _marked(docs)
    kept = stage(kept, "numbered-docs")
    # fingerprints go under row numbers, since ids may repeat
    prints = simhash.fingerprints(kept.select(F.col(row).alias("doc_id"), "text"), width=3)
    found = simhash.classes(prints, max_diff=3).select(F.col("doc_id").alias(row), "component_id")
    known = found.join(kept.select(row, "doc_id"), row)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = known.groupBy("component_id").agg(F.min(order).alias("first"))
    return kept.join(first.select(F.col(f"first.{row}").alias(row)), row, "left_semi").select(*docs.columns)


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    hits = f"_hits_{uuid.uuid4().hex[:8]}"
    found = tiling.contamination(docs, table(spark, sf_dir, "benchmark"), name=hits)
    return found.where(F.size(hits) == 0).drop(hits)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents in sequences of at most 1024 tokens: one row per piece, as in op4."""
    return packing.pack(packing.pieces(docs, tokens.vocabulary_path())).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("best_fit_packing", pack),
]

# The fitted toxicity model, the fingerprints and the vocabulary have no SQL; tests/llm compares
# every stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = stage_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
