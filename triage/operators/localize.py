"""Localisation: from a failure to a ranked list of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from triage.functions.paths import relative_path
from triage.functions.scale import number_rows
from triage.operators import graph, tracebacks

# Weights of the signals and the separator of query texts.
ANCHOR_SCORE = 1.0
STRUCTURAL_SCORE = 0.6
SEMANTIC_WEIGHT = 0.5
QUERY_SEPARATOR = " — "
DEPTH = 2
TOP_FILES = 10

SIGNAL = T.StructType(
    [
        T.StructField("failure_id", T.LongType()),
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("contribution", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("hop", T.IntegerType()),
        T.StructField("symbol", T.StringType()),
    ]
)


# Sizes of line bins as powers of two: 32 lines to all of an int.
_BINS = (*range(5, 30, 3), 31)


def anchor_file(parsed: DataFrame, first_repo_frame: bool = False) -> DataFrame:
    """``failure_id, repo, path, line_number`` of the frame a failure is pinned to.

    Input: parsed tracebacks with ``failure_id, repo, repo_root``. Only the
    innermost frame is tried; ``first_repo_frame`` walks outwards to the first
    frame inside the repository. Failures without an anchor drop out. The
    file need not be indexed.
    """
    frames = F.col("frames")
    if first_repo_frame:
        inside = F.filter(
            frames, lambda f: relative_path(f["file_path"], F.col("repo_root")).isNotNull()
        )
        frame = F.try_element_at(inside, F.lit(-1))
    else:
        frame = tracebacks.innermost(frames)
    return (
        parsed.withColumn("_frame", frame)
        .select(
            "failure_id",
            "repo",
            relative_path(F.col("_frame.file_path"), F.col("repo_root")).alias("path"),
            F.col("_frame.line_number").alias("line_number"),
        )
        .where("path is not null")
    )


def anchor_symbol(anchors: DataFrame, symbol_table: DataFrame) -> DataFrame:
    """Add ``symbol``: the narrowest symbol whose line range holds the anchor line.

    Anchors are first reduced to distinct lines. A symbol stands in the smallest bin of lines that
    holds all of it (``_BINS`` sizes, each eight times the one before), so a line meets the symbols of
    one bin of each size, and the narrowest is a minimum that combines on the map side. Neither the
    symbols nor the anchors of a file come together in one row.
    """
    keys = ["repo", "path", "line_number"]
    start, end = F.col("start_line") - 1, F.col("end_line") - 1
    size = F.lit(_BINS[-1])
    for bits in reversed(_BINS[:-1]):
        size = F.when(F.shiftright(start, bits) == F.shiftright(end, bits), bits).otherwise(size)
    held = symbol_table.where(end >= start).select(
        "repo", "path", "start_line", "end_line", "pos", "qualified_name", size.alias("_bits"), start.alias("_at")
    ).withColumn("_bin", F.expr("shiftright(_at, _bits)"))
    spots = anchors.select(*keys).distinct().select(
        *keys, F.explode(F.array(*[F.lit(b) for b in _BINS])).alias("_bits")
    ).withColumn("_bin", F.expr("shiftright(line_number - 1, _bits)"))
    inside = (F.col("start_line") <= F.col("line_number")) & (F.col("end_line") >= F.col("line_number"))
    narrow = F.struct(F.col("end_line") - F.col("start_line"), "pos", F.col("qualified_name").alias("name"))
    hits = (
        spots.join(held, ["repo", "path", "_bits", "_bin"]).where(inside)
        .groupBy(*keys).agg(F.min(narrow)["name"].alias("symbol"))
    )
    return anchors.join(hits, keys, "left")


def query_text(description: Column | None = None) -> Column:
    """Search text: ``type: message`` and the user's description."""
    exception = F.when(
        F.col("exception_type").isNotNull(),
        F.concat(F.col("exception_type"), F.lit(": "), F.col("message")),
    )
    if description is None:
        return F.coalesce(exception, F.lit(""))
    return F.concat_ws(QUERY_SEPARATOR, exception, F.nullif(description, F.lit("")))


def with_query(failures: DataFrame, description: Column | None = None) -> DataFrame:
    """Add ``query``; blank queries drop out, they find nothing."""
    return failures.withColumn("query", query_text(description)).where(
        F.col("query").rlike(r"\S")
    )


def anchor_signals(anchors: DataFrame) -> DataFrame:
    """Signals of anchors (with or without ``symbol``)."""
    symbol = F.col("symbol") if "symbol" in anchors.columns else F.lit(None).cast("string")
    return anchors.select(
        "failure_id", "repo", "path",
        F.lit(ANCHOR_SCORE).alias("contribution"),
        F.lit("anchor").alias("source"),
        F.lit(0).alias("hop"),
        symbol.alias("symbol"),
    )


def structural_signals(
    anchors: DataFrame, edges: DataFrame, depth: int = DEPTH, drop_external: bool = False
) -> DataFrame:
    """Graph neighbours of each anchor.

    The graph is walked once per distinct anchor file; failures that share an
    anchor share the walk.
    """
    starts = anchors.select("repo", F.col("path").alias("start")).distinct()
    near = graph.neighborhood(edges, starts, depth, drop_external)
    return (
        anchors.select("failure_id", "repo", F.col("path").alias("start"))
        .join(near, ["repo", "start"])
        .select(
            "failure_id", "repo", "path",
            (F.lit(STRUCTURAL_SCORE) / F.col("hop")).alias("contribution"),
            F.lit("structural").alias("source"),
            "hop",
            F.lit(None).cast("string").alias("symbol"),
        )
    )


def semantic_signals(hits: DataFrame) -> DataFrame:
    """Signals of search hits ``failure_id, repo, path, qualified_name, score``.

    Each hit counts by itself: several chunks of a file add up, and a negative
    similarity lowers the score.
    """
    return hits.select(
        "failure_id", "repo", "path",
        (F.lit(SEMANTIC_WEIGHT) * F.col("score")).alias("contribution"),
        F.lit("semantic").alias("source"),
        F.lit(None).cast("int").alias("hop"),
        F.col("qualified_name").alias("symbol"),
    )


def score(*signals: DataFrame, digits: int = 9) -> DataFrame:
    """Sum the signals of each file: one shuffle, combined on the map side.

    ``score`` is rounded so that it does not depend on the order of the sum.
    """
    every = reduce(DataFrame.unionByName, signals)
    order = ("anchor", "structural", "semantic")
    present = F.collect_set("source")
    return every.groupBy("failure_id", "repo", "path").agg(
        F.round(F.sum("contribution"), digits).alias("score"),
        F.filter(
            F.array(*[F.lit(s) for s in order]), lambda s: F.array_contains(present, s)
        ).alias("sources"),
        F.sort_array(F.collect_set("symbol")).alias("relevant_symbols"),
        F.min("hop").alias("hop_distance"),
    )



def rank(scored: DataFrame) -> DataFrame:
    """Add ``rank`` by descending score, ties by path.

    A failure may rank any number of files (its anchor may be a hub), so the
    numbering splits large groups.
    """
    order = [F.col("score").desc(), F.col("path")]
    return number_rows(scored, ["failure_id"], order, "rank")


def top_files(scored: DataFrame, n: int = TOP_FILES) -> DataFrame:
    """The first ``n`` files of each failure, with ``rank``.

    Works on scored rows, so each map task keeps only ``n`` rows per failure.
    """
    over = W.partitionBy("failure_id").orderBy(F.col("score").desc(), "path")
    return scored.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= n)
