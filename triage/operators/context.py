"""Context: units of source text, token counts, packing into a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.functions.text import compressor as find_compressor
from triage.functions.text import count_tokens, let, line_range, split_lines
from triage.operators import packing

# Default budget, and the format of an assembled context and prompt.
TOKEN_BUDGET = 8000
UNIT_HEADER = "# File: "
SYMBOL_HEADER = " — Symbol: "
NO_FAILURE = "No structured failure info was provided."


def units(
    ranked: DataFrame, files: DataFrame, symbols: DataFrame, indexed: DataFrame | None = None
) -> DataFrame:
    """``failure_id, repo, path, symbol_name, rank, unit_rank, score``: what to fetch, without text.

    A ranked file with known symbols gives one unit per symbol found in the
    index, one without gives the whole file (``symbol_name`` NULL). Files without
    text drop out, and so do external modules. ``indexed`` names the files the
    index knows; a file outside it gives the whole file.
    """
    have = files.select("repo", "path").distinct()
    ranked = ranked.join(have, ["repo", "path"], "left_semi")
    keep = ["failure_id", "repo", "path", "rank", "score"]
    whole = F.size("relevant_symbols") == 0
    if indexed is not None:
        known = indexed.select("repo", "path", F.lit(True).alias("_known")).distinct()
        ranked = ranked.join(known, ["repo", "path"], "left")
        whole = whole | F.col("_known").isNull()
    files_ = ranked.where(whole).select(
        *keep, F.lit(None).cast("string").alias("symbol_name"), F.lit(0).alias("unit_rank")
    )
    wanted = ranked.where(~whole).select(
        *keep, F.posexplode("relevant_symbols").alias("unit_rank", "symbol_name")
    )
    exist = symbols.select("repo", "path", F.col("qualified_name").alias("symbol_name")).distinct()
    named = wanted.join(exist, ["repo", "path", "symbol_name"], "left_semi")
    return files_.unionByName(named)


def unit_texts(
    wanted: DataFrame,
    files: DataFrame,
    symbols: DataFrame,
    compressor: str | Callable[[Column], Column] = "rule_based",
    counter: Callable[[Column], Column] = count_tokens,
) -> DataFrame:
    """Text and token counts once per distinct unit, however many failures want it.

    ``repo, path, symbol_name, raw_text, compressed_text, raw_tokens, compressed_tokens``.
    Of symbols with the same qualified name the last one in the file wins.
    """
    parts = wanted.groupBy("repo", "path").agg(
        F.bool_or(F.col("symbol_name").isNull()).alias("_whole"),
        F.collect_set("symbol_name").alias("_names"),
    )
    ranges = symbols.groupBy("repo", "path", "qualified_name").agg(
        F.max_by(F.struct("start_line", "end_line"), "pos").alias("r")
    )
    lists = ranges.groupBy("repo", "path").agg(
        F.collect_list(F.struct(F.col("qualified_name").alias("name"), "r")).alias("_ranges")
    )
    joined = files.select("repo", "path", "content").join(parts, ["repo", "path"])
    joined = let(joined.join(lists, ["repo", "path"], "left"), _lines=split_lines("content"))
    no_name = F.lit(None).cast("string").alias("name")
    whole = F.when(
        F.col("_whole"), F.array(F.struct(no_name, F.col("content").alias("text")))
    ).otherwise(F.expr("cast(array() as array<struct<name:string,text:string>>)"))
    picked = F.filter(
        F.coalesce("_ranges", F.expr("cast(array() as array<struct<name:string,r:struct<start_line:int,end_line:int>>>)")),
        lambda s: F.array_contains(F.col("_names"), s["name"]),
    )
    texts = F.transform(
        picked,
        lambda s: F.struct(
            s["name"].alias("name"),
            line_range(F.col("_lines"), s["r"]["start_line"], s["r"]["end_line"]).alias("text"),
        ),
    )
    squeeze = find_compressor(compressor)
    raw = joined.select("repo", "path", F.explode(F.concat(whole, texts)).alias("u")).select(
        "repo", "path", F.col("u.name").alias("symbol_name"), F.col("u.text").alias("raw_text")
    )
    small = let(raw, compressed_text=squeeze(F.col("raw_text")))
    return small.withColumn("raw_tokens", counter(F.col("raw_text"))).withColumn(
        "compressed_tokens", counter(F.col("compressed_text"))
    )


def attach_counts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Token counts (not the texts) for every wanted unit."""
    t = texts.select(
        "repo", "path", F.col("symbol_name").alias("_name"), "raw_tokens", "compressed_tokens"
    )
    same = [wanted["repo"] == t["repo"], wanted["path"] == t["path"], wanted["symbol_name"].eqNullSafe(t["_name"])]
    return wanted.join(t, same).select(wanted["*"], "raw_tokens", "compressed_tokens")


def pack(
    units_: DataFrame,
    keys: list[str],
    order: list[str],
    budget: int = TOKEN_BUDGET,
    tokens: str = "compressed_tokens",
) -> DataFrame:
    """Rows of ``units_`` that fit the budget, taken greedily in order (``operators/packing.py``)."""
    return packing.pack(units_, keys, order, budget, tokens)


def assemble(packed: DataFrame, texts: DataFrame) -> DataFrame:
    """``failure_id, assembled_text`` of packed units.

    Only packed units meet their texts; the budget bounds the text one failure
    collects (units without tokens add their header line only). Headers are not
    charged to the budget.
    """
    t = texts.select("repo", "path", F.col("symbol_name").alias("_name"), "compressed_text")
    same = [packed["repo"] == t["repo"], packed["path"] == t["path"], packed["symbol_name"].eqNullSafe(t["_name"])]
    header = F.concat(
        F.lit(UNIT_HEADER), F.col("path"),
        F.when(F.coalesce("symbol_name", F.lit("")) != "", F.concat(F.lit(SYMBOL_HEADER), F.col("symbol_name"))).otherwise(""),
    )
    rows = packed.join(t, same).select(packed["*"], "compressed_text").select(
        "failure_id", "rank", "unit_rank", F.concat(header, F.lit("\n"), F.col("compressed_text")).alias("_text")
    )
    return rows.groupBy("failure_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", "unit_rank", "_text"))), lambda u: u["_text"]
            ),
            "\n\n",
        ).alias("assembled_text")
    )


def prompts(failures: DataFrame, contexts: DataFrame, description: Column | None = None) -> DataFrame:
    """``failure_id, prompt``: failure summary, assembled context and task.

    ``failures`` are parsed tracebacks (NULL exception allowed).
    """
    frame = F.try_element_at(F.col("frames"), F.lit(-1))
    raised = F.when(
        frame.isNotNull(),
        F.concat(F.lit("Raised at "), frame["file_path"], F.lit(":"), frame["line_number"].cast("string"),
                 F.lit(" in "), frame["function_name"]),
    )
    exception = F.when(
        F.col("exception_type").isNotNull(),
        F.concat(F.col("exception_type"), F.lit(": "), F.col("message")),
    )
    user = F.lit(None).cast("string") if description is None else F.nullif(description, F.lit(""))
    summary = F.concat_ws("\n", exception, raised, user)
    summary = F.when(summary == "", NO_FAILURE).otherwise(summary)
    text = F.coalesce("assembled_text", F.lit(""))
    return failures.join(contexts, "failure_id", "left").select(
        "failure_id",
        F.concat(
            F.lit("## Failure\n"), summary,
            F.lit("\n\n## Relevant code context\n"), text,
            F.lit("\n\n## Wanted\nThe cause of this failure, and a change that removes it."),
        ).alias("prompt"),
    )
