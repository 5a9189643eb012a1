"""The operators put together: from file snapshots and logs to contexts and prompts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.functions.scale import stage
from triage.functions.text import count_tokens
from triage.operators import context, files, graph, imports, localize, symbols, tracebacks, vectors


@dataclass(frozen=True)
class Index:
    """Tables of one indexing job; all of them carry ``repo``."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame


def index(snapshot: DataFrame, rules: bool = True) -> Index:
    """Index ``snapshot(repo, commit_sha, path, length, content)``, one commit per repository."""
    kept = files.keep_source_files(snapshot)
    if rules:
        kept = files.apply_ignore_rules(kept, files.ignore_rules(kept))
    return index_sources(files.index_files(kept))


def index_sources(indexed: DataFrame) -> Index:
    """Extract symbols and edges and write both: every later step reads the tables."""
    found = imports.resolve(imports.parse(imports.extract(indexed)), indexed)
    return Index(
        indexed, stage(symbols.extract(indexed), "symbols"), stage(graph.build_edges(found), "edges")
    )


def search(
    failures: DataFrame,
    chunks: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    provider: str | Callable[[Column], Column] = "hashed_terms",
    description: Column | None = None,
) -> DataFrame:
    """Search hits of each failure among the chunks of its repository.

    Failures with the same text in the same repository are one query.
    """
    asked = stage(localize.with_query(failures, description).select("failure_id", "repo", "query"), "asked")
    texts = asked.select("repo", "query").distinct()
    queries = vectors.embed(texts, "query", provider)
    hits = vectors.top_k(queries, chunks, k, metric, scope=("repo",), query_id="query")
    named = hits.join(chunks.select("repo", "chunk_id", "path", "qualified_name"), ["repo", "chunk_id"])
    return asked.join(named, ["repo", "query"])


def localise(
    failures: DataFrame, index_: Index, hits: DataFrame | None = None, depth: int = localize.DEPTH
) -> DataFrame:
    """Scored files of every failure from its anchor, the graph and search hits."""
    found = stage(localize.anchor_file(failures), "anchors")
    anchors = stage(localize.anchor_symbol(found, index_.symbols), "anchors")
    signals = [
        localize.anchor_signals(anchors),
        localize.structural_signals(anchors, index_.edges, depth),
    ]
    if hits is not None:
        signals.append(localize.semantic_signals(hits))
    return localize.score(*signals)


def contexts(
    ranked: DataFrame,
    index_: Index,
    budget: int = context.TOKEN_BUDGET,
    compressor: str | Callable[[Column], Column] = "rule_based",
    counter: Callable[[Column], Column] = count_tokens,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all units with counts, packed units, assembled texts) of ranked files."""
    wanted = context.units(ranked, index_.files, index_.symbols)
    wanted = stage(wanted, "wanted")
    texts = stage(
        context.unit_texts(wanted, index_.files, index_.symbols, compressor, counter), "unit-texts"
    )
    counted = context.attach_counts(wanted, texts)
    packed = context.pack(counted, ["failure_id"], ["rank", "unit_rank"], budget)
    return counted, packed, context.assemble(packed, texts)


def parse_failures(logs: DataFrame) -> DataFrame:
    """Parsed tracebacks of ``logs(failure_id, repo, repo_root, text)``."""
    return tracebacks.parse(logs).drop("text")


def joined(column: Column | str, by: str = "|") -> Column:
    """Array as text, for flat reports."""
    return F.array_join(column, by)
