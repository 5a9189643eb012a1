"""The registered queries of the numbered operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.llm import html, lexical, lines, packing, periodic, pii, ppm, records, simhash, tiling, tokens, topk, toxicity, warc
from triage.llm.common import fold, ship, table, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and class of every document: 3-word shingles, links at 3 bits or fewer."""
    prints = simhash.fingerprints(table(spark, sf, "documents"), width=3)
    return simhash.classes(prints, max_diff=3).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op2_token_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids written as records and read back through the offset index."""
    index = records.write(table(spark, sf, "documents"), tokens.vocabulary_path())
    back = records.with_start(records.read(index, with_ids=False), index)
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op3_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best inner products for every twentieth vector."""
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


@query
def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    pieces = packing.pieces(table(spark, sf, "documents"), tokens.vocabulary_path())
    return packing.pack(pieces).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


@query
def op5_ppm_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Word and byte model scores of every document, learned from six of seven folds."""
    return ppm.score(table(spark, sf, "documents"), fold(F.col("doc_id"), 7) == 2)


@query
def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines that ten documents or more share."""
    docs = lines.dedup(texts(table(spark, sf, "documents")), min_docs=10, min_chars=1, report="lines")
    return docs.select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of every document."""
    found = pii.detect(texts(table(spark, sf, "documents")))
    counts = [pii.count(F.col("spans"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    base = F.sha2(pii.joined(pii.base_only(F.col("spans"))).cast("binary"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query
def op8_warc_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written as a record of a seekable bundle and read back."""
    index = warc.write(table(spark, sf, "pages"))
    return warc.read(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op9_string_tiling(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that hold a benchmark item, in whatever order of its passages."""
    docs = texts(table(spark, sf, "documents"))
    found = tiling.contamination(docs, table(spark, sf, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


@query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document, learned from four of five folds."""
    docs = texts(table(spark, sf, "documents"))
    held_out = fold(F.col("doc_id"), 5) == 0
    scored = toxicity.fit_and_score(docs, docs, table(spark, sf, "labels"), ~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


@query
def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten documents that score highest for every benchmark item."""
    found = lexical.top_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)
    return found.select("item_id", "rank", "doc_id", "score")


@query
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of every document's words, and its text without what they repeat."""
    docs = texts(table(spark, sf, "documents")).withColumn("text", periodic.repeated(F.col("text"), F.col("doc_id")))
    found = periodic.collapse(docs, name="runs")
    # the greatest exact quotient first: quotients are compared by cross products
    ahead = lambda a, b: (
        F.when(a["length"] * b["period"] != b["length"] * a["period"], F.sign(b["length"] * a["period"] - a["length"] * b["period"]))
        .when(a["start"] != b["start"], F.sign(a["start"] - b["start"]))
        .otherwise(F.sign(a["period"] - b["period"])).cast("int")
    )
    best = F.get(F.array_sort("runs", ahead), F.lit(0))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


@query
def op13_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
