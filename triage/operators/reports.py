"""Test reports: failing tests and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.operators import tracebacks

# Outcomes that count as a failure.
FAILING = ("failed", "error")


def is_failing(outcome: Column) -> Column:
    """A test without an outcome counts as passed."""
    return F.coalesce(outcome, F.lit("passed")).isin(*FAILING)


def file_of(node_id: Column) -> Column:
    return F.substring_index(node_id, "::", 1)


def failures(reports: DataFrame) -> DataFrame:
    """One row per failing test of ``reports(run_id, tests)``.

    The phase is ``call``, else ``setup``; teardown is never looked at.
    """
    t = F.col("t")
    phase = F.coalesce(t["call"], t["setup"])
    return (
        reports.select("run_id", F.explode("tests").alias("t"))
        .where(is_failing(t["outcome"]))
        .select(
            "run_id",
            F.coalesce(t["nodeid"], F.lit("")).alias("node_id"),
            file_of(F.coalesce(t["nodeid"], F.lit(""))).alias("file_path"),
            t["outcome"].alias("outcome"),
            phase["longrepr"].alias("longrepr"),
            F.coalesce(phase["duration"], F.lit(0.0)).alias("duration_seconds"),
        )
    )


def with_exceptions(failing: DataFrame) -> DataFrame:
    """Add the parsed exception; failures without a traceback keep NULLs.

    The traceback is parsed in the row of its test, so nothing is joined back.
    """
    return tracebacks.parse(failing, "longrepr", keep_all=True)


def totals(reports: DataFrame) -> DataFrame:
    """Counts of each report as its summary states them, next to counted ones."""
    s = F.col("summary")

    def counted(*outcomes: str) -> Column:
        return F.size(F.filter("tests", lambda t: F.coalesce(t["outcome"], F.lit("passed")).isin(*outcomes)))

    return reports.select(
        "run_id",
        s["total"].alias("total_tests"),
        s["passed"].alias("passed"),
        s["failed"].alias("failed"),
        s["error"].alias("errors"),
        s["skipped"].alias("skipped"),
        ((s["failed"] + s["error"]) > 0).alias("has_failures"),
        counted("failed").alias("listed_failed"),
        counted("error").alias("listed_errors"),
    )


def result_totals(results: DataFrame, *keys: str) -> DataFrame:
    """The same totals from one row per test: ``keys, node_id, outcome``."""
    outcome = F.coalesce("outcome", F.lit("passed"))

    def n(value: str) -> Column:
        return F.count_if(outcome == value)

    return (
        results.groupBy(*keys)
        .agg(
            F.count("*").alias("total_tests"),
            n("passed").alias("passed"),
            n("failed").alias("failed"),
            n("error").alias("errors"),
            n("skipped").alias("skipped"),
        )
        .withColumn("has_failures", F.col("failed") + F.col("errors") > 0)
    )
