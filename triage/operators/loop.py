"""Fix attempts: compare test runs before and after, decide, and sum up a run.

Inputs are recorded tables: ``results(run_id, iteration, node_id, outcome)``, where
iteration 0 is the run before any fix, and ``attempts(run_id, iteration, status)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from triage.operators.reports import is_failing

# Attempt states, outcomes.
APPLIED, UNPARSEABLE, NOT_APPLIED, NO_REPORT = "applied", "unparseable", "not_applied", "no_report"
FIXED, NO_CHANGE, REGRESSED, RUN_FAILED = "fixed", "no_change", "regressed", "run_failed"


def _failing(results: DataFrame) -> DataFrame:
    return results.where(is_failing(F.col("outcome"))).select("run_id", "iteration", "node_id").distinct()


def still_failing(results: DataFrame) -> DataFrame:
    """Failing tests of each iteration that failed before any fix too."""
    failing = _failing(results)
    target = failing.where("iteration = 0").select("run_id", "node_id")
    return failing.where("iteration > 0").join(target, ["run_id", "node_id"], "left_semi")


def newly_broken(results: DataFrame) -> DataFrame:
    """Failing tests of each iteration that did not fail before any fix."""
    failing = _failing(results)
    target = failing.where("iteration = 0").select("run_id", "node_id")
    return failing.where("iteration > 0").join(target, ["run_id", "node_id"], "left_anti")


def compare_runs(results: DataFrame) -> DataFrame:
    """``run_id, iteration, still_failing, newly_broken`` counts.

    One pass instead of a semi and an anti join: the rows of one test in one
    run are as many as its iterations, so the flag comes from a tiny window.
    """
    target = F.max(F.col("iteration") == 0).over(W.partitionBy("run_id", "node_id"))
    return (
        _failing(results)
        .withColumn("_target", target)
        .where("iteration > 0")
        .groupBy("run_id", "iteration")
        .agg(
            F.count_if("_target").alias("still_failing"),
            F.count_if(~F.col("_target")).alias("newly_broken"),
        )
    )


def _notes(still: Column, new: Column) -> Column:
    return (
        F.when(F.col("status") == UNPARSEABLE, "no file change in the reply")
        .when(F.col("status") == NOT_APPLIED, "the change does not fit the files")
        .when(F.col("status") == NO_REPORT, "no test report after the change")
        .when(still > 0, F.format_string("targets failing: %d, undone", still))
        .when(
            new > 0,
            F.format_string(
                "targets pass, newly failing: %d, undone", new
            ),
        )
        .otherwise("")
    )


def classify(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """Add ``still_failing, newly_broken, outcome, kept, notes`` to every attempt."""
    still = F.coalesce("still_failing", F.lit(0))
    new = F.coalesce("newly_broken", F.lit(0))
    outcome = (
        F.when(F.col("status").isin(UNPARSEABLE, NOT_APPLIED), NO_CHANGE)
        .when(F.col("status") == NO_REPORT, RUN_FAILED)
        .when(still > 0, NO_CHANGE)
        .when(new > 0, REGRESSED)
        .otherwise(FIXED)
    )
    tested = F.col("status") == APPLIED
    return (
        attempts.join(compare_runs(results), ["run_id", "iteration"], "left")
        .withColumn("still_failing", F.when(tested, still))
        .withColumn("newly_broken", F.when(tested, new))
        .withColumn("outcome", outcome)
        .withColumn("kept", F.col("outcome") == FIXED)
        .withColumn("notes", _notes(still, new))
    )


def cut(classified: DataFrame, max_iterations: int | None = None) -> DataFrame:
    """Iterations that take place: up to the first fix, and up to ``max_iterations`` where given."""
    in_range = F.col("iteration") >= 1
    if max_iterations is not None:
        in_range = in_range & (F.col("iteration") <= max_iterations)
    first = F.min(F.when(F.col("outcome") == FIXED, F.col("iteration"))).over(W.partitionBy("run_id"))
    return (
        classified.where(in_range)
        .withColumn("_first", first)
        .where(F.col("_first").isNull() | (F.col("iteration") <= F.col("_first")))
        .drop("_first")
    )


def failing_counts(results: DataFrame) -> DataFrame:
    return _failing(results).groupBy("run_id", "iteration").agg(F.count("*").alias("failing"))


def current_report(classified: DataFrame, results: DataFrame, baselines: DataFrame) -> DataFrame:
    """Add ``report_iteration`` and ``failing`` as known after each iteration.

    The last report that exists counts, even of a fix that was rolled back;
    before the first one it is the baseline (iteration 0).
    """
    rows = (
        classified.select("run_id", "iteration", (F.col("status") == APPLIED).alias("_has"))
        .unionByName(baselines.select("run_id", F.lit(0).alias("iteration"), F.lit(True).alias("_has")))
        .join(failing_counts(results), ["run_id", "iteration"], "left")
    )
    report = F.when(
        F.col("_has"),
        F.struct(F.col("iteration").alias("at"), F.coalesce("failing", F.lit(0)).alias("failing")),
    )
    over = W.partitionBy("run_id").orderBy("iteration").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_r", F.last(report, ignorenulls=True).over(over)).select(
        "run_id", "iteration", F.col("_r.at").alias("report_iteration"), F.col("_r.failing").alias("failing")
    )


def resolve(
    attempts: DataFrame, results: DataFrame, max_iterations: int | None = None
) -> DataFrame:
    """One row per run: ``run_id, success, iterations, baseline_failing, final_failing``.

    A run whose baseline has no failure succeeds with 0 iterations. A fix that
    could not be applied counts as ``no_change``.
    """
    baselines = results.where("iteration = 0").groupBy("run_id").agg(
        F.count_distinct(F.when(is_failing(F.col("outcome")), F.col("node_id"))).alias("baseline_failing")
    )
    broken = baselines.where("baseline_failing > 0")
    done = cut(classify(attempts, results), max_iterations).join(broken, "run_id", "left_semi")
    known = current_report(done, results, broken)
    summary = known.groupBy("run_id").agg(
        F.max_by("failing", "iteration").alias("final_failing"),
        F.max("iteration").alias("iterations"),
    )
    fixed = done.groupBy("run_id").agg(F.bool_or(F.col("outcome") == FIXED).alias("_fixed"))
    return (
        baselines.join(summary, "run_id", "left")
        .join(fixed, "run_id", "left")
        .select(
            "run_id",
            ((F.col("baseline_failing") == 0) | F.coalesce("_fixed", F.lit(False))).alias("success"),
            F.coalesce("iterations", F.lit(0)).alias("iterations"),
            "baseline_failing",
            F.coalesce("final_failing", F.lit(0)).alias("final_failing"),
        )
    )


def next_description(
    results: DataFrame, failures: DataFrame, descriptions: DataFrame
) -> DataFrame:
    """``run_id, iteration, description`` for the attempt after each tested iteration.

    Lists the target tests that still fail, with ``exception_type, message`` of
    ``failures(run_id, iteration, node_id, ...)`` where known, below the user's text
    in ``descriptions(run_id, description)``.
    """
    targets = _failing(results).where("iteration = 0").select("run_id", "node_id")
    rows = (
        results.where(is_failing(F.col("outcome")))
        .select("run_id", "iteration", "node_id", "outcome")
        .join(targets, ["run_id", "node_id"], "left_semi")
        .join(failures, ["run_id", "iteration", "node_id"], "left")
    )
    line = F.concat(
        F.col("node_id"), F.lit(": "), F.col("outcome"),
        F.when(
            F.col("exception_type").isNotNull(),
            F.concat(F.lit(" — "), F.col("exception_type"), F.lit(": "), F.col("message")),
        ).otherwise(""),
    )
    blocks = rows.groupBy("run_id", "iteration").agg(
        F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("_lines")
    )
    tested = results.select("run_id", "iteration").distinct()
    return (
        tested.join(blocks, ["run_id", "iteration"], "left")
        .join(descriptions, "run_id", "left")
        .select(
            "run_id", "iteration",
            F.concat_ws(
                "\n\n",
                F.nullif(F.col("description"), F.lit("")),
                F.when(F.col("_lines") != "", F.concat(F.lit("Currently failing:\n"), F.col("_lines"))),
            ).alias("description"),
        )
    )
