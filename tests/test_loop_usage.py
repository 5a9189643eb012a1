import pytest
from pyspark.sql import functions as F

from triage.operators import loop as lp
from triage.operators import reports as rp
from triage.operators import usage as us

RES = "run_id string, iteration int, node_id string, outcome string"
ATT = "run_id string, iteration int, status string"

# run: (reports by iteration as failing node lists, attempt states)
RUNS = {
    "clean": ([[]], []),
    "fixed": ([["foo"], []], ["applied"]),
    "stuck": ([["foo"], ["foo"], ["foo"], ["foo"]], ["applied"] * 3),
    "regress": ([["foo"], ["new"], []], ["applied"] * 2),
    "noparse": ([["foo"], None], ["unparseable"]),
    "noapply": ([["foo"], None], ["not_applied"]),
    "nolaunch": ([["foo"], None, ["foo", "bar"]], ["no_report", "applied"]),
    "carry": ([["foo"], ["foo", "x", "y"], None], ["applied", "no_report"]),
    "late": ([["a", "b"], ["b"], [], ["a"]], ["applied"] * 3),
    "long": ([["a"]] * 8, ["applied"] * 7),
}


@pytest.fixture(scope="module")
def tables(spark):
    results, attempts = [], []
    for run, (reports, states) in RUNS.items():
        for i, failing in enumerate(reports):
            if failing is not None:
                results.append((run, i, "always_ok", "passed"))
                results += [(run, i, n, "failed" if n != "b" else "error") for n in failing]
        attempts += [(run, i + 1, s) for i, s in enumerate(states)]
    return spark.createDataFrame(results, RES), spark.createDataFrame(attempts, ATT)


def test_classify(tables):
    results, attempts = tables
    got = {}
    for r in lp.classify(attempts, results).orderBy("iteration").collect():
        got.setdefault(r.run_id, []).append(r.outcome)
    assert got["fixed"] == ["fixed"] and got["stuck"] == ["no_change"] * 3
    assert got["regress"] == ["regressed", "fixed"]
    assert got["noparse"] == ["no_change"] and got["noapply"] == ["no_change"]
    assert got["nolaunch"] == ["run_failed", "no_change"]
    notes = {(r.run_id, r.iteration): r.notes for r in lp.classify(attempts, results).collect()}
    assert notes[("regress", 1)] == "targets pass, newly failing: 1, undone"
    assert notes[("fixed", 1)] == ""


def test_semi_and_anti_agree_with_counts(tables):
    results, _ = tables
    still = {(r.run_id, r.iteration): r["count"] for r in lp.still_failing(results).groupBy("run_id", "iteration").count().collect()}
    new = {(r.run_id, r.iteration): r["count"] for r in lp.newly_broken(results).groupBy("run_id", "iteration").count().collect()}
    for r in lp.compare_runs(results).collect():
        assert still.get((r.run_id, r.iteration), 0) == r.still_failing
        assert new.get((r.run_id, r.iteration), 0) == r.newly_broken


def test_resolve(tables):
    results, attempts = tables
    got = {r.run_id: (r.success, r.iterations, r.baseline_failing, r.final_failing) for r in lp.resolve(attempts, results).collect()}
    assert got == {
        "clean": (True, 0, 0, 0), "fixed": (True, 1, 1, 0), "stuck": (False, 3, 1, 1),
        "regress": (True, 2, 1, 0), "noparse": (False, 1, 1, 1), "noapply": (False, 1, 1, 1),
        "nolaunch": (False, 2, 1, 2), "carry": (False, 2, 1, 3), "late": (True, 2, 2, 0),
        "long": (False, 7, 1, 1)}
    capped = {r.run_id: r.iterations for r in lp.resolve(attempts, results, 2).collect()}
    assert capped["long"] == 2 and capped["stuck"] == 2
    assert {r.run_id: r.iterations for r in lp.resolve(attempts, results, 5).collect()}["long"] == 5


def test_next_description(spark, tables):
    results, _ = tables
    failures = spark.createDataFrame([("late", 0, "a", "E", "m")],
                                     "run_id string, iteration int, node_id string, exception_type string, message string")
    texts = spark.createDataFrame([("late", "please")], "run_id string, description string")
    got = {(r.run_id, r.iteration): r.description for r in lp.next_description(results, failures, texts).collect()}
    assert got[("late", 0)] == "please\n\nCurrently failing:\na: failed — E: m\nb: error"
    assert got[("late", 2)] == "please" and got[("clean", 0)] == ""
    assert got[("carry", 1)] == "Currently failing:\nfoo: failed"


def test_result_totals(tables):
    results, _ = tables
    row = rp.result_totals(results, "run_id", "iteration").where("run_id = 'late' and iteration = 0").first()
    assert (row.total_tests, row.passed, row.failed, row.errors, row.has_failures) == (3, 1, 1, 1, True)


COUNTERS = ("session_id string, ts int, total_requests long, input_tokens_original long, "
            "input_tokens_compressed long, estimated_cost_saved_usd string")


def test_call_deltas(spark):
    rows = [("s", 1, 3, 10000, 3000, "$1.00"), ("s", 2, 4, 12000, 3400, "$1.12"), ("s", 3, 4, 12000, 3400, "$1.05"),
            ("s", 4, 1, 50, 25, ""), ("t", 1, 1, 0, 0, "$0.00")]
    got = {(r.session_id, r.ts): r for r in us.call_deltas(spark.createDataFrame(rows, COUNTERS)).collect()}
    a = got[("s", 2)]
    assert (a.requests_delta, a.original_tokens, a.compressed_tokens, a.tokens_saved, a.compression_ratio, a.cost_saved_usd) == (
        1, 2000, 400, 1600, 0.2, "$0.12")
    assert got[("s", 3)].cost_saved_usd == "$0.00" and got[("s", 3)].compression_ratio == 0.0
    assert (got[("s", 4)].requests_delta, got[("s", 4)].original_tokens) == (1, 50)
    assert got[("t", 1)].compression_ratio == 0.0


def test_call_deltas_missing(spark):
    with pytest.raises(ValueError):
        us.call_deltas(spark.createDataFrame([("s", 1)], "session_id string, ts int"))
    broken = spark.createDataFrame([("s", 1, None, 1, 1, "$1")], COUNTERS)
    with pytest.raises(Exception, match="missing counter total_requests"):
        us.call_deltas(broken).collect()


def test_context_usage(spark):
    units = spark.createDataFrame([(1, 1, 100, 50), (1, 2, 100, 60), (1, 3, 100, 40), (2, 1, 0, 0)],
                                  "failure_id int, rank int, raw_tokens int, compressed_tokens int")
    got = {r.failure_id: r for r in us.context_usage(units, units.where("rank in (1, 3) and failure_id = 1"), ["failure_id"]).collect()}
    assert (got[1].baseline_tokens, got[1].compressed_tokens, got[1].units_available, got[1].units_included) == (300, 90, 3, 2)
    assert got[1].compression_ratio == pytest.approx(0.7) and got[1].included_ratio == pytest.approx(0.55)
    assert got[2].compression_ratio == 0.0 and got[2].units_included == 0


def test_dashboard_and_reports(spark, tables, tmp_path):
    results, attempts = tables
    iterations = lp.cut(lp.classify(attempts, results), 5)
    usage = attempts.select(
        "run_id", "iteration", F.lit(1000).alias("baseline_tokens"), F.lit(300).alias("compressed_tokens"),
        F.lit(1).alias("requests"), F.lit(100).alias("tokens_saved"), F.lit("$0.02").alias("cost_saved_usd"))
    board = us.dashboard(lp.resolve(attempts, results, 5), iterations, usage)
    got = {r.run_id: r for r in board.collect()}
    r = got["regress"]
    assert r.outcome_counts == {"fixed": 1, "regressed": 1}
    assert (r.total_baseline_tokens, r.total_compressed_tokens, r.overall_compression_ratio) == (2000, 600, 0.7)
    assert (r.total_requests, r.total_tokens_saved, r.total_cost_saved_usd) == (2, 200, "$0.04")
    assert (got["long"].total_requests, got["clean"].total_cost_saved_usd) == (5, "$0.00")
    assert {r.run_id: r.total_requests for r in us.loop_totals(usage.withColumnRenamed("x", "y")).collect()}["long"] == 7

    detail = us.breakdown(iterations, usage)
    texts = {r.run_id: r for r in us.report_texts(board, detail).collect()}
    assert texts["regress"].markdown.startswith("Run regress: solved\n\n- total_iterations: 2\n")
    assert texts["regress"].markdown.endswith(
        "\n\n1. regressed, 1000 to 300 tokens, proxy 100, $0.02\n1. fixed, 1000 to 300 tokens, proxy 100, $0.02")
    assert "<dt>total_cost_saved_usd</dt><dd>$0.04</dd></dl><ol><li>regressed" in texts["regress"].html
    assert texts["clean"].html.endswith("<ol></ol></section>")
    assert {round(r.proxy_ratio, 2) for r in detail.collect()} == {0.25}
    us.write_report(board, detail, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "json")).count() == len(RUNS)
    assert spark.read.parquet(str(tmp_path / "out" / "texts")).count() == len(RUNS)
