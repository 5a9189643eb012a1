"""The texts that patches meet are spread by their number."""

from triage.operators import patches


def test_apply_has_a_task_for_every_few_files(spark, monkeypatch):
    monkeypatch.setattr(patches, "FILES_PER_TASK", 10)
    monkeypatch.setattr(patches, "FEW_FILES", 5)
    files = spark.range(300).selectExpr("'r' as repo", "concat('f', id) as path", "'a\\n' as content")
    changes = spark.createDataFrame(
        [(i, "r", 0, f"f{i}", "full_file", f"b{i}\n", None) for i in (1, 7, 400)],
        "response_id long, repo string, pos int, path string, format string, new_content string, diff_text string",
    )
    done = patches.apply(changes, files)
    assert "REPARTITION_BY_NUM" in (plan := done._jdf.queryExecution().executedPlan().toString()) and ", 30)" in plan
    got = {(r.response_id, r.existed_before, r.new_content) for r in done.collect()}
    assert got == {(1, True, "b1\n"), (7, True, "b7\n"), (400, False, "b400\n")}
    nothing = patches.apply(changes, files.where("false")).collect()
    assert len(nothing) == 3 and not any(r.existed_before for r in nothing)
