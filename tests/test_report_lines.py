"""Reports on lines of shared files against the same reports in a file each."""

import json

from triage.operators import reports as rp
from triage.plans.queries import QUERIES
from triage.sources import report_files


def test_lines_equal_files(spark, tmp_path):
    tb = "Traceback (most recent call last):\n  File \"/w/a.py\", line 3, in f\n\tg()\nValueError: no\n"
    bodies = {
        "1-0": json.dumps({"summary": {"total": 2, "failed": 1}, "tests": [
            {"nodeid": "a.py::x", "outcome": "failed", "call": {"longrepr": tb, "duration": 0.5}},
            {"nodeid": "a.py::y", "outcome": "error", "setup": {"longrepr": {"crash": [1]}, "duration": 0.25}}]}),
        "1-1": json.dumps({"summary": {"total": 9, "failed": 3}, "tests": [{"nodeid": "a"}]})[:-9],
        "2-0": "{}", "3-0": "no JSON", "4-0": json.dumps({"tests": [{"nodeid": "p::x", "outcome": "failed"}]}),
    }
    for d in ("files", "lines"):
        (tmp_path / d).mkdir()
    for name, body in bodies.items():
        (tmp_path / "files" / f"{name}.json").write_text(body)
    (tmp_path / "lines" / "part-0").write_text("".join(f"{n}\t{b}\n" for n, b in bodies.items()))
    read = {d: report_files.read_reports(spark, str(tmp_path / d), d == "lines") for d in ("files", "lines")}
    for of in (rp.totals, lambda r: rp.with_exceptions(rp.failures(r))):
        files, lines = (sorted(map(repr, of(read[d]).collect())) for d in ("files", "lines"))
        assert files == lines and files
    broken = report_files.broken_reports(spark, str(tmp_path / "lines"), lines=True)
    assert {r.run_id for r in broken.collect()} == {"1-1", "3-0"}


def test_no_file_for_each_report(spark, tmp_path):
    """2,000 runs of two reports: the queries read a few files."""
    spark.sql("select id as event_id, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 2 as int)) as ts, id div 6 as user_id, "
              "if(id % 4 = 1, 'error', 'view') as event_type, 1.0D as value, '' as props from range(12000)").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["report_summaries"](spark, str(tmp_path))
    assert found.count() == 4000 and len(found.inputFiles()) < 50
