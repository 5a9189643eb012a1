import hashlib

import pytest
from pyspark.sql import functions as F

from triage.functions import money, paths, text
from triage.operators import files as fo
from triage.operators import symbols as sy
from triage.sources import refs, repo_files, report_files, tables
from triage.operators import reports as rp


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_refs(spark):
    raw = [
        "https://github.com/psf/requests", "git@github.com:psf/requests.git", " psf/requests ",
        "this is not a repo at all!!", "/data/x", "https://github.com/psf/requests/",
    ]
    rows = refs.classify_refs(spark.createDataFrame([(r,) for r in raw], "raw_input string")).collect()
    assert [r.kind for r in rows] == [
        "remote_url", "remote_url", "shorthand", None, "local_path", "remote_url"]
    assert {r.clone_url for r in rows if r.clone_url} == {"https://github.com/psf/requests.git"}
    assert refs.quarantine(refs.classify_refs(
        spark.createDataFrame([(r,) for r in raw], "raw_input string"))).count() == 1


def test_languages(spark):
    row = one(spark, *[fo.language(F.lit(p)) for p in ("app.py", "README.md", "a/B.TSX", ".py", "x.go")])
    assert tuple(row) == ("python", "unknown", "typescript", "unknown", "go")


def test_hash_and_line_count(make_files):
    row = fo.index_files(make_files({"a.py": "x\ny\n"})).first()
    assert row.content_hash == hashlib.sha256(b"x\ny\n").hexdigest()
    assert row.line_count == 3


def test_noise_and_size(spark):
    rows = [("build/x.py", 1), ("a/node_modules/y.js", 1), ("ok.py", 2_000_000), ("big.py", 2_000_001)]
    df = spark.createDataFrame(rows, "path string, length long")
    assert [r.path for r in fo.keep_source_files(df, max_bytes=2_000_000).collect()] == ["ok.py"]


def test_ignore_rules_last_match_wins(make_files):
    f = make_files({
        ".gitignore": "*.log\n!keep.log\n/out/\ndoc/**/x.txt\n# comment\nfoo?.c\ntmp\n\\#odd\na/b\n",
        "x.log": "", "d/y.log": "", "keep.log": "", "out/z.py": "", "a/out/z.py": "",
        "doc/x.txt": "", "doc/q/w/x.txt": "", "foo1.c": "", "foo12.c": "", "tmp/q/r.py": "",
        "#odd": "", "a/b/c.py": "", "z/a/b/c.py": "",
    })
    kept = {r.path for r in fo.apply_ignore_rules(f, fo.ignore_rules(f)).collect()}
    assert kept == {".gitignore", "keep.log", "a/out/z.py", "foo12.c", "z/a/b/c.py"}


def test_no_ignore_file_keeps_all(make_files):
    f = make_files({"a.py": ""})
    assert fo.apply_ignore_rules(f, fo.ignore_rules(f)).count() == 1


def test_validate_repos(spark):
    repos = spark.createDataFrame([("empty",), ("docs",), ("code",), ("gitonly",)], "repo string")
    files = spark.createDataFrame(
        [("docs", "README.md"), ("code", "a.py"), ("code", "b.PY"), ("gitonly", ".git/x.py")],
        "repo string, path string")
    got = {r.repo: (r.valid, r.reason, r.n_files) for r in fo.validate_repos(repos, files).collect()}
    assert got == {"empty": (False, "empty", 0), "docs": (False, "no code", 1),
                   "code": (True, None, 2), "gitonly": (False, "empty", 0)}


def test_scan_and_store(spark, tmp_path):
    root = tmp_path / "snap" / "o" / "sha1"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "main.py").write_text("class Foo:\n    def bar(self):\n        return 1\n")
    (root / "README.md").write_text("hello")
    (root / "big.py").write_text("x" * 2_000_001)
    scanned = repo_files.decode(repo_files.scan_files(spark, str(tmp_path / "snap")))
    index = fo.index_files(fo.keep_source_files(scanned, max_bytes=2_000_000))
    got = {(r.repo, r.commit_sha, r.path, r.language) for r in index.collect()}
    assert got == {("o", "sha1", "pkg/main.py", "python"), ("o", "sha1", "README.md", "unknown")}
    symbols = sy.extract(index)
    assert {r.qualified_name for r in symbols.collect()} == {"Foo", "Foo.bar"}
    total = fo.summary(index, symbols).first()
    assert (total.n_files, total.n_symbols) == (2, 2)

    store = str(tmp_path / "index")
    tables.write_index(index, store)
    tables.write_index(index.withColumn("commit_sha", F.lit("sha2")), store)
    tables.write_index(index, store)
    assert tables.read_index(spark, store).count() == 4
    back = tables.read_index(spark, store, "o", "sha2")
    assert back.count() == 2
    assert tables.not_indexed(index, back).count() == 2
    assert tables.not_indexed(index, tables.read_index(spark, store)).count() == 0
    assert tables.not_indexed(index, tables.read_index(spark, store), force=True).count() == 2


def test_unprocessed(spark):
    schema = "repo string, path string, content_hash string"
    new = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], schema)
    done = spark.createDataFrame([("r", "a", "1"), ("r", "b", "old")], schema)
    assert [r.path for r in tables.unprocessed(new, done).collect()] == ["b"]


TB = (
    "Traceback (most recent call last):\n"
    '  File "/r/a.py", line 3, in f\n    assert 1 == 2\nAssertionError: no\n'
)


def test_reports(spark, tmp_path):
    import json
    (tmp_path / "run1.json").write_text(json.dumps({
        "summary": {"total": 4, "passed": 1, "failed": 1, "error": 1},
        "tests": [
            {"nodeid": "t/test_a.py::test_ok", "outcome": "passed"},
            {"nodeid": "t/test_a.py::test_bad", "outcome": "failed", "call": {"longrepr": TB, "duration": 0.5}},
            {"nodeid": "t/test_b.py", "outcome": "error", "setup": {"longrepr": {"crash": 1}, "duration": 0.1}},
            {"nodeid": "t/test_c.py::x"},
        ]}, indent=1))
    (tmp_path / "run2.json").write_text("{}")
    (tmp_path / "cut.json").write_text('{"summary": {"total": 9, "failed": 3}, "tests": [{"nodeid": "a", "outc')
    (tmp_path / "run3.json").write_text(json.dumps({"tests": [
        {"nodeid": "t/p.py::x", "outcome": "failed", "call": {"longrepr": "[gw0] linux -- Python\n" + TB}}]}))
    reports = report_files.read_reports(spark, str(tmp_path))
    totals = {r.run_id: r for r in rp.totals(reports).collect()}
    assert (totals["run1"].total_tests, totals["run1"].skipped, totals["run1"].has_failures) == (4, 0, True)
    assert (totals["run1"].listed_failed, totals["run1"].listed_errors) == (1, 1)
    assert not totals["run2"].has_failures and set(totals) == {"run1", "run2", "run3"}
    assert [r.run_id for r in report_files.broken_reports(spark, str(tmp_path)).collect()] == ["cut"]
    rows = {r.node_id: r for r in rp.with_exceptions(rp.failures(reports)).collect()}
    assert set(rows) == {"t/test_a.py::test_bad", "t/test_b.py", "t/p.py::x"}
    assert rows["t/p.py::x"].exception_type == "AssertionError"
    bad = rows["t/test_a.py::test_bad"]
    assert (bad.file_path, bad.exception_type, bad.message, bad.duration_seconds) == (
        "t/test_a.py", "AssertionError", "no", 0.5)
    other = rows["t/test_b.py"]
    assert other.exception_type is None and other.file_path == "t/test_b.py" and other.longrepr is None


def test_money(spark):
    vals = ["$1,234.50", "", " $0.02 ", "abc", "$3"]
    row = one(spark, *[money.parse_usd(F.lit(v)) for v in vals])
    assert [None if v is None else str(v) for v in row] == ["1234.50", "0.00", "0.02", None, "3.00"]
    assert one(spark, money.format_usd(F.lit("0.5").cast("decimal(18,2)")))[0] == "$0.50"


def test_paths(spark):
    row = one(spark, paths.relative_path(F.lit("/srv/r/a.py"), F.lit("/srv/r/")),
              paths.relative_path(F.lit("/srv/rx/a.py"), F.lit("/srv/r")),
              paths.is_unsafe(F.lit("../x")), paths.is_unsafe(F.lit("/x")), paths.is_unsafe(F.lit("a/b..c")))
    assert tuple(row) == ("a.py", None, True, True, False)


def test_compress(spark):
    sample = "#!/bin/x\n\n# whole\nx = 1  # inline   \n\n\n\n\ny = 2\t\n  # also\n\n"
    out = one(spark, text.compress(F.lit(sample)))[0]
    assert out == "x = 1  # inline\n\ny = 2"
    assert text.compressor("none") is text.identity
    with pytest.raises(ValueError):
        text.compressor("paper")


def test_tokens_and_lines(spark):
    row = one(spark, text.count_tokens(F.lit("a.b (c)")), text.count_tokens(F.lit("")),
              text.count_tokens(F.lit(None).cast("string")), text.count_words(F.lit(" a  b\nc")))
    assert tuple(row) == (6, 0, 0, 3)
    for sample in ["", "\n", "a", "a\n", "a\r\nb\rc\n\n", "\n\na", "x\x0by\x85z\u2028w"]:
        assert one(spark, text.split_lines(F.lit(sample)))[0] == sample.splitlines()


def test_scan_listed_by_tasks_equals_scan(spark, tmp_path):
    root = tmp_path / "snap"
    for name, data in {"r/c1/a.py": b"x", "r/c1/pkg/deep/er/b.py": b"\xff\x00", "r/c2/a.py": b"", "s/c1/big.bin": b"z" * 5000, "s/c1/ü n.txt": b"1", "s/top": b"t"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "empty" / "folder").mkdir(parents=True)
    rows = lambda df: sorted((r.repo, r.commit_sha, r.path, r.length, bytes(r.content)) for r in df.collect())
    want = [("r", "c1", "a.py", 1, b"x"), ("r", "c1", "pkg/deep/er/b.py", 2, b"\xff\x00"), ("r", "c2", "a.py", 0, b""),
            ("s", "c1", "big.bin", 5000, b"z" * 5000), ("s", "c1", "ü n.txt", 1, b"1")]
    assert rows(repo_files.scan_listed(spark, str(root))) == want
    assert rows(repo_files.scan_listed(spark, f"file://{root}/", max_bytes=100)) == [r for r in want if r[3] <= 100]
    # Spark's own reader leaves empty files out
    assert [r for r in rows(repo_files.scan_files(spark, str(root))) if r[2]] == [r for r in want if r[3]]
    assert repo_files.list_files(spark, str(root / "empty")).count() == 0
