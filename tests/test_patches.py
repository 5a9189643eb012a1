import pytest

from triage.operators import patches as pa

CH = "response_id long, repo string, pos int, path string, format string, new_content string, diff_text string"
FI = "repo string, path string, content string"


def changes_of(spark, text):
    df = spark.createDataFrame([(1, text)], "response_id long, text string")
    return [(r.pos, r.path, r.format, r.new_content, r.diff_text, r.status)
            for r in pa.file_changes(df).orderBy("pos").collect()]


@pytest.mark.parametrize("header", [
    "### File: src/app.py", "**File:** src/app.py", "File: src/app.py", "# file:   src/app.py  ",
    "**File**: `src/app.py`", "File: `src/app.py`"])
def test_full_file_headers(spark, header):
    got = changes_of(spark, f"Root cause.\n\n{header}\n```python\nx = 1\n\n```\ndone")
    assert got == [(0, "src/app.py", "full_file", "x = 1\n", None, "parsed")]


DIFF_A = "--- a/app.py\n+++ b/app.py\n@@ -1,2 +1,2 @@\n def f(a, b):\n-    return a - b\n+    return a + b\n"
DIFF_B = "--- a/lib/u.py\n+++ b/lib/u.py\n@@ -1 +1 @@\n-x\n+y\n"


def test_diffs(spark):
    two = changes_of(spark, f"Fix:\n```diff\n{DIFF_A}{DIFF_B}```\n")
    assert [(r[1], r[2], r[4]) for r in two] == [
        ("app.py", "unified_diff", DIFF_A), ("lib/u.py", "unified_diff", DIFF_B)]
    untagged = changes_of(spark, f"```\n{DIFF_A}```")
    assert [(r[1], r[2]) for r in untagged] == [("app.py", "unified_diff")]
    deletion = changes_of(spark, "```diff\n--- a/x.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n```")
    assert deletion == [(None, None, None, None, None, "unparseable")]


def test_two_files_and_nothing(spark):
    got = changes_of(spark, "File: a.py\n```\n1\n```\ntext\n### File: b.py\n```py\n2\n```\n```sh\nls\n```")
    # the last fence is still within reach of the header of b.py
    assert [(r[1], r[3]) for r in got] == [("a.py", "1"), ("b.py", "2"), ("b.py", "ls")]
    assert changes_of(spark, "```py\nx\n```")[0][5] == "unparseable"
    assert changes_of(spark, "only prose")[0][5] == "unparseable"


def test_header_out_of_reach(spark):
    far = changes_of(spark, "File: a.py\n" + "z" * 250 + "\n```\n1\n```")
    assert far[0][5] == "unparseable"
    near = changes_of(spark, "File: a.py\n" + "é" * 187 + "\n```\n1\n```")
    assert near[0][1] == "a.py"


def test_nearest_header_wins(spark):
    got = changes_of(spark, "File: a.py\n**File:** b.py\n\n```\n1\n```")
    assert got[0][1] == "b.py"


def apply(spark, changes, files):
    c = spark.createDataFrame(changes, CH)
    f = spark.createDataFrame(files, FI)
    out = pa.apply(c, f)
    rows = {(r.response_id, r.path): r for r in out.collect()}
    status = {r.response_id: r.status for r in pa.apply_status(c, out).collect()}
    return rows, status


APP = "def f(a, b):\n    return a - b\n"


def test_apply(spark):
    new = "--- /dev/null\n+++ b/new.py\n@@ -0,0 +1,2 @@\n+a\n+b\n"
    bad = DIFF_A.replace("a - b", "a * b")
    rows, status = apply(spark, [
        (1, "r", 0, "app.py", "full_file", "whole", None),
        (2, "r", 0, "app.py", "unified_diff", None, DIFF_A),
        (3, "r", 0, "fresh.py", "full_file", "n", None),
        (4, "r", 0, "app.py", "unified_diff", None, bad), (4, "r", 1, "ok.py", "full_file", "x", None),
        (5, "r", 0, "../x", "full_file", "x", None),
        (6, "r", 0, "new.py", "unified_diff", None, new),
        (7, "r", 0, "app.py", "full_file", "def f(a, b):\n    return a - b\n", None),
        (7, "r", 1, "app.py", "unified_diff", None, DIFF_A),
        (8, "r", 0, None, None, None, None),
        (9, "r", 0, "gone.py", "unified_diff", None, DIFF_B),
    ], [("r", "app.py", APP), ("r", "lib/u.py", "x\n")])
    fixed = "def f(a, b):\n    return a + b\n"
    assert rows[(1, "app.py")].new_content == "whole" and rows[(1, "app.py")].old_content == APP
    assert rows[(2, "app.py")].new_content == fixed
    assert rows[(3, "fresh.py")].new_content == "n" and not rows[(3, "fresh.py")].existed_before
    assert rows[(4, "app.py")].error == "patch does not apply" and rows[(4, "ok.py")].new_content is None
    assert rows[(5, "../x")].error == "unsafe path"
    assert rows[(6, "new.py")].new_content == "a\nb\n"
    assert rows[(7, "app.py")].new_content == fixed
    assert status == {1: "applied", 2: "applied", 3: "applied", 4: "not_applied", 5: "not_applied",
                      6: "applied", 7: "applied", 8: "unparseable", 9: "not_applied"}


def one_diff(spark, old, diff):
    rows, _ = apply(spark, [(1, "r", 0, "p", "unified_diff", None, f"--- a/p\n+++ b/p\n{diff}")], [("r", "p", old)])
    return rows[(1, "p")].new_content


BASE = "".join(f"l{i}\n" for i in range(1, 21))


def test_several_hunks(spark):
    diff = "@@ -2,3 +2,4 @@\n l2\n-l3\n+L3\n+extra\n l4\n@@ -10,3 +11,2 @@\n l10\n-l11\n l12\n"
    want = BASE.replace("l3\n", "L3\nextra\n", 1).replace("l11\n", "")
    assert one_diff(spark, BASE, diff) == want


def test_shifted_hunk_finds_its_place(spark):
    diff = "@@ -12,3 +12,3 @@\n l9\n-l10\n+X\n l11\n"
    assert one_diff(spark, BASE, diff) == BASE.replace("l10\n", "X\n")


def test_hunk_without_trailing_context_matches_at_end_only(spark):
    assert one_diff(spark, BASE, "@@ -20 +20 @@\n-l20\n+Z\n") == BASE.replace("l20\n", "Z\n")
    assert one_diff(spark, BASE, "@@ -5 +5 @@\n-l5\n+Z\n") is None


def test_counts_must_agree(spark):
    assert one_diff(spark, BASE, "@@ -2,9 +2,9 @@\n l2\n-l3\n+L3\n l4\n") is None


def test_missing_final_newline(spark):
    diff = "@@ -1,2 +1,2 @@\n a\n-b\n\\ No newline at end of file\n+c\n"
    assert one_diff(spark, "a\nb", diff) == "a\nc\n"
    assert one_diff(spark, "a\nb\n", diff) is None


def test_versions(spark):
    files = spark.createDataFrame([("r", "a", 1, "a1"), ("r", "b", 1, "b1")], "repo string, path string, version int, content string")
    edits = spark.createDataFrame([("r", "a", "a2"), ("r", "n", "n1")], "repo string, path string, new_content string")
    after = pa.apply_full_files(files, edits)
    got = {(r.path, r.version, r.content) for r in after.collect()}
    assert got == {("a", 2, "a2"), ("b", 1, "b1"), ("n", 1, "n1")}
    history = spark.createDataFrame(
        [("r", "a", 1, "a1"), ("r", "a", 2, "a2"), ("r", "a", 3, "a3"), ("r", "b", 1, "b1"), ("r", "n", 2, "n")],
        "repo string, path string, version int, content string")
    assert {(r.path, r.content) for r in pa.rollback(history, 2).collect()} == {("a", "a1"), ("b", "b1")}


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("r", "a", "x\ny\ny\n"), ("r", "b", "1\n2"), ("r", "same", "s")], FI)
    new = spark.createDataFrame([("r", "a", "y\nx\nz\n"), ("r", "c", "q\nq\n"), ("r", "same", "s"), ("r", "e", "")], FI)
    got = {(r.path, r.change, r.added_lines, r.removed_lines) for r in pa.snapshot_diff(old, new).collect()}
    assert got == {("a", "modified", 1, 1), ("b", "removed", 0, 2), ("c", "added", 2, 0), ("e", "added", 0, 0)}
    assert {(r.path, r.change) for r in pa.file_diff(old, new).collect()} == {
        ("a", "modified"), ("b", "removed"), ("c", "added"), ("e", "added")}


def test_hunks_align_unique_lines_and_tell_moves_from_edits(spark):
    def found(a, b):
        df = lambda t: spark.createDataFrame([("r", "f", "\n".join(t))], "repo string, path string, content string")
        return [tuple(r)[2:] for r in pa.snapshot_hunks(df(a), df(b)).orderBy("hunk").collect()]

    base = ["a", "b", "", "c", "d", "", "e"]
    assert found(base, base) == []
    assert found(base, ["a", "B", "", "c", "d", "", "e"]) == [(1, 2, 1, 2, 1, 0)]
    assert found(base, ["a", "b", "", "c", "x", "y", "d", "", "e"]) == [(1, 5, 0, 5, 2, 0)]
    # a line that moves is taken out in one hunk and put in in another; the longest run stays aligned
    assert found(["1", "2", "3", "4", "5", "6"], ["0", "5", "1", "2", "3", "4", "7"]) == [(1, 1, 0, 1, 2, 0), (2, 5, 2, 7, 1, 1)]
    assert found(["x", "p", "q", "y"], ["X", "q", "p", "Y"]) == [(1, 1, 1, 1, 2, 0), (2, 3, 2, 4, 1, 1)]
    assert found(["s", "s", "s"], ["s", "s"]) == [(1, 3, 1, 3, 0, 0)]
    assert found([""], ["n"]) == [(1, 1, 1, 1, 1, 0)]
