"""Source-code shaped inputs, derived from the given tables.

Every view is one portable SQL text over ``{table}`` placeholders, so the same
text builds the input in Spark and in the SQL that checks a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# Tables whose rows turn into long texts, and the views that make them.
WIDE = ("part", "supplier", "customer", "events", "conversations")
TEXTS = ("v_py", "v_files", "v_tree", "v_traces", "v_responses", "v_next", "v_moved")
# Rows of a wide table that one task turns into texts: from the first number on several tasks share
# them, and beyond the second number per core more tasks follow.
FEW_ROWS, MANY_ROWS = 1_000, 20_000


def _text(*lines: str) -> str:
    """SQL for a text: each argument is a line (SQL expression), with a line feed behind it."""
    return " || ".join(f"{line} || chr(10)" for line in lines)


def _q(literal: str) -> str:
    """SQL literal; braces become ``chr`` calls because of the placeholders."""
    out = "'" + literal.replace("'", "''") + "'"
    return out.replace("{", "' || chr(123) || '").replace("}", "' || chr(125) || '")


def _s(number: str) -> str:
    return f"CAST({number} AS STRING)"


def _div(number: str, by: int) -> str:
    return f"CAST(FLOOR({number} / {by}.0) AS BIGINT)"


def _when(test: str, line: str) -> str:
    """An optional line (empty text when the test fails); ends in its own line feed."""
    return f"CASE WHEN {test} THEN {line} || chr(10) ELSE '' END"


_OTHER = f"({_div('k', 200)} * 200 + (k * 7 + 3) % 200)"

PY_PATH = f"'pkg' || {_s(_div('k', 20))} || '/m' || {_s('k')} || '.py'"
_OTHER_MODULE = f"'pkg' || {_s(_div(_OTHER, 20))} || '.m' || {_s(_OTHER)} || ' import f' || {_s(_OTHER)}"

# Lines of a Python file that other texts (patches, checks) refer to.
PY_RUN = "'    def run(self, x):'"
PY_STEP = "'        # step'"
PY_SUM = f"'        y = x + ' || {_s('p_size')} || '   '"
PY_CLASS = f"'class C' || {_s('k')} || ':'"
PY_TAIL = f"'def f' || {_s('k')} || '(a, b):'"
PY_RETURN = "'    return a + b'"
PY_FIRST = "'\"\"\"Module ' || p_name"

_PY = " || ".join([
    _text(PY_FIRST, "'def hidden(): pass'", "'\"\"\"'", "'import os'", "'import numpy as np'",
          "'from typing import ('", "'    List,'", "')'",
          f"'from . import m' || {_s('k + 1')} || ', m' || {_s('k + 2')}"),
    _when("k % 10 = 3", f"'from .m' || {_s('k - 1')} || ' import C' || {_s('k - 1')}"),
    _when("k % 7 = 2", f"'from . import missing' || {_s('k')}"),
    _when("k % 4 = 1", f"'from ' || {_OTHER_MODULE}"),
    _when("k % 5 = 4", f"'from ..' || {_OTHER_MODULE}"),
    _text("''", "'# comment ' || p_type", "''", "''", "''", "''", PY_CLASS,
          "'    \"\"\"Handles ' || p_name || '.\"\"\"'", "''", PY_RUN, PY_STEP, PY_SUM),
    "repeat('        y += 1' || chr(10), CAST(p_size % 4 AS INT))",
    _text("'        return y'", "''", "'    async def load(self,'", "'                   path=\")\"):'",
          "'        def inner():'", "'            return os.path'", "'        return inner'", "''", "''",
          PY_TAIL, PY_RETURN),
])

_JS = _text(
    _q("import React from 'react';"),
    _q("import { a } from './s") + f" || {_s('k + 1')} || " + _q("';"),
    _q("import {"), _q("  b,"), _q('} from "../lib/util";'),
    _q("import u from '../lib/util';"),
    _q("import './style.css';"),
    f"'class Widget' || {_s('k')} || " + _q(" {"),
    _q("  constructor(name) {"), _q("    this.name = name; // }"), _q("  }"),
    _q("  render() {"), _q("    if (this.name) {"), _q("      return { a: 1 };"), _q("    }"), _q("  }"), _q("}"),
    f"'function helper' || {_s('k')} || " + _q("(x) {"), _q("  return x;"), _q("}"),
)

_JAVA = _text(
    _q("package svc;"), _q("import java.util.List;"), _q("import static java.lang.Math.max;"),
    _q("import svc.util.*;"),
    f"'public class J' || {_s('k')} || " + _q(" {"),
    f"'    private int n = ' || {_s('k')} || ';'",
    _q("    public int get() {"), _q("        return n;"), _q("    }"),
    _q("    static class Inner {"), _q("        void reset() { }"), _q("    }"), _q("}"),
)

_GO = _text(
    _q("package main"), _q('import "fmt"'), _q("import ("), "chr(9) || " + _q('"net/http"'),
    "chr(9) || " + _q('str "strings" // alias'), _q(")"),
    f"'type G' || {_s('k')} || " + _q(" struct {"), "chr(9) || " + _q("n int"), _q("}"),
    f"'func (g *G' || {_s('k')} || " + _q(") Get() int {"), "chr(9) || " + _q("return g.n"), _q("}"),
    f"'func Make' || {_s('k')} || " + _q("() int {"), "chr(9) || " + _q("return 1"), _q("}"),
)


def _branch(repo_size: int, path: str, text: str, source: str) -> str:
    return (
        f"SELECT 'r' || {_s(_div('k', repo_size))} AS repo, 'c1' AS commit_sha, {path} AS path, "
        f"{text} AS content FROM ({source}) t"
    )


_PARTS = "SELECT p_partkey AS k, p_name, p_type, p_size FROM {part}"
_SUPPLIERS = "SELECT s_suppkey AS k FROM {supplier}"
_CUSTOMERS = "SELECT c_custkey AS k FROM {customer}"
_JS_END = "CASE k % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '.jsx' END"

V_PY = _branch(200, PY_PATH, _PY, _PARTS)

V_FILES = " UNION ALL ".join([
    V_PY,
    _branch(200, f"'pkg' || {_s(_div('k', 20))} || '/__init__.py'",
            _text(f"'from .m' || {_s('k')} || ' import C' || {_s('k')}"), f"{_PARTS} WHERE p_partkey % 20 = 0"),
    _branch(20, f"'web/src/s' || {_s('k')} || {_JS_END}", _JS, _SUPPLIERS),
    _branch(20, "'web/lib/util.js'", "''", f"{_SUPPLIERS} WHERE s_suppkey % 20 = 0"),
    _branch(500, f"'svc/J' || {_s('k')} || '.java'", _JAVA, f"{_CUSTOMERS} WHERE c_custkey % 2 = 0"),
    _branch(500, f"'go/g' || {_s('k')} || '.go'", _GO, f"{_CUSTOMERS} WHERE c_custkey % 2 = 1"),
])

# A whole checkout: the sources, what noise folders hold, and ignored files.
V_TREE = (
    "SELECT repo, path, content, CAST(length(content) AS BIGINT) AS length FROM v_files"
    " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'r' || {_s(_div('k', 200))} AS repo, {path} AS path, {text} AS content, {size} AS length "
        f"FROM ({_PARTS}) t{where}"
        for path, text, size, where in [
            (f"'node_modules/x' || {_s('k')} || '.js'", "p_name", "CAST(10 AS BIGINT)", ""),
            (f"'logs/a' || {_s('k')} || '.log'", "p_name", "CAST(10 AS BIGINT)", ""),
            (f"'logs/keep' || {_s('k')} || '.log'", "p_name", "CAST(10 AS BIGINT)", ""),
            (f"'out/o' || {_s('k')} || '.py'", "p_name", "CAST(10 AS BIGINT)", ""),
            (f"'sub/out/o' || {_s('k')} || '.py'", "p_name", "2000001 - k % 2", ""),
            ("'.gitignore'", _text("'*.log'", "'!keep*.log'", "'/out/'", "'# note'", "''"), "CAST(30 AS BIGINT)",
             " WHERE k % 200 = 0"),
        ]
    )
)

_TRACE_HEAD = "'Traceback (most recent call last):'"


def _frame(path: str, line: str, function: str) -> str:
    return f"'  File \"' || {path} || '\", line ' || {line} || ', in ' || {function}"


_TRACE_FILE = f"'/srv/r' || {_s(_div('k', 200))} || '/' || {PY_PATH}"

V_TRACES = (
    f"SELECT event_id AS failure_id, 'r' || {_s(_div('k', 200))} AS repo, "
    f"'/srv/r' || {_s(_div('k', 200))} AS repo_root, "
    "CASE WHEN event_type <> 'error' OR event_id % 13 = 0 THEN 'plain log line ' || CAST(event_id AS STRING) ELSE "
    + " || ".join([
        _text("'log line ' || CAST(event_id AS STRING)", _TRACE_HEAD, _frame("'/srv/old.py'", "'1'", "'old'"),
              "'    old()'", "'OldError: x'", "''",
              "'During handling of the above exception, another exception occurred:'", "''", _TRACE_HEAD),
        _when("event_id % 3 >= 1", _frame(_TRACE_FILE, "'40'", "'outer' || CAST(event_id AS STRING)")
              + " || chr(10) || '    call()'"),
        _when("event_id % 3 = 2", _frame(_TRACE_FILE, "'2'", "'<module>'")
              + " || chr(10) || '    mid = call()' || chr(10) || '          ~~~~^^'"),
        _frame(f"CASE WHEN event_id % 10 = 0 THEN '/usr/lib/site-packages/lib.py' ELSE {_TRACE_FILE} END",
               _s("event_id % 45 + 1"), "'run'") + " || chr(10)",
        _when("event_id % 5 > 0", "'        y = x[' || CAST(event_id AS STRING) || ']'"),
        "CASE event_id % 4 WHEN 0 THEN 'ValueError: bad value ' || CAST(CAST(FLOOR(value) AS BIGINT) AS STRING) "
        "WHEN 1 THEN 'KeyError' "
        "WHEN 2 THEN 'pkg.errors.Custom: first' || chr(10) || '  second line' || chr(10) || chr(10) || 'tail: text' "
        "ELSE '!! odd header' || chr(10) || 'run failed' END",
    ])
    + " END AS text "
    "FROM (SELECT event_id, event_type, value, (event_id * 7 + user_id) % (SELECT count(*) FROM {part}) AS k "
    "FROM {events}) t"
)

_FENCE = "'```'"
# A patch with three hunks: at the start, somewhere in the middle, at the end.
_DIFF = _text(
    f"'--- a/' || {PY_PATH}", f"'+++ b/' || {PY_PATH}",
    "'@@ -1,2 +1,3 @@'", f"' ' || {PY_FIRST}", "'+# patched'", "' def hidden(): pass'",
    "'@@ -19,3 +20,3 @@'", f"' ' || {PY_RUN}", f"CASE WHEN bad THEN '-        # no such line' ELSE '-' || {PY_STEP} END",
    "'+        # patched step'", f"' ' || {PY_SUM}",
    "'@@ -40,2 +41,2 @@'", f"' ' || {PY_TAIL}", f"'-' || {PY_RETURN}", "'+    return a - b'",
)

V_RESPONSES = (
    f"SELECT response_id, 'r' || {_s(_div('k', 200))} AS repo, 'Cause: ' || p_name || chr(10) || chr(10) || "
    "CASE kind "
    f"WHEN 0 THEN '### File: ' || CASE WHEN bad THEN '../' ELSE '' END || {PY_PATH} || chr(10) || {_FENCE} || 'python' || chr(10) || reply || chr(10) || {_FENCE} "
    f"WHEN 1 THEN {_FENCE} || 'diff' || chr(10) || {_DIFF} || {_FENCE} "
    f"WHEN 2 THEN '**File:** `' || {PY_PATH} || '`' || chr(10) || {_FENCE} || chr(10) || reply || chr(10) || {_FENCE} || chr(10)"
    f" || 'File: new/n' || {_s('k')} || '.py' || chr(10) || {_FENCE} || chr(10) || 'x = 1' || chr(10) || chr(10) || {_FENCE} "
    f"WHEN 3 THEN 'File: ' || {PY_PATH} || chr(10) || repeat('z', 250) || chr(10) || {_FENCE} || chr(10) || reply || chr(10) || {_FENCE} "
    "ELSE reply END AS text "
    "FROM (SELECT response_id, kind, bad, reply, t.k, p_name, p_size FROM "
    "(SELECT conv_id * 1000 + turn AS response_id, CASE WHEN role = 'assistant' THEN conv_id % 5 ELSE 5 END AS kind, (conv_id + turn) % 4 = 0 AS bad, "
    "replace(text, '```', '') AS reply, (conv_id * 3 + turn) % (SELECT count(*) FROM {part}) AS k "
    "FROM {conversations}) t "
    "JOIN (SELECT p_partkey AS k, p_name, p_size FROM {part}) p ON t.k = p.k) u"
)

V_RESULTS = (
    "SELECT user_id AS run_id, CAST(EXTRACT(DAY FROM ts) AS BIGINT) % 6 AS iteration, "
    "'tests/test_u.py::t' || CAST(event_id % 3 AS STRING) AS node_id, "
    "CASE WHEN SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 0 THEN 'passed' "
    "WHEN event_id % 3 = 2 THEN 'error' ELSE 'failed' END AS outcome "
    "FROM {events} GROUP BY user_id, CAST(EXTRACT(DAY FROM ts) AS BIGINT) % 6, event_id % 3"
)

V_ATTEMPTS = (
    "SELECT DISTINCT run_id, iteration, CASE (run_id * 7 + iteration) % 11 WHEN 0 THEN 'unparseable' "
    "WHEN 5 THEN 'not_applied' WHEN 9 THEN 'no_report' ELSE 'applied' END AS status "
    "FROM v_results WHERE iteration > 0"
)

V_USAGE = (
    "SELECT run_id, iteration, run_id * 10 + iteration * 100 AS baseline_tokens, "
    "run_id * 3 + iteration * 40 AS compressed_tokens, CAST(1 AS BIGINT) AS requests, run_id + iteration AS tokens_saved, "
    "'$' || CAST(run_id % 7 AS STRING) || '.' || CAST(10 + iteration AS STRING) AS cost_saved_usd FROM v_attempts"
)

V_COUNTERS = (
    "SELECT user_id AS session_id, event_id, (event_id % 1000) AS total_requests, "
    "(event_id % 1000) * 100 + CAST(FLOOR(value) AS BIGINT) % 100 AS input_tokens_original, "
    "(event_id % 1000) * 30 + CAST(FLOOR(value) AS BIGINT) % 30 AS input_tokens_compressed, "
    "'$' || CAST(CAST(FLOOR((event_id % 1000) / 100.0) AS BIGINT) AS STRING) || '.' || CAST(10 + event_id % 90 AS STRING) "
    "AS estimated_cost_saved_usd FROM {events}"
)

# Every order is an edge; a hundred customers are one repository.
V_EDGES = (
    f"SELECT DISTINCT 'g' || {_s('b')} AS repo, 'c' || CAST(o_custkey AS STRING) AS src, "
    "CASE WHEN o_orderkey % 10 = 0 THEN 'external:p' || CAST(o_orderkey % 70 AS STRING) "
    "ELSE 'c' || CAST(b * 100 + (o_orderkey * 31) % 100 AS STRING) END AS dst, "
    "CASE WHEN o_orderkey % 10 = 0 THEN 'external' ELSE 'repo_file' END AS dst_kind "
    f"FROM (SELECT o_custkey, o_orderkey, {_div('o_custkey', 100)} AS b FROM {{orders}}) t"
)

# The first targets of every node only: groups of files that import each other stay small, their ways round get long.
V_SPARSE = (
    "SELECT repo, src, dst, dst_kind FROM (SELECT *, row_number() OVER (PARTITION BY repo, src ORDER BY dst) AS place "
    "FROM v_edges WHERE dst_kind = 'repo_file') t WHERE place = 1 OR place = 2 AND src LIKE '%7'"
)

# A later snapshot of the Python files: some removed, some edited, some new.
V_NEXT = (
    "SELECT repo, path, replace(content, 'return y', 'return y + 1') AS content FROM v_py WHERE length(path) % 2 = 0 "
    "UNION ALL SELECT repo, path, content FROM v_py WHERE length(path) % 2 = 1 AND path NOT LIKE '%7.py' "
    "UNION ALL SELECT 'r' || " + _s(_div("k", 200)) + " AS repo, 'new/n' || " + _s("k")
    + " || '.py' AS path, p_name || chr(10) AS content FROM (" + _PARTS + " WHERE p_partkey % 9 = 0) t"
)

# The next snapshot with the last function of some files before everything else.
_NUMBER = "regexp_extract(path, '([0-9]+)[.]py$', 1)"
_LAST = f"'def f' || {_NUMBER} || '(a, b):' || chr(10) || {PY_RETURN} || chr(10)"
V_MOVED = (
    f"SELECT repo, path, CASE WHEN path LIKE '%4.py' THEN {_LAST} || replace(content, {_LAST}, '') "
    "WHEN path LIKE '%9.py' THEN replace(content, '        # step' || chr(10), '') ELSE content END AS content FROM v_next"
)

V_REFS = (
    "SELECT s_suppkey AS ref_id, CASE s_suppkey % 6 "
    "WHEN 0 THEN 'https://github.com/' || n_name || '/' || replace(s_name, '#', '-') "
    "WHEN 1 THEN 'git@github.com:' || n_name || '/' || replace(s_name, '#', '.') || '.git' "
    "WHEN 2 THEN '  ' || n_name || '/' || replace(s_name, '#', '_') || ' ' "
    "WHEN 3 THEN './' || s_name "
    "WHEN 4 THEN 'https://github.com/' || n_name || '/x/' "
    "ELSE s_name || '!!' END AS raw_input FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"
)

# Views in the order they build on each other.
VIEWS = {
    "v_py": V_PY,
    "v_files": V_FILES,
    "v_tree": V_TREE,
    "v_traces": V_TRACES,
    "v_responses": V_RESPONSES,
    "v_results": V_RESULTS,
    "v_attempts": V_ATTEMPTS,
    "v_usage": V_USAGE,
    "v_counters": V_COUNTERS,
    "v_edges": V_EDGES,
    "v_sparse": V_SPARSE,
    "v_next": V_NEXT,
    "v_moved": V_MOVED,
    "v_refs": V_REFS,
}
_NEEDS = {
    "v_tree": ("v_files",),
    "v_attempts": ("v_results",),
    "v_usage": ("v_attempts",),
    "v_next": ("v_py",),
    "v_sparse": ("v_edges",),
    "v_moved": ("v_next",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. How it is split is the session's matter (``spark.sql.files.*``)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out to tasks by their number. A file of narrow rows is too small for readers to split,
    and the task that reads it would make, scan and hand on texts of hundreds of times its size."""
    rows = df.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // MANY_ROWS))
    tasks = min(tasks, -(-rows // FEW_ROWS))
    return df.repartition(tasks) if tasks > 1 else df


def _with(names: tuple[str, ...]) -> list[str]:
    """The named views behind everything they need."""
    out: list[str] = []
    for n in names:
        for m in (*_with(_NEEDS.get(n, ())), n):
            if m not in out:
                out.append(m)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    names = _with((name,))
    sql = "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + f" SELECT * FROM {name}"
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    if name in TEXTS:
        used = {t: _dealt(df) if t in WIDE else df for t, df in used.items()}
    return spark.sql(sql, **used)


def oracle(sql: str, *names: str) -> str:
    """SQL text for the checking engine, with the named views in front.

    ``sql`` may itself start with ``WITH``.
    """
    plain = {t: t for t in TABLES}
    views = ", ".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in _with(names))
    body = sql.strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {views}, {body[len('WITH'):].strip()}"
    return f"WITH {views} {body}"
