"""Registered queries against their SQL, plan checks, and streams.

All queries are compared when TRIAGE_SF_DIR names a table folder; otherwise a
quick selection runs on the smallest one.
"""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from triage.operators import context as cx
from triage.operators import graph as g
from triage.operators import imports as im
from triage.operators import localize as lo
from triage.operators import symbols as sy
from triage.operators import vectors as ve
from triage.plans.oracles import ORACLES
from triage.plans.queries import QUERIES
from triage.plans.views import TABLES, view
from triage.streaming import jobs

SF_DIR = os.environ.get("TRIAGE_SF_DIR", "/root/testdata/sf0.001")
QUICK = [
    "document_facts", "unprocessed_files", "import_specs", "graph_cycles3", "page_links", "hashed_vectors",
    "knn_l2", "trace_summary", "compressed_documents", "context_pack", "run_outcomes", "loop_results",
    "apply_patches", "snapshot_diff", "counter_deltas", "failure_stream",
]
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()) if "TRIAGE_SF_DIR" in os.environ else QUICK)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = entry_point.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = con.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert got == want and got


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry_point.queries())


@needs_data
def test_same_view_text_in_both_engines(spark):
    assert view(spark, SF_DIR, "v_files").where("path like '%.py'").count() > 0


# --- plans ------------------------------------------------------------------------


def test_scans_are_narrow(make_files):
    f = make_files({"a.py": "import os\n"})
    for df in (sy.extract(f), im.parse(im.extract(f))):
        assert "Exchange" not in plan_of(df) and "Python" not in plan_of(df)


def test_limits_reach_the_map_side(spark):
    scored = spark.range(10_000).selectExpr("id % 3 as failure_id", "'r' as repo", "cast(id as string) as path", "rand() as score")
    assert "WindowGroupLimit" in plan_of(lo.top_files(scored))
    limited = scored.withColumn("_rn", F.expr("row_number() over (partition by failure_id order by path)")).where(
        F.col("_rn") <= 500)
    assert "WindowGroupLimit" in plan_of(limited)


def test_graph_walk_has_no_cross_join(spark):
    edges = spark.createDataFrame([("r", "a", "b", "repo_file")], "repo string, src string, dst string, dst_kind string")
    starts = edges.select("repo", F.col("src").alias("start"))
    plan = plan_of(g.neighborhood(edges, starts))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_search_has_no_cross_join(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    plan = plan_of(ve.top_k(df, df.withColumnRenamed("query_id", "chunk_id")))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# --- streams ----------------------------------------------------------------------


def test_failure_counts_sliding_window(spark):
    rows = [("2024-01-01 00:10:00", "failed", "E"), ("2024-01-01 00:40:00", "error", "E"),
            ("2024-01-01 00:50:00", "passed", "E"), ("2024-01-01 01:10:00", "failed", "K")]
    df = spark.createDataFrame(rows, "ts string, outcome string, exception_type string").withColumn("ts", F.to_timestamp("ts"))
    got = {(str(r.window_start)[11:16], r.exception_type): r.failures for r in jobs.failure_counts(df).collect()}
    assert got == {("00:00", "E"): 2, ("01:00", "K"): 1}
    slid = {(str(r.window_start)[11:16], r.exception_type): r.failures
            for r in jobs.failure_counts(df, slide="30 minutes").collect()}
    assert slid[("00:30", "E")] == 1 and slid[("00:30", "K")] == 1 and slid[("00:00", "E")] == 2


def test_index_stream_restarts_without_duplicates(spark, make_files, tmp_path):
    inbox, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def arrive(contents):
        make_files(contents).drop("language").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(inbox)

    def run():
        schema = spark.read.parquet(inbox).schema
        jobs.index_files(spark.readStream.schema(schema).parquet(inbox), out, state).awaitTermination()
        return sorted((r.path, r.qualified_name) for r in spark.read.parquet(f"{out}/symbols").collect())

    arrive({"a.py": "def f(): pass\n"})
    assert run() == [("a.py", "f")]
    assert run() == [("a.py", "f")]
    arrive({"a.py": "def f(): pass\n", "b.py": "def g(): pass\n"})
    arrive({"a.py": "def f(): pass\ndef h(): pass\n"})
    held = [("a.py", "f"), ("a.py", "f"), ("a.py", "h"), ("b.py", "g")]
    assert run() == held
    # another checkpoint sees everything again, and files may be years late: nothing is lost or repeated
    state = f"{state}-2"
    assert run() == held
    make_files({"old.py": "def o(): pass\n"}).drop("language").withColumn("ts", F.lit("1999-01-01").cast("timestamp")).write.mode("append").parquet(inbox)
    assert run() == [*held, ("old.py", "o")]


def test_failure_ledger_adds_up_queries_and_counts_no_file_twice(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(n, hour):
        rows = [(f"2024-01-01 {hour:02}:{i:02}:00", "failed", "E") for i in range(n)]
        df = spark.createDataFrame(rows, "ts string, outcome string, exception_type string").coalesce(1)
        df.withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(inbox)

    def run(state):
        stream = spark.readStream.schema("ts timestamp, outcome string, exception_type string").parquet(inbox)
        stream = stream.withColumn("file", jobs.from_file())
        jobs.count_failures(stream, out, str(tmp_path / state)).awaitTermination()
        return {str(r.window_start)[11:13]: r.failures for r in jobs.current_counts(spark, out).collect()}

    arrive(3, 0)
    assert run("a") == {"00": 3}
    arrive(4, 0)
    # another checkpoint reads the first file again and goes on with the second
    assert run("b") == {"00": 7}
    assert run("a") == {"00": 7}
    arrive(2, 5)
    assert run("c") == {"00": 7, "05": 2}
    assert run("b") == run("a") == {"00": 7, "05": 2}


def test_streamed_index_knows_what_each_path_holds(spark, make_files, tmp_path, monkeypatch):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(day, contents):
        there = {p: t for p, t in contents.items() if t is not None}
        rows = make_files(there).drop("language")
        gone = [("r", "c", p, 0, None) for p, t in contents.items() if t is None]
        rows = rows.unionByName(spark.createDataFrame(gone, rows.schema)) if gone else rows
        rows.withColumn("ts", F.lit(f"2024-01-{day:02}").cast("timestamp")).write.mode("append").parquet(inbox)

    def run(state):
        stream = spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox)
        jobs.index_files(stream, out, str(tmp_path / state)).awaitTermination()
        return sorted((r.path, r.name) for r in jobs.current(spark, out, "symbols").collect())

    one, two = "def f(): pass\n", "def g(): pass\n"
    arrive(1, {"a.py": one, "b.py": one, "e.py": ""})
    assert run("s") == [("a.py", "f"), ("b.py", "f")]
    arrive(2, {"a.py": two, "b.py": None})
    assert run("s") == [("a.py", "g")]
    arrive(3, {"a.py": one, "c.py": two})
    assert run("s") == [("a.py", "f"), ("c.py", "g")]
    assert {r.path for r in jobs.current(spark, out, "files").collect()} == {"a.py", "c.py", "e.py"}
    # an older state that comes late changes nothing
    arrive(2, {"c.py": "def old(): pass\n"})
    assert run("s") == [("a.py", "f"), ("c.py", "g")]
    # a batch dies when its tables are written but not its commit
    arrive(4, {"a.py": two + one, "d.py": two})
    with monkeypatch.context() as m:
        m.setattr(jobs.im, "extract", lambda *a, **k: 1 / 0)
        with pytest.raises(Exception, match="division"):
            run("s")
    assert sorted((r.path, r.name) for r in jobs.current(spark, out, "symbols").collect()) == [("a.py", "f"), ("c.py", "g")]
    # another checkpoint goes on, then the first one: nothing is lost, nothing there twice
    want = [("a.py", "f"), ("a.py", "g"), ("c.py", "g"), ("d.py", "g")]
    assert run("t") == want
    assert run("s") == want
    arrive(5, {"d.py": None, "b.py": two})
    assert run("t") == [("a.py", "f"), ("a.py", "g"), ("b.py", "g"), ("c.py", "g")]
