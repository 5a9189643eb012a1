"""Line scans and term counts on batches of texts."""

from pyspark.sql import functions as F

from triage.functions.vectors import hashed_terms
from triage.operators import imports as im
from triage.operators import symbols as sy


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_and_counts_are_no_folds_over_lines(spark, make_files):
    f = make_files({"a.py": "import os\n"})
    for df in (sy.extract(f), im.extract(f), f.select(hashed_terms(F.col("content")))):
        assert "aggregate(" not in plan(df) and "transform(" not in plan(df) and "Exchange" not in plan(df)


def test_long_literals_and_odd_rows(spark, make_files):
    long = "a" * 200_000
    text = f'x = "{long}"\ndef after():\n    """Doc."""\n    return "{long}"\nimport os\n'
    f = make_files({"a.py": text, "b.go": 'import (\n\t"net/http"\n\ts "strings" // no "x"\n)\nfunc F() {}\n', "c.js": "", "d.rb": "def x"})
    f = f.unionByName(f.limit(1).withColumn("content", F.lit(None).cast("string")))
    got = {(r.path, r.qualified_name, r.start_line, r.end_line, r.docstring) for r in sy.extract(f).collect()}
    assert got == {("a.py", "after", 2, 4, "Doc."), ("b.go", "F", 5, 5, None)}
    raw = {(r.path, r.pos, r.raw_import) for r in im.extract(f).collect()}
    assert raw == {("a.py", 0, "import os"), ("b.go", 0, '"net/http"'), ("b.go", 1, 's "strings"')}


def test_counts_of_null_and_blank_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " a b \x0bc ")], "i int, t string").coalesce(1)
    got = {r.i: r.h for r in df.select("i", hashed_terms(F.col("t"), 4).alias("h")).collect()}
    assert got[1] is None and got[2] == [0.0] * 4 and sum(got[3]) == 2
