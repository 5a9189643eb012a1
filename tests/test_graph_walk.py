"""The walk over the graph reads its edges once and serves few starts and many alike."""

import random

import pytest
from pyspark.sql import functions as F

from triage.operators import graph as g

EDGES = "repo string, src string, dst string, dst_kind string"


def test_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    rows = [("r", f"n{i % 9}", f"n{i % 7}", "repo_file") for i in range(40)]
    edges = spark.createDataFrame(rows, EDGES).withColumn("src", F.udf(seen)("src"))
    starts = spark.createDataFrame([("r", "n1"), ("r", "n2")], "repo string, start string")
    g.neighborhood(edges, starts).collect()
    assert made.value == 40


def test_names_are_looked_up_last(spark):
    rows = [("r", f"n{i % 9}", f"n{i % 7}", "repo_file") for i in range(40)]
    edges = spark.createDataFrame(rows, EDGES)
    near = g.neighborhood(edges, edges.select("repo", F.col("src").alias("start")))
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "word" in joins[0] and not any("word" in j for j in joins[1:])


def near(edges, start, depth, drop_external):
    """Shortest distances by breadth-first search, each direction by itself."""
    out, back = {}, {}
    for _, a, b, kind in edges:
        if a is None or b is None:
            continue
        if not (drop_external and b.startswith("external:")):
            out.setdefault(a, set()).add(b)
        if kind == "repo_file":
            back.setdefault(b, set()).add(a)
    found = {}
    for links in (out, back):
        front, met = {start}, {}
        for hop in range(1, depth + 1):
            front = {b for a in front for b in links.get(a, ())} - set(met)
            met.update(dict.fromkeys(front, hop))
        for b, hop in met.items():
            if b != start:
                found[b] = min(hop, found.get(b, hop))
    return {(start, b, hop) for b, hop in found.items()}


@pytest.mark.parametrize("drop_external", [False, True])
@pytest.mark.parametrize("depth", [1, 2, 3])
def test_few_starts_and_all_of_them(spark, depth, drop_external):
    rnd = random.Random(depth)
    rows = []
    for _ in range(160):
        a, b = (f"n{rnd.randrange(150):03d}" for _ in range(2))
        kind = rnd.choice(["repo_file", "repo_file", "external", None])
        rows.append(("r", a, f"external:{b}" if kind == "external" else b, kind))
    rows += [("r", "n001", "n001", "repo_file"), ("r", "n002", None, "external"), ("r", None, "n003", "repo_file"), (None, "n004", "n005", "repo_file")]
    rows += rows[:20]  # repeated
    edges = spark.createDataFrame(rows, EDGES)
    sources = sorted({r[1] for r in rows if r[0] and r[1]})
    everywhere = sorted({x for r in rows if r[0] for x in r[1:3] if x})
    for starts in (sources[:3] + ["unknown"], everywhere):
        asked = spark.createDataFrame([("r", s) for s in starts] * 2, "repo string, start string")
        got = g.neighborhood(edges, asked, depth, drop_external).collect()
        want = set().union(*(near([r for r in rows if r[0]], s, depth, drop_external) for s in starts))
        assert len(got) == len(want) and {(r.start, r.path, r.hop) for r in got} == want
