import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triage.functions import scale
from triage.functions.vectors import hashed_terms, normalize
from triage.operators import context as cx
from triage.operators import graph as g
from triage.operators import imports as im
from triage.operators import localize as lo
from triage.operators import symbols as sy
from triage.operators import tracebacks as tb
from triage.operators import vectors as ve

SIMPLE = '''log line
Traceback (most recent call last):
  File "/r/app.py", line 10, in main
    result = compute(5)
  File "/r/calc.py", line 3, in compute
    return 1 / 0
           ~~^~~
ZeroDivisionError: division by zero
'''
CHAINED = '''Traceback (most recent call last):
  File "/r/a.py", line 1, in first
    raise ValueError("x")
ValueError: x

During handling of the above exception, another exception occurred:

Traceback (most recent call last):
  File "/r/b.py", line 2, in second
    d["k"]
KeyError: 'k'
'''
ODD = {
    10: "Traceback (most recent call last):\nStopIteration\n",
    11: "Traceback (most recent call last):\n  File \"/r/a.py\", line 7, in <module>\n\n  ^^^^\n    x = 1\n    y = 2\n"
        "mod.Err: first\n  second\nthird\n\nunrelated: tail\n",
    12: "Traceback (most recent call last):\n",
    13: "Traceback (most recent call last):\n    stray\n  File \"/r/a.py\", line 1, in f\nnot a header line !\nmore\n",
    14: "  Traceback (most recent call last):\n  File \"/r/a.py\", line 1, in f\nE: x\n",
    15: "Traceback (most recent call last):\r\n  File \"/r/a.py\", line 1, in f\r\n    go()\r\nE:x\r\n",
}


def test_tracebacks(spark):
    rows = [(1, SIMPLE), (2, CHAINED), (3, "just text"), (4, ""), *ODD.items()]
    parsed = tb.parse(spark.createDataFrame(rows, "failure_id long, text string"))
    got = {r.failure_id: r for r in parsed.collect()}
    assert set(got) == {1, 2, 10, 11, 12, 13, 15}
    assert [(f.function_name, f.line_number, f.code_line) for f in got[1].frames] == [
        ("main", 10, "result = compute(5)"), ("compute", 3, "return 1 / 0")]
    assert (got[1].exception_type, got[1].message) == ("ZeroDivisionError", "division by zero")
    assert (got[2].exception_type, got[2].message, len(got[2].frames)) == ("KeyError", "'k'", 1)
    assert (got[10].exception_type, got[10].message, got[10].frames) == ("StopIteration", "", [])
    assert (got[11].exception_type, got[11].message) == ("mod.Err", "first second third")
    assert got[11].frames[0].code_line == "x = 1"
    assert (got[12].exception_type, got[12].message) == ("UnknownError", "")
    assert (got[13].exception_type, got[13].message) == ("UnknownError", "not a header line ! more")
    assert got[13].frames[0].code_line is None
    assert (got[15].exception_type, got[15].message, got[15].frames[0].code_line) == ("E", "x", "go()")
    flat = {(r.failure_id, r.pos, r.function_name) for r in tb.frames(parsed, "failure_id").collect()}
    assert {(1, 0, "main"), (1, 1, "compute"), (2, 0, "second")} <= flat
    ends = parsed.select("failure_id", tb.innermost(F.col("frames")).alias("i"), tb.outermost(F.col("frames")).alias("o"))
    ends = {r.failure_id: (r.i and r.i.function_name, r.o and r.o.function_name) for r in ends.collect()}
    assert ends[1] == ("compute", "main") and ends[10] == (None, None)


def test_tracebacks_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, SIMPLE)], "failure_id long, text string")
    plan = tb.parse(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


SYMBOLS = "repo string, path string, pos int, name string, qualified_name string, kind string, start_line int, end_line int"


def test_anchor_symbol(spark):
    symbols = spark.createDataFrame([
        ("r", "m.py", 0, "User", "User", "class", 1, 20), ("r", "m.py", 1, "save", "User.save", "method", 5, 10),
        ("r", "m.py", 2, "a", "a", "function", 30, 31), ("r", "m.py", 3, "b", "b", "function", 30, 31)], SYMBOLS)
    anchors = spark.createDataFrame(
        [(1, "r", "m.py", 7), (2, "r", "m.py", 2), (3, "r", "m.py", 99), (4, "r", "x.py", 1), (5, "r", "m.py", 30)],
        "failure_id long, repo string, path string, line_number int")
    got = {r.failure_id: r.symbol for r in lo.anchor_symbol(anchors, symbols).collect()}
    assert got == {1: "User.save", 2: "User", 3: None, 4: None, 5: "a"}


def test_anchor_symbol_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        start = rng.choice([rng.randint(1, 400), rng.randint(1, 100_000)])
        end = start + rng.choice([0, 1, 7, 40, 300, 5000, 200_000])
        rows.append(("r", f"f{i % 3}.py", i, f"n{i}", f"q{i}", "function", start, end))
    rows.append(("r", "f0.py", 900, "all", "all", "class", 1, 2**31 - 1))
    anchors = [(i, "r", f"f{i % 3}.py", rng.choice([rng.randint(1, 500), rng.randint(1, 310_000)])) for i in range(600)]
    want = {}
    for i, _, path, line in anchors:
        inside = [(e - s, pos, q) for _, p, pos, _, q, _, s, e in rows if p == path and s <= line <= e]
        want[i] = min(inside)[2] if inside else None
    df = spark.createDataFrame(anchors, "failure_id long, repo string, path string, line_number int")
    found = lo.anchor_symbol(df, spark.createDataFrame(rows, SYMBOLS))
    assert {r.failure_id: r.symbol for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "NestedLoop" not in plan and "partial_min" in plan


def test_anchor_file(spark):
    text = SIMPLE.replace("/r/calc.py", "/usr/lib/site-packages/z.py")
    df = spark.createDataFrame([(1, "r", "/r", SIMPLE), (2, "r", "/r/", text)],
                               "failure_id long, repo string, repo_root string, text string")
    parsed = tb.parse(df)
    assert {(r.failure_id, r.path, r.line_number) for r in lo.anchor_file(parsed).collect()} == {(1, "calc.py", 3)}
    assert {(r.failure_id, r.path) for r in lo.anchor_file(parsed, first_repo_frame=True).collect()} == {
        (1, "calc.py"), (2, "app.py")}


def signals(spark, rows):
    return spark.createDataFrame([(1, "r", *r) for r in rows], lo.SIGNAL)


def test_scores(spark):
    s = signals(spark, [
        ("anchor.py", 1.0, "anchor", 0, "f"), ("other.py", 0.495, "semantic", None, "z"),
        ("utils.py", 0.6, "structural", 1, None), ("utils.py", 0.4, "semantic", None, "b"),
        ("utils.py", 0.1, "semantic", None, "a"), ("far.py", 0.3, "structural", 2, None),
        ("neg.py", -0.05, "semantic", None, "n")])
    rows = lo.rank(lo.score(s)).orderBy("rank").collect()
    assert [(r.path, r.score, r.rank) for r in rows] == [
        ("utils.py", 1.1, 1), ("anchor.py", 1.0, 2), ("other.py", 0.495, 3), ("far.py", 0.3, 4), ("neg.py", -0.05, 5)]
    assert rows[0].sources == ["structural", "semantic"] and rows[0].relevant_symbols == ["a", "b"]
    assert rows[0].hop_distance == 1 and rows[1].hop_distance == 0 and rows[2].hop_distance is None
    assert [r.path for r in lo.top_files(lo.score(s), 2).orderBy("rank").collect()] == ["utils.py", "anchor.py"]


def test_query_text(spark):
    df = spark.createDataFrame([(1, "E", "m", "user"), (2, None, None, "user"), (3, "E", "", ""), (4, None, None, " ")],
                               "failure_id long, exception_type string, message string, description string")
    got = {r.failure_id: r.query for r in lo.with_query(df, F.col("description")).collect()}
    assert got == {1: "E: m — user", 2: "user", 3: "E: "}


def test_end_to_end(spark, make_files):
    f = make_files({"app/main.py": "from . import utils\ndef run():\n    return utils.x()\n", "app/utils.py": "def x(): pass\n"})
    symbols = sy.extract(f)
    edges = g.build_edges(im.resolve(im.parse(im.extract(f)), f))
    log = 'Traceback (most recent call last):\n  File "/w/app/main.py", line 3, in run\n    x()\nValueError: bad input\n'
    parsed = tb.parse(spark.createDataFrame([(7, "r", "/w", log)], "failure_id long, repo string, repo_root string, text string"))
    anchors = lo.anchor_symbol(lo.anchor_file(parsed), symbols)
    vectors = ve.index(f, symbols)
    queries = ve.embed(lo.with_query(parsed), "query").withColumnRenamed("failure_id", "query_id")
    hits = ve.top_k(queries, vectors, k=10, scope=("repo",))
    named = hits.join(vectors.select("repo", "chunk_id", "path", "qualified_name"), ["repo", "chunk_id"])
    scored = lo.score(
        lo.anchor_signals(anchors), lo.structural_signals(anchors, edges),
        lo.semantic_signals(named.withColumnRenamed("query_id", "failure_id")))
    rows = lo.top_files(scored, 5).orderBy("rank").collect()
    assert [r.path for r in rows] == ["app/main.py", "app/utils.py"]
    assert rows[0].relevant_symbols == ["run"]

    ranked = lo.rank(scored)
    wanted = cx.units(ranked, f, symbols)
    texts = cx.unit_texts(wanted, f, symbols)
    counted = cx.attach_counts(wanted, texts)
    packed = cx.pack(counted, ["failure_id"], ["rank", "unit_rank"])
    ctx = cx.assemble(packed, texts)
    body = ctx.first().assembled_text
    assert body == ("# File: app/main.py — Symbol: run\ndef run():\n    return utils.x()\n\n"
                    "# File: app/utils.py — Symbol: x\ndef x(): pass")
    prompt = cx.prompts(parsed, ctx).first().prompt
    assert prompt.startswith("## Failure\nValueError: bad input\nRaised at /w/app/main.py:3 in run\n\n## Relevant code context\n# File")


# --- vectors ----------------------------------------------------------------------


def brute(queries, chunks, k, metric):
    import numpy as np
    out = {}
    for qid, q in queries:
        q = np.array(q, dtype=float)
        scored = []
        for cid, c in chunks:
            c = np.array(c, dtype=float)
            if metric == "cosine":
                d = np.linalg.norm(q) * np.linalg.norm(c)
                s = float(q @ c / d) if d else 0.0
            else:
                s = 1 - float(((q - c) ** 2).sum())
            scored.append((-round(s, 6), cid))
        out[qid] = [c for _, c in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_top_k_blocks(spark, metric):
    rnd = random.Random(5)
    vec = lambda: [float(rnd.randrange(-3, 4)) for _ in range(4)]
    queries = [(i, vec()) for i in range(23)]
    chunks = [(i, vec()) for i in range(61)] + [(99, [0.0] * 4)]
    qdf = spark.createDataFrame(queries, "query_id int, embedding array<double>")
    cdf = spark.createDataFrame(chunks, "chunk_id int, embedding array<double>")
    want = brute(queries, chunks, 7, metric)
    for blocks in ((8192, 1024), (10, 5)):
        rows = ve.top_k(qdf, cdf, 7, metric, chunk_block=blocks[0], query_block=blocks[1]).orderBy("query_id", "rank").collect()
        got = {}
        for r in rows:
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want


def test_top_k_scope_clamp_and_empty(spark):
    q = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("z", 2, [1.0, 0.0])], "repo string, query_id int, embedding array<float>")
    c = spark.createDataFrame([("a", "x", [2.0, 0.0]), ("a", "y", [0.0, 3.0]), ("b", "w", [1.0, 0.0])],
                              "repo string, chunk_id string, embedding array<float>")
    rows = ve.top_k(q, c, 5, scope=("repo",)).orderBy("rank").collect()
    assert [(r.repo, r.query_id, r.chunk_id, r.score, r.rank) for r in rows] == [("a", 1, "x", 1.0, 1), ("a", 1, "y", 0.0, 2)]
    assert ve.top_k(q, c.where("false"), 5, scope=("repo",)).count() == 0
    with pytest.raises(ValueError):
        ve.top_k(q, c, metric="dot")


def test_upsert(spark):
    s = "chunk_id string, version int, v int"
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 2)], s)
    b = spark.createDataFrame([("x", 2, 9), ("z", 2, 3)], s)
    assert {(r.chunk_id, r.v) for r in ve.upsert(a, b, keys=("chunk_id",)).collect()} == {("x", 9), ("y", 2), ("z", 3)}


def test_vector_functions(spark):
    import hashlib
    text = "a b a été b a"
    row = spark.range(1).select(
        hashed_terms(F.lit(text), 8).alias("h"), normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("n"),
        normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z")).first()
    want = [0.0] * 8
    for t in text.split():
        want[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 8] += 1
    assert row.h == want and row.n == [0.6, 0.8] and row.z == [0.0, 0.0]


# --- packing and context ----------------------------------------------------------


def greedy(sizes, budget):
    left, taken = budget, []
    for i, s in enumerate(sizes):
        if s <= left:
            taken.append(i)
            left -= s
    return taken


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_pack_against_greedy(spark, ranges):
    rnd = random.Random(ranges)
    groups = {0: [50, 60, 40, 20, 10], 1: [rnd.randrange(0, 40) for _ in range(60)],
              2: [rnd.choice([0, 1, 99, 100, 101]) for _ in range(40)], 3: [200, 300],
              # one hot group over most ranges: small units at first, at the end, and none that fits
              4: [rnd.choice([1, 97]) for _ in range(600)], 5: [99] * 300 + [1] * 5, 6: [rnd.randrange(1, 101) for _ in range(900)]}
    rows = [(k, i, s) for k, sizes in groups.items() for i, s in enumerate(sizes)] + [(7, 0, None)]
    df = spark.createDataFrame(rows, "failure_id int, rank int, compressed_tokens int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {}
        for r in cx.pack(df, ["failure_id"], ["rank"], 100).collect():
            got.setdefault(r.failure_id, []).append(r.rank)
        assert cx.pack(df.where("false"), ["failure_id"], ["rank"], 100).count() == 0
        assert {r.rank for r in cx.pack(df, ["failure_id"], ["rank"], 0).collect()} == {
            i for _, i, s in rows if s == 0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {k: sorted(v) for k, v in got.items()} == {
        k: greedy(s, 100) for k, s in groups.items() if greedy(s, 100)}


def test_steps_tell_what_any_room_becomes():
    from triage.operators.packing import Steps, take
    rnd = random.Random(9)
    for _ in range(50):
        budget = rnd.randrange(0, 200)
        sizes = [rnd.randrange(1, 1 + rnd.choice([5, 80, 250])) for _ in range(rnd.randrange(0, 300))]
        steps = Steps(budget)
        steps.apply(np.array(sizes[:70], dtype=np.int64))
        steps.apply(np.array(sizes[70:], dtype=np.int64))
        pieces = steps.pieces()
        for room in {0, budget // 3, budget}:
            want = greedy(sizes, room)
            places, left = take(np.array(sizes, dtype=np.int64), room)
            assert places.tolist() == want and left == room - sum(sizes[i] for i in want)
            uses = [p["uses"] for p in pieces if p["since"] <= room][-1]
            assert room - uses == left


def test_units(spark, make_files):
    f = make_files({"app.py": "def add():\n    return 1\n# c\ndef sub():\n    return 2\ndef add():\n    return 3\n", "w.py": "x = 1\n"})
    symbols = sy.extract(f)
    ranked = spark.createDataFrame([
        (1, "r", "app.py", 1, 2.0, ["add", "nope"]), (1, "r", "w.py", 2, 1.0, []), (1, "r", "external:os", 3, 0.5, [])],
        "failure_id long, repo string, path string, rank int, score double, relevant_symbols array<string>")
    wanted = cx.units(ranked, f, symbols)
    texts = {(r.path, r.symbol_name): r.raw_text for r in cx.unit_texts(wanted, f, symbols).collect()}
    assert texts == {("app.py", "add"): "def add():\n    return 3", ("w.py", None): "x = 1\n"}
    whole = cx.units(ranked, f, symbols, indexed=f.where("path = 'w.py'"))
    assert {(r.path, r.symbol_name) for r in whole.collect()} == {("app.py", None), ("w.py", None)}


# --- numbering of hot groups ------------------------------------------------------


def test_number_and_lag(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rnd.randrange(1000)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(4)
    numbered = scale.number_rows(df, ["k"], [F.col("v").desc(), F.col("i")], "n").collect()
    want = {}
    for k in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        want.update({(k, r[1]): n + 1 for n, r in enumerate(part)})
    assert {(r.k, r.i): r.n for r in numbered} == want and len(numbered) == 300
    lagged = scale.lag_rows(df, ["k"], [F.col("i")], {"before": "v"}).collect()
    want = {}
    for k in {r[0] for r in rows}:
        last = None
        for r in sorted(r for r in rows if r[0] == k):
            want[(k, r[1])] = last
            last = r[2]
    assert {(r.k, r.i): r.before for r in lagged} == want and len(lagged) == 300


def test_superseded_tables_are_deleted(spark):
    held = scale.stage(spark.range(3))
    folder = held.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder)
    scale.unstage(held)
    assert not os.path.isdir(folder)


def test_broadcast_only_when_small(spark):
    assert scale.is_small(spark.range(10), 10) and not scale.is_small(spark.range(11), 10)
