import random

import pytest
from pyspark.sql import functions as F

from triage.operators import graph as g
from triage.operators import imports as im


def parse_one(spark, language, raw):
    df = spark.createDataFrame([("r", "c", "p", language, 0, raw)],
                               "repo string, commit_sha string, path string, language string, pos int, raw_import string")
    return im.parse(df).first()


@pytest.mark.parametrize("language,raw,expected", [
    ("python", "import os", ("os", [], False, 0)),
    ("python", "import a.b, c", ("a.b", [], False, 0)),
    ("python", "from typing import List, Dict as D", ("typing", ["List", "Dict"], False, 0)),
    ("python", "from ..utils import helper", ("utils", ["helper"], True, 2)),
    ("python", "from . import a", ("", ["a"], True, 1)),
    ("python", "from x import (a, b)", ("x", ["(a", "b)"], False, 0)),
    ("python", "from x import (\n    a,\n)", (None, None, None, None)),
    ("javascript", "import { foo } from './bar'", ("./bar", [], True, 0)),
    ("typescript", "import React from 'react'", ("react", [], False, 0)),
    ("javascript", "import './style.css';", ("./style.css", [], True, 0)),
    ("java", "import static a.b.C.d;", ("a.b.C.d", [], False, 0)),
    ("java", "import a.b.*;", ("a.b.", [], False, 0)),
    ("go", '"net/http"', ("net/http", [], False, 0)),
    ("go", 'str "strings"', (None, None, None, None)),
    ("unknown", "import os", (None, None, None, None)),
])
def test_parse(spark, language, raw, expected):
    r = parse_one(spark, language, raw)
    assert (r.module, r.imported_names, r.is_relative, r.relative_level) == expected


REPO = {
    "pkg/service.py": "from . import models\nimport numpy\n",
    "pkg/models.py": "",
    "pkg/utils.py": "",
    "pkg/__init__.py": "import pkg.models\n",
    "pkg/sub/service.py": "from .. import utils\nfrom ..nothing import x\nfrom . import gone, deep\n",
    "pkg/sub/deep.py": "from pkg import y\nfrom __future__ import annotations\n",
    "src/app.js": "import './utils';\nimport u from '../lib/u';\nimport r from 'react';\nimport e from './e.js';\n"
                  "import o from '../../out';\n",
    "src/utils.js": "", "src/utils.ts": "", "lib/u/index.js": "", "src/e.js": "",
    "m.java": "import java.util.List;\n",
}


def edges_of(make_files, contents, **options):
    f = make_files(contents)
    resolved = im.resolve(im.parse(im.extract(f)), f, **options)
    return f, resolved, g.build_edges(resolved)


def test_resolution(make_files):
    _, _, edges = edges_of(make_files, REPO)
    got = {(r.src, r.dst) for r in edges.collect()}
    assert got == {
        ("pkg/service.py", "pkg/models.py"), ("pkg/service.py", "external:numpy"),
        ("pkg/__init__.py", "pkg/models.py"),
        ("pkg/sub/service.py", "pkg/utils.py"), ("pkg/sub/service.py", "external:nothing"),
        ("pkg/sub/service.py", "pkg/sub/deep.py"),
        ("pkg/sub/deep.py", "pkg/__init__.py"),
        ("src/app.js", "src/utils.js"), ("src/app.js", "lib/u/index.js"), ("src/app.js", "external:react"),
        ("src/app.js", "src/e.js"), ("src/app.js", "external:../../out"),
        ("m.java", "external:java.util.List"),
    }


def test_compat_leaves_parent_imports_external(make_files):
    _, _, edges = edges_of(make_files, REPO, compat=True)
    got = {r.dst for r in edges.where("src = 'src/app.js'").collect()}
    assert got == {"src/utils.js", "external:../lib/u", "external:react", "external:./e.js", "external:../../out"}


def test_all_names(make_files):
    contents = {"a.py": "from . import b, c\n", "b.py": "", "c.py": ""}
    _, _, first = edges_of(make_files, contents)
    assert {r.dst for r in first.collect()} == {"b.py"}
    _, _, every = edges_of(make_files, contents, all_names=True)
    assert {r.dst for r in every.collect()} == {"b.py", "c.py"}


def test_mutual_imports(make_files):
    f, resolved, edges = edges_of(make_files, {
        "app/main.py": "from . import utils\nimport os\nimport os\n", "app/utils.py": "from . import main\n",
        "app/lonely.py": ""})
    assert g.edge_list(resolved).count() == 4 and edges.count() == 3
    starts = f.select("repo", F.lit("app/utils.py").alias("start")).distinct()
    back = {(r.path, r.hop) for r in g.reach(edges, starts, 1, "in").collect()}
    assert back == {("app/main.py", 1)}
    back = {(r.path, r.hop) for r in g.reach(edges, starts, 2, "in").collect()}
    assert back == {("app/main.py", 1), ("app/utils.py", 2)}
    near = {(r.path, r.hop) for r in g.neighborhood(edges, starts).collect()}
    assert near == {("app/main.py", 1), ("external:os", 2)}
    near = {r.path for r in g.neighborhood(edges, starts, drop_external=True).collect()}
    assert near == {"app/main.py"}
    cyc = g.cycles(edges)
    assert [r.cycle for r in cyc.collect()] == [["app/main.py", "app/utils.py"]]
    s = g.stats(f, edges, g.cyclic_groups(edges)).first()
    assert (s.total_files, s.total_edges, s.external_dependencies, s.cyclic_groups) == (3, 3, 1, 1)
    assert {r.path for r in g.out_neighbors(edges, starts).collect()} == {"app/main.py"}
    assert {r.path for r in g.in_neighbors(edges, starts).collect()} == {"app/main.py"}
    assert g.reach(edges, starts, 0).count() == 0


def random_graph(spark, seed, n, m):
    rnd = random.Random(seed)
    pairs = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}
    rows = [("r", f"n{a:02d}", f"n{b:02d}", "repo_file") for a, b in pairs]
    return {(x[1], x[2]) for x in rows}, spark.createDataFrame(rows, "repo string, src string, dst string, dst_kind string")


def bfs(pairs, start, depth):
    seen, front = {}, {start}
    for hop in range(1, depth + 1):
        front = {b for a, b in pairs if a in front} - set(seen)
        seen.update({n: hop for n in front})
    return seen


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_reach_against_bfs(spark, depth):
    pairs, edges = random_graph(spark, depth, 25, 50)
    starts = edges.select("repo", F.col("src").alias("start")).distinct()
    for direction in ("out", "in"):
        got = {(r.start, r.path): r.hop for r in g.reach(edges, starts, depth, direction).collect()}
        used = pairs if direction == "out" else {(b, a) for a, b in pairs}
        want = {(s, p): h for s in {a for a, _ in pairs} for p, h in bfs(used, s, depth).items()}
        assert got == want


def simple_cycles(pairs, longest):
    nodes = sorted({x for p in pairs for x in p})
    out = {n: sorted(b for a, b in pairs if a == n) for n in nodes}
    found = set()

    def grow(path):
        for b in out[path[-1]]:
            if b == path[0]:
                found.add(tuple(path))
            elif b > path[0] and b not in path and len(path) < longest:
                grow([*path, b])

    for n in nodes:
        grow([n])
    return found


@pytest.mark.parametrize("seed,max_len", [(1, None), (2, 3), (3, 4)])
def test_cycles_against_search(spark, seed, max_len):
    pairs, edges = random_graph(spark, seed, 9, 18)
    rows = g.cycles(edges, max_len).collect()
    got = [tuple(r.cycle) for r in rows]
    assert len(got) == len(set(got))
    assert set(got) == simple_cycles(pairs, max_len or 9)
    assert all(r.length == len(r.cycle) for r in rows)


@pytest.mark.parametrize("seed,n,m", [(1, 20, 30), (3, 12, 40)])
def test_cyclic_groups_against_reachability(spark, seed, n, m):
    pairs, edges = random_graph(spark, seed, n, m)
    reached = {s: set(bfs(pairs, s, n + 1)) for s in {x for p in pairs for x in p}}
    want = {}
    for s in reached:
        if s in reached[s]:
            group = {t for t in reached[s] if s in reached[t]}
            want[s] = min(group)
    got = {r.node: r.group_id for r in g.cyclic_groups(edges).collect()}
    assert got == want


def test_labels_of_groups_do_not_pass_the_driver(spark):
    """Joins of small staged tables are not broadcast round after round."""
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a")], "repo string, src string, dst string")
    labels = spark.createDataFrame([("r", "a", "x"), ("r", "b", "x")], "repo string, node string, label string")
    same = g._same_label(edges, labels)
    assert "Broadcast" not in same._jdf.queryExecution().executedPlan().toString()
    assert sorted(same.collect()) == [("r", "a", "b"), ("r", "b", "a")]
