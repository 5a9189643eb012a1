"""The file dependency graph: edges, bounded reach, cycles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.functions.scale import stage, unstage

# Node kinds and the name of a node outside the repository.
REPO_FILE = "repo_file"
EXTERNAL = "external"
EXTERNAL_PREFIX = "external:"


def edge_list(resolved: DataFrame) -> DataFrame:
    """One edge per resolved statement (repeats kept), unresolved ones to ``external:``."""
    return resolved.select(
        "repo",
        F.col("path").alias("src"),
        F.coalesce("target", F.concat(F.lit(EXTERNAL_PREFIX), F.col("module"))).alias("dst"),
        F.when(F.col("target").isNull(), EXTERNAL).otherwise(REPO_FILE).alias("dst_kind"),
        "imported_names",
    )


def build_edges(resolved: DataFrame) -> DataFrame:
    """Distinct edges of the graph."""
    return edge_list(resolved).select("repo", "src", "dst", "dst_kind").distinct()


def nodes(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Every indexed file, with or without edges, and every external module."""
    own = files.select("repo", F.col("path").alias("node"), F.lit(REPO_FILE).alias("kind"))
    outside = edges.where(F.col("dst_kind") == EXTERNAL).select(
        "repo", F.col("dst").alias("node"), F.lit(EXTERNAL).alias("kind")
    )
    return own.unionByName(outside).distinct()


def out_neighbors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """What each start imports, externals included: ``repo, start, path``."""
    step = edges.select("repo", F.col("src").alias("start"), F.col("dst").alias("path"))
    return step.join(starts.select("repo", "start").distinct(), ["repo", "start"], "left_semi").distinct()


def in_neighbors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """What imports each start: ``repo, start, path``."""
    step = edges.select("repo", F.col("dst").alias("start"), F.col("src").alias("path"))
    return step.join(starts.select("repo", "start").distinct(), ["repo", "start"], "left_semi").distinct()


def _arcs(edges: DataFrame, out: Column, back: Column) -> DataFrame:
    """``repo, src, dst, out, back``: the edges, made once, and the directions in which each may be walked."""
    ways = [F.coalesce(c, F.lit(False)).alias(n) for n, c in (("out", out), ("back", back))]
    return stage(edges.select("repo", "src", "dst", *ways).where("out or back"), "graph-arcs")


# Nodes whose bits share a 64-bit word; a word is one row.
_WORD = 64


def _numbered(arcs: DataFrame) -> DataFrame:
    """``repo, node, id``: numbers that rise with (repo, node) and have no gaps inside a partition,
    so the nodes of a repository fill few words and each word is full up to its last node."""
    points = reduce(DataFrame.unionByName, [arcs.select("repo", F.col(c).alias("node")) for c in ("src", "dst")]).distinct()
    return stage(
        points.repartitionByRange("repo", "node").sortWithinPartitions("repo", "node")
        .withColumn("id", F.monotonically_increasing_id()),
        "graph-nodes",
    )


def _within(front: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """``a``: places at most ``hops`` steps behind the starts, all starts in one walk."""
    seen = front
    for _ in range(hops):
        front = links.join(front, "a", "left_semi").select(F.col("b").alias("a")).distinct()
        front = stage(front.join(seen, "a", "left_anti"), "graph-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _walk(starts: DataFrame, arcs: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(sets of each hop as ``a, word, bits``, numbers of the starts, numbers of the nodes) within ``depth`` steps.

    The nodes at distance h + 1 of a node are those at distance h of its neighbours that it has not
    met before. So all nodes that a start can meet hand their sets on together, one row for each
    word of 64 nodes, and a hop costs a join over the edges and an aggregate of ``bit_or``, not a
    row for every pair. The start itself is met only when a cycle leads back to it. A node has a
    place for each direction (twice its number, and one more to walk back), which never meet.
    """
    ids = _numbered(arcs)
    src, dst = [ids.select("repo", F.col("node").alias(n), F.col("id").alias(x)) for n, x in (("src", "a"), ("dst", "b"))]
    pairs = arcs.join(src, ["repo", "src"]).join(dst, ["repo", "dst"]).groupBy("a", "b")
    pairs = stage(pairs.agg(F.bool_or("out").alias("out"), F.bool_or("back").alias("back")), "graph-links")
    begin = stage(starts.select("repo", F.col("start").alias("node")).distinct().join(ids, ["repo", "node"]), "graph-starts")
    if depth < 1:
        return [], begin, ids
    links = pairs.where("out").selectExpr("2 * a as a", "2 * b as b").unionByName(
        pairs.where("back").selectExpr("2 * b + 1 as a", "2 * a + 1 as b")
    )
    if 2 * begin.count() < ids.count():  # else few nodes would be left out
        front = begin.select(F.explode(F.expr("array(2 * id, 2 * id + 1)")).alias("a"))
        links = stage(links.join(_within(front, links, depth - 1), "a", "left_semi"), "graph-links")
    word, bit = F.expr(f"b div {2 * _WORD}").alias("word"), F.expr(f"shiftleft(1L, cast(b div 2 % {_WORD} as int))")
    now = stage(links.groupBy("a", word).agg(F.bit_or(bit).alias("bits")), "graph-sets")
    sets = [now]
    for _ in range(1, depth):
        seen = reduce(DataFrame.unionByName, sets).groupBy("a", "word").agg(F.bit_or("bits").alias("_seen"))
        handed = now.withColumnRenamed("a", "b").join(links, "b").groupBy("a", "word").agg(F.bit_or("bits").alias("bits"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long"))))
        now = stage(
            handed.join(seen, ["a", "word"], "left").select("a", "word", new.alias("bits")).where("bits <> 0"),
            "graph-sets",
        )
        if now.isEmpty():
            break
        sets.append(now)
    return sets, begin, ids


def _pairs(sets: list[DataFrame], begin: DataFrame, ids: DataFrame, itself: bool) -> DataFrame:
    """``repo, start, path, hop``: the shortest hop of each pair. Names are looked up by word, last of
    all, and before the rows of single pairs are made: a word brings 64 names."""
    if not sets:
        return ids.select("repo", F.col("node").alias("start"), F.col("node").alias("path"), F.lit(0).alias("hop")).where("false")
    hops = range(1, len(sets) + 1)
    every = reduce(DataFrame.unionByName, [x.selectExpr("a div 2 as id", "word", "bits", f"{h} as hop") for h, x in zip(hops, sets, strict=True)])
    columns = [F.coalesce(F.bit_or(F.when(F.col("hop") == h, F.col("bits"))), F.lit(0).cast("long")).alias(f"_b{h}") for h in hops]
    rows = every.groupBy("id", "word").agg(*columns).join(begin.withColumnRenamed("node", "start"), "id")
    names = ids.groupBy(F.expr(f"id div {_WORD}").alias("word")).agg(  # at most 64 names, in the order of their bits
        F.transform(F.array_sort(F.collect_list(F.struct("id", "node"))), lambda x: x["node"]).alias("_names")
    )
    met = " | ".join(f"_b{h}" for h in hops)
    flat = rows.join(names, "word").select("*", F.posexplode("_names").alias("i", "path")).where(f"shiftright({met}, i) & 1 = 1")
    if not itself:
        flat = flat.where(F.col("id") != F.col("word") * _WORD + F.col("i"))
    hop = F.coalesce(*[F.when(F.expr(f"shiftright(_b{h}, i) & 1 = 1"), h) for h in hops])
    return flat.select("repo", "start", "path", hop.alias("hop"))


def reach(edges: DataFrame, starts: DataFrame, depth: int = 2, direction: str = "in") -> DataFrame:
    """Files within ``depth`` hops: ``repo, start, path, hop``.

    ``in`` answers what a start may break, ``out`` what a start depends on.
    """
    if direction not in ("in", "out"):
        raise ValueError(f"direction must be 'in' or 'out', not {direction!r}")
    arcs = _arcs(edges, F.lit(direction == "out"), F.lit(direction == "in"))
    return _pairs(*_walk(starts, arcs, depth), itself=True)


def neighborhood(
    edges: DataFrame, starts: DataFrame, depth: int = 2, drop_external: bool = False
) -> DataFrame:
    """Shortest distance in either direction, never mixing both on one path.

    The start itself is left out. Edges to external modules are never walked
    backwards (their many importers are unrelated to each other).
    """
    out = ~F.startswith("dst", F.lit(EXTERNAL_PREFIX)) if drop_external else F.lit(True)
    arcs = _arcs(edges, out, F.col("dst_kind") == REPO_FILE)
    return _pairs(*_walk(starts, arcs, depth), itself=False)


# --- cycles -----------------------------------------------------------------------


def repo_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("dst_kind") == REPO_FILE).select("repo", "src", "dst").distinct()


def _ranked_edges(edges: DataFrame) -> DataFrame:
    """Edges with the order key (degree, name) of both ends.

    Cycles are grown from their smallest node in this order. A hub is then
    expanded only where all other nodes of the cycle are hubs too.
    """
    ends = edges.select("repo", F.col("src").alias("node")).unionByName(
        edges.select("repo", F.col("dst").alias("node"))
    )
    degree = ends.groupBy("repo", "node").agg(F.count("*").alias("degree"))
    src = degree.select("repo", F.col("node").alias("src"), F.col("degree").alias("_ds"))
    dst = degree.select("repo", F.col("node").alias("dst"), F.col("degree").alias("_dd"))
    return (
        edges.join(src, ["repo", "src"])
        .join(dst, ["repo", "dst"])
        .select("repo", F.struct(F.col("_ds").alias("d"), F.col("src").alias("n")).alias("a"),
                F.struct(F.col("_dd").alias("d"), F.col("dst").alias("n")).alias("b"))
    )


def cycles(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """Simple cycles ``repo, length, cycle``; each once, written from its smallest name.

    Without ``max_len`` every cycle is found, inside strongly connected groups only (``_all_cycles``).
    Their number can grow exponentially with a group, so tangled graphs are better served by
    ``max_len`` or by ``cyclic_groups``. With ``max_len`` paths grow hop by hop; 3 needs no path
    growth at all: pairs are formed at the node of the smallest degree.
    """
    own = repo_edges(edges)
    loops = own.where("src = dst").select("repo", F.array("src").alias("nodes"))
    found = [loops]
    if max_len is None:
        found.append(_all_cycles(own.where("src <> dst")))
    elif max_len > 1:
        ranked = stage(_ranked_edges(own.where("src <> dst")), "ranked-edges")
        up = ranked.where("a < b")
        back = ranked.where("b < a").select("repo", F.col("b").alias("start"), F.col("a").alias("y"))
        paths = up.select("repo", F.col("a").alias("start"), F.col("b").alias("x"), F.array("b").alias("path"))
        pairs = paths.join(back.withColumnRenamed("y", "x"), ["repo", "start", "x"])
        found.append(pairs.select("repo", _names("start", "path")))
        for length in range(3, max_len + 1):
            # paths hold start..x; close them over start <- y and x -> y
            closing = ranked.select("repo", F.col("a").alias("x"), F.col("b").alias("y"))
            closed = (
                paths.join(back, ["repo", "start"])
                .where(~F.array_contains("path", F.col("y")))
                .join(closing, ["repo", "x", "y"])
                .withColumn("path", F.concat("path", F.array("y")))
            )
            found.append(closed.select("repo", _names("start", "path")))
            if length == max_len:
                break
            step = ranked.select("repo", F.col("a").alias("x"), F.col("b").alias("next"))
            paths = stage(
                paths.join(step, ["repo", "x"])
                .where((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next")))
                .select("repo", "start", F.col("next").alias("x"),
                        F.concat("path", F.array("next")).alias("path")),
                "paths",
            )
            if paths.isEmpty():
                break
    every = reduce(DataFrame.unionByName, found)
    at = F.array_position("nodes", F.array_min("nodes")).cast("int")
    turned = F.concat(F.expr("slice(nodes, {0}, size(nodes))".format("_at")), F.expr("slice(nodes, 1, _at - 1)"))
    return every.withColumn("_at", at).select(
        "repo", F.size("nodes").alias("length"), turned.alias("cycle")
    )


def _all_cycles(edges: DataFrame) -> DataFrame:
    """``repo, nodes`` of every cycle of two nodes or more, from its first node in the order of degrees.

    Each node of a group is the root of the cycles in which it comes first. A root is a piece of work
    of its own: the edges of its group between later nodes, sorted into one run, from which its cycles
    are written as they are found. So a large group spreads over as many tasks as it has nodes.
    """
    groups = cyclic_groups(edges.withColumn("dst_kind", F.lit(REPO_FILE))).select("repo", "group_id", "node")
    groups = stage(groups, "cyclic-groups")
    ends = [groups.select("repo", F.col("group_id").alias(f"_g{c}"), F.col("node").alias(c)) for c in ("src", "dst")]
    inner = edges.join(ends[0], ["repo", "src"]).join(ends[1], ["repo", "dst"]).where("_gsrc = _gdst")
    ranked = _ranked_edges(inner.select("repo", "src", "dst"))
    named = groups.select("repo", "group_id", F.col("node").alias("_n"))
    ranked = stage(ranked.withColumn("_n", F.col("a.n")).join(named, ["repo", "_n"]).drop("_n"), "grouped-edges")
    roots = ranked.select("repo", "group_id", F.col("a").alias("root")).distinct()
    work = ranked.join(roots, ["repo", "group_id"]).where((F.col("root") <= F.col("a")) & (F.col("root") <= F.col("b")))
    work = work.select("repo", F.col("root.n").alias("root"), F.col("a.n").alias("src"), F.col("b.n").alias("dst"))
    sorted_ = work.repartition("repo", "root").sortWithinPartitions("repo", "root")
    return sorted_.mapInArrow(_elementary(), "repo string, nodes array<string>")


def _elementary(size: int = 4096) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cycles through the root of each run of edges. Built here so that tasks need no import of this package.

    A path grows along edges from which the root can be reached again. A node from which no way
    back was found beside the path is blocked until a node ahead of it leaves the path.
    """

    def from_root(root: str, edges: list[tuple[str, str]]) -> Iterator[list[str]]:
        into: dict[str, list[str]] = {}
        for a, b in edges:
            into.setdefault(b, []).append(a)
        back, todo = {root}, [root]
        while todo:  # what can return to the root
            for a in into.get(todo.pop(), ()):
                if a not in back:
                    back.add(a)
                    todo.append(a)
        out: dict[str, list[str]] = {}
        for a, b in sorted(edges):
            if a in back and b in back:
                out.setdefault(a, []).append(b)
        path, blocked, waiting = [root], {root}, {}
        stack, closed = [iter(out.get(root, ()))], [False]
        while stack:
            for b in stack[-1]:
                if b == root:
                    closed[-1] = True
                    yield list(path)
                elif b not in blocked:
                    path.append(b)
                    blocked.add(b)
                    stack.append(iter(out[b]))
                    closed.append(False)
                    break
            else:
                stack.pop()
                node, found = path.pop(), closed.pop()
                if found:
                    free = [node]
                    while free:
                        x = free.pop()
                        if x in blocked:
                            blocked.discard(x)
                            free += waiting.pop(x, ())
                    if closed:
                        closed[-1] = True
                else:
                    for b in out.get(node, ()):
                        waiting.setdefault(b, set()).add(node)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
        key, edges = None, []
        for batch in batches:
            for repo, root, a, b in zip(*[batch.column(c).to_pylist() for c in ("repo", "root", "src", "dst")], strict=True):
                if key != (repo, root):
                    if key:
                        yield *key, edges
                    key, edges = (repo, root), []
                edges.append((a, b))
        if key:
            yield *key, edges

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        repos, held = [], []
        for repo, root, edges in runs(batches):
            for nodes_ in from_root(root, edges):
                repos.append(repo)
                held.append(nodes_)
                if len(held) == size:
                    yield pa.RecordBatch.from_arrays([pa.array(repos), pa.array(held, kind)], names=["repo", "nodes"])
                    repos, held = [], []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(repos), pa.array(held, kind)], names=["repo", "nodes"])

    return grow


def _names(start: str, path: str) -> Column:
    return F.concat(
        F.array(F.col(f"{start}.n")), F.transform(path, lambda p: p["n"])
    ).alias("nodes")


def _sorted(df: DataFrame) -> DataFrame:
    """A side that no join broadcasts. Staged tables are small as files, and every round of a loop would
    send a few of them through the driver again."""
    return df.hint("merge")


def _trim(edges: DataFrame) -> DataFrame:
    """Edges whose source has an incoming and whose target an outgoing edge, trimmed again as long as
    that removes a tenth of them: what is labelled then is little more than the groups."""
    edges = stage(edges, "scc-edges")
    n = edges.count()
    while n:
        has_in = edges.select("repo", F.col("dst").alias("src")).distinct()
        has_out = edges.select("repo", F.col("src").alias("dst")).distinct()
        trimmed = stage(
            edges.join(_sorted(has_in), ["repo", "src"], "left_semi").join(_sorted(has_out), ["repo", "dst"], "left_semi"), "scc-edges"
        )
        unstage(edges)
        edges, before, n = trimmed, n, trimmed.count()
        if n > 0.9 * before:
            break
    return edges


def _largest_ancestor(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, node, label``: the largest node that reaches each node (or itself).

    Labels spread along edges, and every round also jumps to the label of the
    label, so long chains take few rounds. The loop ends when nothing changes.
    """
    labels = held = stage(nodes_.select("repo", "node", F.col("node").alias("label")), "labels")
    while True:
        given = edges.join(_sorted(labels.withColumnRenamed("node", "src")), ["repo", "src"]).select(
            "repo", F.col("dst").alias("node"), "label"
        )
        spread = labels.unionByName(given).groupBy("repo", "node").agg(F.max("label").alias("label"))
        jump = labels.select("repo", F.col("node").alias("label"), F.col("label").alias("_far"))
        far = F.greatest(F.col("label"), F.coalesce("_far", F.col("label")))
        new = stage(
            spread.join(_sorted(jump), ["repo", "label"], "left")
            .select("repo", "node", far.alias("label"))
            .join(_sorted(labels.withColumnRenamed("label", "_old")), ["repo", "node"])
            .withColumn("_changed", F.col("label") != F.col("_old"))
            .drop("_old"),
            "labels",
        )
        unstage(held)
        held, labels = new, new.drop("_changed")
        if new.where("_changed").isEmpty():
            return labels


def cyclic_groups(edges: DataFrame) -> DataFrame:
    """Strongly connected files ``repo, group_id, node`` (size above 1 or a self import).

    Two nodes share a group iff their largest common ancestor and descendant
    agree: label forwards, label backwards inside each colour, take the nodes
    where both labels are equal, go on with the edges inside the rest.
    """
    own = repo_edges(edges)
    loops = own.where("src = dst").select("repo", F.col("src").alias("group_id"), F.col("src").alias("node"))
    left = _trim(own.where("src <> dst"))
    done: list[DataFrame] = []
    while not left.isEmpty():
        points = left.select("repo", F.col("src").alias("node")).unionByName(
            left.select("repo", F.col("dst").alias("node"))
        ).distinct()
        down = _largest_ancestor(points, left)
        coloured = _same_label(left, down)
        turned = coloured.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
        up = _largest_ancestor(points, turned)
        both = stage(
            down.withColumnRenamed("label", "a").join(_sorted(up.withColumnRenamed("label", "b")), ["repo", "node"]),
            "colours",
        )
        done.append(both.where("a = b").select("repo", F.col("a").alias("group_id"), "node"))
        rest = both.where("a <> b").select("repo", "node", F.struct("a", "b").alias("label"))
        left = _trim(_same_label(coloured, rest))
    if done:
        groups = stage(reduce(DataFrame.unionByName, done), "groups")
        sizes = groups.groupBy("repo", "group_id").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        groups = groups.join(_sorted(sizes), ["repo", "group_id"], "left_semi")
        loops = loops.join(_sorted(groups), ["repo", "node"], "left_anti")
        loops = loops.select("repo", "group_id", "node").unionByName(groups.select("repo", "group_id", "node"))
    first = loops.groupBy("repo", "group_id").agg(F.min("node").alias("_first"))
    return loops.join(_sorted(first), ["repo", "group_id"]).select(
        "repo", F.col("_first").alias("group_id"), "node"
    )


def _same_label(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select("repo", F.col("node").alias("src"), F.col("label").alias("_a"))
    b = labels.select("repo", F.col("node").alias("dst"), F.col("label").alias("_b"))
    return edges.join(_sorted(a), ["repo", "src"]).join(_sorted(b), ["repo", "dst"]).where("_a = _b").select("repo", "src", "dst")


def stats(files: DataFrame, edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``repo, total_files, total_edges, external_dependencies`` (+ ``cyclic_groups``).

    ``groups`` is the result of ``cyclic_groups``: files that import each other, whatever the
    length of the way round.
    """
    n = nodes(files, edges).groupBy("repo").agg(
        F.count_if(F.col("kind") == REPO_FILE).alias("total_files"),
        F.count_if(F.col("kind") == EXTERNAL).alias("external_dependencies"),
    )
    e = edges.select("repo", "src", "dst").distinct().groupBy("repo").agg(F.count("*").alias("total_edges"))
    out = n.join(e, "repo", "left").select(
        "repo", "total_files", F.coalesce("total_edges", F.lit(0)).alias("total_edges"),
        "external_dependencies",
    )
    if groups is not None:
        c = groups.select("repo", "group_id").distinct().groupBy("repo").agg(F.count("*").alias("cyclic_groups"))
        out = out.join(c, "repo", "left").withColumn("cyclic_groups", F.coalesce("cyclic_groups", F.lit(0)))
    return out
