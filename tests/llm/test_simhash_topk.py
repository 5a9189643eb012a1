"""SimHash classes and exact top-k against brute force."""

import math
import random

import numpy as np
import pytest
import xxhash

from triage.llm import simhash, topk


def print_of(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, near):
    """Smallest id reachable for (id, print) rows."""
    ids = [i for i, _ in prints if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    rows = [(i, p) for i, p in prints if i is not None]
    for a, (i, p) in enumerate(rows):
        for j, q in rows[a + 1 :]:
            if near(p, q):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts():
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [None, "", "  \n", "one", "One two", "one two three", "ÄB cd ef", "äb cd ef"]
    for _ in range(25):
        base = random.choices(vocabulary, k=random.randint(40, 300))
        out.append(" ".join(base))
        for _ in range(random.randint(0, 4)):
            copy = list(base)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            out.append(("\n" if random.random() < 0.5 else " ").join(copy).upper())
    return [*out, " ".join(random.choices(vocabulary, k=30_000))]


def test_classes(spark):
    rows = [(1000 - i if i % 17 else None, t, "x", 1) for i, t in enumerate(texts())] + [(999, "one two three", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print string, component_id int").repartition(3)
    prints = simhash.fingerprints(docs)
    got = simhash.classes(prints).collect()
    want = [(i, print_of(t, 3)) for i, t, _, _ in rows]
    assert sorted((str(r.doc_id), r.print & (1 << 64) - 1) for r in got) == sorted((str(i), p) for i, p in want)
    known = [(i, p) for i, p in want if i is not None]
    group = brute_classes([(n, p) for n, (_, p) in enumerate(known)], lambda p, q: (p ^ q).bit_count() <= 3)
    smallest = {}
    for n, (i, _) in enumerate(known):  # a repeated id holds texts of their own
        smallest[group[n]] = min(i, smallest.get(group[n], i))
    expected = sorted((i, p, smallest[group[n]]) for n, (i, p) in enumerate(known))
    assert len(smallest) < len(known)
    assert sorted((r.doc_id, r.print & (1 << 64) - 1, r.component_id) for r in got if r.doc_id is not None) == expected
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert simhash.classes(prints.where("false")).count() == 0


@pytest.mark.parametrize("max_diff,group_rows", [(3, 24), (3, 10_000), (1, 40)])
def test_links_in_split_groups(spark, max_diff, group_rows):
    rng = np.random.default_rng(max_diff + group_rows)
    centres = rng.integers(0, 2**63, 6)
    prints = {int(c) for c in centres}
    for _ in range(400):
        p = int(rng.choice(centres))
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            p ^= 1 << int(b)
        prints.add(p - (1 << 64) if p >> 63 else p)
    table = spark.createDataFrame([(p,) for p in prints], "print long").repartition(4)
    edges = simhash.links(table, max_diff, group_rows)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_classes([(p, p) for p in prints], lambda p, q: ((p ^ q) & (1 << 64) - 1).bit_count() <= max_diff)
    assert {p: roots.get(p, p) for p in prints} == want


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(0, 40)] + [(500, 501 + i) for i in range(300)] + [(900, 900)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{500 + i: 500 for i in range(301)}}


def brute_top(vectors, k, scale):
    good = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(scale * x) for x in v]
            good[i] = min(good.get(i, q), q)
    out = []
    for i, q in good.items():
        if i % 20 == 0:
            found = [(-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good.items() if j != i]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_rows,scale", [(10_000, 10_000, 64), (60, 4, 64), (60, 4, 2**28)])
def test_top_k(spark, shard_rows, block_rows, scale):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).astype(float).tolist(), i) for i in range(300)]
    rows += [(i + 300, rows[i % 5][1], 0) for i in range(100)]  # ties
    rows += [(20, rows[3][1], 0), (20, rows[20][1], 0), (400, None, 0), (401, [1.0, None], 0), (402, [float("nan")] * 6, 0),
             (403, [float("inf")] + [0.0] * 5, 0), (None, [1.0] * 6, 0), (420, [], 0), (440, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(4)
    got = topk.top_k(table, topk.F.col("vec_id") % 20 == 0, 7, scale, shard_rows=shard_rows, block_rows=block_rows, leaf_rows=8)
    assert sorted(tuple(r) for r in got.collect()) == brute_top([r[:2] for r in rows], 7, scale)
    assert topk.top_k(table.where("false"), topk.F.col("vec_id") % 20 == 0).count() == 0
    few = topk.top_k(table.where("vec_id in (0, 1, 2)"), topk.F.col("vec_id") % 20 == 0)
    assert few.count() == 2


def test_search_skips_boxes():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.1, (500, 3)) for c in (-9, 0, 9)]).round(3) * 1000
    tree = topk.Tree.build(np.arange(1500), points, leaf=16)
    seen = []
    q = np.array([[1.0, 1.0, 1.0]])
    whole = tree.points

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                seen.append(key)
            return np.asarray(self)[key]

    tree.points = whole.view(Watched)
    found = tree.search_all(np.array([-1]), q, 5, np.array([-np.inf]))
    order = np.lexsort((tree.ids, -(whole @ q[0])))[:5]
    assert found.column("vec_id").to_pylist() == tree.ids[order].tolist()
    assert len(seen) < 40  # of 96 leaves


def test_queries_meet_few_shards(spark, monkeypatch):
    """Clusters apart from each other, one of them copies of one vector: sent pairs against all pairs."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(24, 8))
    centres = 8 * centres / np.linalg.norm(centres, axis=1, keepdims=True)
    own = centres[rng.integers(0, 24, 3000)] + rng.normal(size=(3000, 8)) / 20
    own[::3] = centres[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id long, embedding array<double>")
    sent, plain = [], topk.reaching

    def counted(asked, trees, *rest, **named):
        pairs = plain(asked, trees, *rest, **named, box_rows=5)
        sent.append((pairs.count(), asked.count() * (trees.count() - 1)))
        return pairs

    monkeypatch.setattr(topk, "reaching", counted)
    got = topk.top_k(table, topk.F.col("vec_id") % 20 == 0, 5, 64, shard_rows=128, block_rows=40, leaf_rows=16).collect()
    x = np.floor(64 * own).astype(np.int64)
    want = set()
    for q in range(0, 3000, 20):
        scores = x @ x[q]
        best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:5]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want
    (pairs, every), = sent
    assert every > 150 * 20 and pairs < every / 2
