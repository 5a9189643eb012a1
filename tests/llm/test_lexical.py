"""Ranked search against scores of all documents in plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from triage.llm import lexical
from triage.llm import queries as q

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    split = [(i, Counter(plain_terms(t))) for i, t in docs]
    split = [(i, c) for i, c in split if c]
    n_docs, length = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in split:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in plain_terms(text) if t in c
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def made(rng, n, words):
    weights = [1 / (i + 1) for i in range(words)]
    return [" ".join(f"w{x}" for x in rng.choices(range(words), weights, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    texts = made(rng, 1500, 400)
    docs = list(enumerate(texts))
    items = [(i, t) for i, t in enumerate(made(rng, 40, 400))]
    # a third of all rows are one text; a text of few words; odd characters; nulls; repeats; long ones
    docs += [(i, items[3][1]) for i in range(2000, 2800)] + [(3000, None), (None, texts[5]), (None, items[4][1]), (7, texts[7])]
    docs += [(3001, "É é naïve_naïve\x00naïve WORD-word ½ 日本"), (3002, "w1 " * 30_000), (3003, " \n\t")]
    items += [(100, None), (None, "w1 w2 w399"), (101, ""), (3, items[3][1]), (102, "naïve word é 日本"), (103, "nowhere"), (104, "w0")]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, item int, score double").repartition(6),
        spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int").repartition(3),
    )


def found(df):
    return sorted(map(repr, ((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())))


@pytest.mark.parametrize("sizes", [{}, {"first": 50, "block_terms": 60}])
def test_equals_all_scores(spark, tables, sizes, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(lexical, "BUCKET", 64)
    got = lexical.top_documents(*frames(spark, docs, items), k=10, **sizes)
    assert found(got) == sorted(map(repr, plain(docs, items, 10)))


def test_small_and_empty_tables(spark, tables):
    docs, items = tables
    d, i = frames(spark, docs[:3], items)
    assert found(lexical.top_documents(d, i)) == sorted(map(repr, plain(docs[:3], items, 10)))
    assert lexical.top_documents(d.where("false"), i).count() == 0
    assert lexical.top_documents(d, i.where("false")).count() == 0


def test_bounds_let_most_documents_out():
    rng = random.Random(9)
    texts = made(rng, 4000, 3000)
    held = {"items": [(0, dict(Counter(plain_terms(texts[11]))))]}
    items = lexical.Items(held)
    df = Counter(t for x in texts for t in set(plain_terms(x)))
    weights = lexical.np.array([int(1000 * math.log(8002 / (2 * df[t.decode()] + 1))) for t in items.vocabulary])
    touched = []

    class Counting(lexical.Search):
        def _keep(self, i, alive, *rest):
            touched.append(len(alive))
            super()._keep(i, alive, *rest)

    search = Counting(items, weights, 10, [1])
    vectors = []
    for row, text in enumerate(texts):
        c = Counter(map(items.vocabulary.get, lexical.terms(text)))
        c.pop(None, None)
        value = {t: lexical.impact(n, sum(c.values()), 4000, 80_000) for t, n in c.items()}
        vectors.append((math.sqrt(sum(weights[t] * v * v for t, v in value.items())), row, value))
    vectors.sort(key=lambda v: -v[0])
    for at in range(0, len(vectors), 200):
        part = vectors[at : at + 200]
        place = [p for p, (_, _, v) in enumerate(part) for _ in v]
        search.bucket(
            lexical.np.array([r for _, r, _ in part]), [r for _, r, _ in part], lexical.np.array([n for n, _, _ in part]),
            lexical.np.array(place), lexical.np.array([t for *_, v in part for t in v]), lexical.np.array([x for *_, v in part for x in v.values()]),
        )
    best = sorted((-sum(n * weights[t] * v.get(t, 0) for t, n in zip(items.terms[0], items.counts[0], strict=True)), row) for _, row, v in vectors)
    assert [(s, row) for s, _, row, _ in search.best[0]] == best[:10]
    # of 4,000 documents only those that may be among the ten are followed to the end, and short vectors not at all
    assert sum(touched) < 600 and search.done == [True], (sum(touched), search.done)


def test_query_equals_all_scores(spark, tables, tmp_path):
    docs, items = tables
    d, i = frames(spark, docs, items)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    i.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert found(q.QUERIES["op11_ranked_search"](spark, str(tmp_path))) == sorted(map(repr, plain(docs, items, 10)))
