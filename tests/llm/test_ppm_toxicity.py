"""Language-model scores and toxicity against plain Python and held-out rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from triage.llm import common, ppm, toxicity
from triage.llm import queries as q

# The added-one word model gives every unseen word the same share, which only costs it in a large corpus.
SF = "/root/testdata/sf0.1"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]


def coded(text):
    return " ".join(words(text)).encode() + b"\n"


class Plain:
    """The same model, one byte at a time over dictionaries."""

    def __init__(self, texts, order, depth):
        self.order = order
        counts = [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            data = b"\n" * order + coded(t)
            for i in range(order, len(data)):
                for k in range(order + 1):
                    counts[k][data[i - k : i]][data[i]] += 1
        least = max(1.0, sum(counts[0][b""].values()) / 2**depth)
        self.total = [{c: sum(n.values()) for c, n in own.items()} for own in counts]
        self.kept = [
            {c: k for c, n in own.items() if (k := {s: m for s, m in n.items() if m >= least})} for own in counts
        ]

    def score(self, text):
        data, out = b"\n" * self.order + coded(text), 0.0
        for i in range(self.order, len(data)):
            gone = set()
            for k in range(self.order, -1, -1):
                c, s = data[i - k : i], data[i]
                if c not in self.kept[k]:
                    continue
                own = self.kept[k][c]
                total = self.total[k][c] - sum(own[x] for x in gone)
                if s in own:
                    out += math.log10((own[s] - 0.5) / total)
                    break
                if total > 0:
                    escape = self.total[k][c] - sum(own.values()) + 0.5 * (len(own) - len(gone))
                    out += math.log10(max(escape, 1e-12) / total)
                gone = set(own)
            else:
                out += math.log10(1 / (252 - len(gone)))
        return out


@pytest.mark.parametrize("order,depth", [(5, 22), (2, 22), (3, 6)])
def test_scores(spark, order, depth):
    random.seed(order)
    texts = [" ".join(random.choices(["the", "cat", "sat", "Mat", "é", "日本"], k=random.randint(0, 40))) for _ in range(60)]
    texts += [None, "", " \n\t ", "the cat", "the cat", "zebra " * 400, "the\x0bcat\rsat", "\x00\x7f q"]
    rows = [(i if i % 13 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string").repartition(4)
    got = ppm.score(docs, common.fold(F.col("doc_id"), 7) == 2, order, depth).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t, _ in rows if not out(i)]
    model = Plain(train, order, depth)
    counts = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), out(i), len(words(t)) + 1, sum(w in counts for w in [*words(t), None]), n,
         round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6), round(model.score(t), 6))
        for i, t, _ in rows
    )
    assert any(w[1] for w in want)
    assert sorted((str(r[0]), *r[1:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    none = ppm.score(docs, F.lit(True), order, depth).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in none)
    assert math.isclose(min(r.score for r in none), -math.log10(252) * max(len(coded(t)) for t in texts))
    assert ppm.score(docs.where("false"), F.lit(False)).count() == 0


def test_probabilities_add_up():
    texts = [coded("abracadabra abra cad"), coded("abab cab")]
    keys, _ = ppm.contexts(texts, 3)
    levels = []
    held = np.unique(keys, return_counts=True)
    for order in (3, 2, 1, 0):
        if order < 3:
            held = ppm.shorter(*held, order)
        keep = held[1] >= 2
        ctx, at = np.unique(held[0] >> np.uint64(8), return_inverse=True)
        levels.append(ppm.Level(held[0][keep], held[1][keep], ctx, np.bincount(at, held[1])))
    trie = ppm.Trie(levels[::-1])
    alphabet = np.array([b for b in range(256) if b not in (9, 11, 12, 13)], dtype=np.uint64)
    for context in (b"abr", b"\n\n\n", b"zzz", b"ra ", b"xab"):
        keys = np.uint64(int.from_bytes(context, "big") << 8) | alphabet
        assert math.isclose((10 ** trie.log10(keys)).sum(), 1, rel_tol=1e-9)


def test_model_beats_words_on_held_out_documents(spark):
    got = ppm.score(common.table(spark, SF, "documents"), common.fold(F.col("doc_id"), 7) == 2)
    r = got.where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert r.score > r.base


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    y = np.array(labels)
    return (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_pairs_are_learned():
    """Toxic only if two terms meet: no sum of weights can tell, the machine can."""
    rng = np.random.default_rng(0)
    samples = []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        terms = {10 + int(a), 20 + int(b), *rng.integers(100, 130, 3).tolist()}
        samples.append((np.array(sorted(terms), dtype=np.int32), int(a == b)))
    machine = toxicity.fit(samples[:2000], toxicity.Settings(bits=8, epochs=30))
    right = [(machine.score(t) >= 0.5) == (y == 1) for t, y in samples[2000:]]
    assert np.mean(right) > 0.95


def test_toxicity_on_held_out_rows(spark):
    docs = common.texts(common.table(spark, SF, "documents"))
    labels = common.table(spark, SF, "labels")
    out = common.fold(F.col("doc_id"), 5) == 0
    got = toxicity.fit_and_score(docs, docs, labels, ~out).join(labels, "doc_id").where(out).collect()
    scores, truth = [r.score for r in got], [r.toxic for r in got]
    assert auc(np.array(scores), truth) > 0.9
    assert np.mean(np.array(scores)[np.array(truth) == 1] >= 0.5) > 0.75
    clean = [r.score for r in got if not r.toxic]
    assert np.mean(np.array(clean) >= 0.5) < 0.01


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(
        [(1, "you idiot"), (2, "fine day"), (2, "fine day"), (3, None), (None, ""), (4, "a" * 200_000)], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (2, 0), (None, 1), (77, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.fit_and_score(docs, docs, labels, F.lit(True), name="s").collect()
    assert len(got) == 6 and all(0 <= r.s <= 1 for r in got)
    assert len({r.s for r in got if not r.text}) == 1
    rows = toxicity.training_rows(docs, labels, F.lit(True))
    assert sorted((r.doc_id, r.toxic) for r in rows.collect()) == [(1, 1), (2, 0)]
    assert toxicity.training_rows(docs, labels, F.lit(True), max_train=1).count() <= 1
    none = toxicity.fit_and_score(docs, docs, labels.where("false"), F.lit(True)).collect()
    assert all(r.score == pytest.approx(0.25) for r in none)
    assert toxicity.fit_and_score(docs.where("false"), docs, labels, F.lit(True)).count() == 0


def plain_fit(samples, s):
    """The machine's training with every sum written out: pairs, gradients, AdaGrad, soft threshold."""
    n, rng = len(samples), np.random.default_rng(s.seed)
    share = (sum(y for _, y in samples) + 0.5) / (n + 2)
    bias = math.log(share / (1 - share))
    often = sorted(t for t, k in Counter(t for x, _ in samples for t in x.tolist()).items() if k >= s.min_docs)
    w = {t: 0.0 for t in often}
    first = rng.normal(0, 0.05, (s.factors, len(often)))
    v = {t: [float(first[f][i]) for f in range(s.factors)] for i, t in enumerate(often)}
    seen_w, seen_v, seen_0 = {t: 1e-3 for t in often}, {t: [1e-3] * s.factors for t in often}, 1e-3
    for _ in range(s.epochs):
        order = rng.permutation(n)
        for at in range(0, n, s.batch):
            rows = [([t for t in samples[i][0].tolist() if t in w], samples[i][1]) for i in order[at : at + s.batch]]
            rows = [(x, y) for x, y in rows if x]
            gs = []
            for x, y in rows:
                pairs = sum(sum(v[a][f] * v[b][f] for f in range(s.factors)) for k, a in enumerate(x) for b in x[k + 1 :])
                z = bias + sum(w[t] for t in x) + pairs / len(x)
                gs.append((1 / (1 + math.exp(-z)) - y) / len(rows))
            seen_0 += sum(gs) ** 2
            bias -= s.rate * sum(gs) / math.sqrt(seen_0)
            met = sorted({t for x, _ in rows for t in x})
            new_w, new_v = {}, {}
            for t in met:
                g = sum(g_ for g_, (x, _) in zip(gs, rows) if t in x)
                seen_w[t] += g * g
                step = s.rate / math.sqrt(seen_w[t])
                moved = w[t] - step * g
                new_w[t] = math.copysign(max(0.0, abs(moved) - step * s.sparsity), moved)
                new_v[t] = []
                for f in range(s.factors):
                    # d/dv of the pair sum: the factors of all other terms
                    g = sum(g_ / len(x) * sum(v[o][f] for o in x if o != t) for g_, (x, _) in zip(gs, rows) if t in x) + s.decay * v[t][f]
                    seen_v[t][f] += g * g
                    new_v[t].append(v[t][f] - s.rate * g / math.sqrt(seen_v[t][f]))
            w.update(new_w)
            v.update(new_v)
    return bias, w, v


def test_factorization_machine_equals_its_sums():
    rng = np.random.default_rng(11)
    s = toxicity.Settings(bits=6, min_docs=3, factors=2, epochs=3, batch=16)
    samples = []
    for _ in range(60):
        terms = np.unique(rng.integers(0, 40, rng.integers(0, 9))).astype(np.int32)
        samples.append((terms, int(3 in terms and 7 in terms or rng.random() < 0.2)))
    machine = toxicity.fit(samples, s)
    bias, w, v = plain_fit(samples, s)
    assert machine.bias == pytest.approx(bias, rel=1e-6)
    for t in range(64):
        assert machine.weights[t] == pytest.approx(w.get(t, 0.0), abs=1e-5)
        assert machine.factors[t].tolist() == pytest.approx(v.get(t, [0.0, 0.0]), abs=1e-5)
    for x, _ in samples:
        x = [t for t in x.tolist() if t in v]
        pairs = sum(a * b for k, i in enumerate(x) for j in x[k + 1 :] for a, b in zip(v[i], v[j]))
        z = bias + sum(w[t] for t in x) + (pairs / len(x) if x else 0)
        assert machine.score(np.array(x, dtype=np.int32)) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_toxicity_query_equals_its_parts(spark, tmp_path):
    """op10 over whole tables: the plain version learns from the same folds and scores every row."""
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words, 12)) + (" idiot group" if i % 4 == 0 else ""), "x") for i in range(120)]
    rows += [(500, None, "x"), (501, "", "x"), (None, "idiot group", "x"), (7, rows[8][1], "x")]
    labels = [(i, 0, int(i % 4 == 0)) for i in range(100)] + [(900, 0, 1), (3, 0, None)]
    spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.doc_id, round(r.score, 5), r.predicted, r.held_out) for r in q.QUERIES["op10_toxicity"](spark, str(tmp_path)).collect()}
    hasher = toxicity.Hasher()
    known = {i: y for i, _, y in labels if y is not None and i != 900 and common.py_fold(i, 5)}
    chosen = {i: min((t or "" for j, t, _ in rows if j == i), key=lambda t: hasher(t).tobytes()) for i in known}
    bias, w, v = plain_fit([(hasher(chosen[i]), known[i]) for i in sorted(known)], toxicity.Settings(epochs=10))
    want = set()
    for i, t, _ in rows:
        x = [k for k in hasher(t).tolist() if k in v]
        pairs = sum(a * b for n, p in enumerate(x) for o in x[n + 1 :] for a, b in zip(v[p], v[o]))
        score = 1 / (1 + math.exp(-(bias + sum(w[k] for k in x) + (pairs / len(x) if x else 0))))
        want.add((i, round(score, 5), int(score >= 0.5), common.py_fold(i, 5) == 0))
    assert {r[0::2] for r in got} == {r[0::2] for r in want}
    assert {(r[0], r[3]) for r in got} == {(r[0], r[3]) for r in want}
    assert all(any(a[0] == b[0] and abs(a[1] - b[1]) < 1e-3 for b in want) for a in got)
