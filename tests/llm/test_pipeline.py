"""Every stage of the pipeline against a brute-force version, on its own input."""

from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline as cp
from test_lines_warc import kept
from triage.llm import common, tiling, tokens, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of each stage, written and read as the driver does."""
    docs, out = common.table(spark, SF, "documents"), []
    for name, step in cp.STAGES:
        path = str(tmp_path_factory.mktemp("steps") / name)
        step(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(steps):
    for name, (_, after) in steps.items():
        if name != "best_fit_packing":
            assert sorted(after.columns) == sorted(COLUMNS)


def test_toxicity(spark, steps):
    before, after = (rows(x) for x in steps["toxicity"])
    labels = {r.doc_id: r.toxic for r in common.table(spark, SF, "labels").collect() if common.py_fold(r.doc_id, 5)}
    hasher = toxicity.Hasher()
    sample = [(hasher(before[d].text), y) for d, y in sorted(labels.items()) if d in before]
    machine = toxicity.fit(sample)
    want = {d for d, r in before.items() if machine.score(hasher(r.text)) < 0.5}
    assert set(after) == want and 0 < len(want) < len(before)


def test_lines(steps):
    before, after = (rows(x) for x in steps["line_dedup"])
    ids = sorted(before)
    want = dict(zip(ids, [t for t, _, _ in kept([before[i].text for i in ids], 10)], strict=True))
    assert {i: r.text for i, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values())


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_copies(steps):
    before, after = (rows(x) for x in steps["simhash_near_dedup"])
    prints = {i: fingerprint(r.text) for i, r in before.items()}
    ids = sorted(before)
    pairs = [(i, j) for n, i in enumerate(ids) for j in ids[n + 1 :] if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert pairs and not any(i in after and j in after for i, j in pairs)
    group = {i: i for i in ids}
    for _ in ids:  # smallest id of each group
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    assert set(after) == set(group.values())


def test_benchmark(spark, steps):
    before, after = (rows(x) for x in steps["benchmark_decontamination"])
    items = tiling.Benchmark([(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()])
    assert set(after) == {i for i, r in before.items() if not items.hits(r.text, 0.5)}


def test_packing(steps):
    before, after = steps["best_fit_packing"]
    encoder = tokens.Encoder(tokens.vocabulary_path())
    want = {r.doc_id: len(encoder.library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}
    got, used = Counter(), Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
        used[r.sequence_id] += r.length
    assert got == want and max(used.values()) <= 1024
    assert len(used) <= 1.02 * sum(want.values()) / 1024 + 1


def test_odd_rows_pass_through(spark):
    text = " ".join(f"w{i}" for i in range(50))
    odd = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (1, "other words here", "en", "s", 1), (None, text, None, None, None),
           (2, None, "en", "s", 0), (3, "", None, "s", 0), (4, text.upper(), "en", "s", 9)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.drop_toxic(spark, docs, SF).count() == 7
    out = cp.drop_lines(spark, docs, SF)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t or "") for i, t, *_ in odd)
    left = Counter((r.doc_id, r.text) for r in cp.drop_copies(spark, docs, SF).collect())
    assert left == Counter([(1, text), (1, "other words here"), (2, None)])
    assert cp.drop_benchmark(spark, docs, SF).count() == 7
    assert cp.pack(spark, docs, SF).count() == 7
    none = docs.where("false")
    for _, step in cp.STAGES:
        assert step(spark, none, SF).count() == 0


def test_run(spark, steps):
    got = cp.run(spark, SF)
    want = steps["best_fit_packing"][1]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got.select(key).collect()) == sorted(want.select(key).collect())
    assert np.isin(["sequence_id", "offset"], got.columns).all()
