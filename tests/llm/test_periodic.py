"""Periodic runs against a plain diagonal programme, word by word."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from triage.llm import periodic
from triage.llm import queries as q


def plain_runs(words, times=4, least=6):
    """Every lag's match lengths, one word at a time, all pairs of equal words."""
    found, active = {}, {}
    for i in range(len(words) + 1):
        now = {i - j: active.get(i - j, 0) + 1 for j in range(i) if i < len(words) and words[j] == words[i]}
        for lag, matched in active.items():
            if lag not in now:
                start, length = i - matched - lag, matched + lag
                if length >= max(least, times * lag):
                    found[start, length] = min(lag, found.get((start, length), lag))
        active = now
    return sorted((s, n, p) for (s, n), p in found.items())


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[p:], strict=False)))


def found_runs(texts):
    return [[tuple(r) for r in rows.tolist()] for rows, _ in periodic.collapse_all([" ".join(t) for t in texts])]


def test_runs_equal_the_plain_programme():
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        out = []
        while len(out) < rng.randint(0, 90):
            passage = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            out += passage * rng.choice([1, 1, 2, 4, 5, 9]) + passage[: rng.randint(0, 3)]
        texts.append(out)
    texts += [["a"] * n for n in range(12)] + [["a", "b"] * 40, ["a"] * 70 + ["b"] + ["a"] * 70]
    assert found_runs(texts) == [plain_runs(t) for t in texts]
    for text, rows in zip(texts, found_runs(texts), strict=True):
        for start, length, period in rows:
            assert smallest_period(text[start : start + length]) == period


def test_long_periods_and_neighbours():
    passage = [f"w{i}" for i in range(1000)]
    once = ["x", "y"] + passage * 4 + passage[:17] + ["z"]
    # equal documents side by side: nothing matches across them
    assert found_runs([once, once, passage, passage, passage, passage]) == [[(2, 4017, 1000)]] * 2 + [[]] * 4


def test_one_word_over_and_over_is_not_quadratic():
    [(rows, text)] = periodic.collapse_all(["spam " * 300_000])
    assert rows.tolist() == [[0, 300_000, 1]] and text == "spam"
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(3, int), np.zeros(3, int), times=2)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    rows = plain_runs(words)
    dropped = {i for s, n_, p in rows for i in range(s + p, s + n_)}
    best = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(rows), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n_},{p}\n" for s, n_, p in rows).encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_the_plain_version(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " \n".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(0, 150))), "s") for i in range(150)]
    rows += [
        (None, "a " * 30, "s"), (5000, None, "s"), (5001, "", "s"), (5002, " \t\x0b ", "s"), (5003, "la  \u0085 la", "s"),
        (7, "b c " * 9, None), (7, "b c " * 9, None), (5004, "the cat " * 4 + "x" + " y z z" * 6 + " é é é é é é", "s"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = q.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected(i, t)) for i, t, _ in rows)
    assert sum(r.n_runs for r in got) > 10


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([("k", "a a a a a a", 1)], "key string, body string, start int")
    [row] = periodic.collapse(docs, text_col="body", name="length").collect()
    assert (row.key, row.body, row.start, [tuple(r) for r in row.length]) == ("k", "a", 1, [(0, 6, 1)])
    assert periodic.collapse(docs.where("false"), text_col="body").count() == 0
