"""Token ids, record files and packing against the library and plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from triage.llm import packing, records, tokens

TEXTS = [
    "One two  three.\nFour, five\n\nsix ", "", None, "naïve 日本語 ’s it's 12345", " lead", "trail\n", "\n", "a\tb \t c",
    "<|endoftext|> plain", "in<|endoftext|>side", "<|endoftext|>", "x" * 5000, "word " * 3000, " 　 \x1c᠎ end", "one two three", "one two three",
]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.vocabulary_path())


@pytest.fixture(scope="module")
def library():
    """The library as it comes, with a tokenizer of its own."""
    return Tokenizer.from_file(tokens.vocabulary_path())


def library_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 11 if i < 14 else None, t, "c", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, part int").repartition(3)


END = "<|endoftext|>"


def test_encoder_equals_library(encoder, library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 500)
    random.seed(3)
    parts = ["a", "bc", " ", " ", "\n", "\t", "é", "22", ".", ",", "'s", "　", "᠎", "\x85", "日", "\r\n", "!!", "😀"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(random.choices([*parts, END, "<|endof", "text|>"], k=random.randint(0, 9))) for _ in range(1000)]
    texts += [END, f"{END} a", f"a {END}", f"a b{END}c d", END * 3, f"\n{END}\n", END[1:], END.upper()]
    words = ["".join(random.choices("abcdeé.,\n", k=random.randint(1, 9))) for _ in range(3000)]
    texts += [" ".join(random.choices(words, k=60)) for _ in range(300)]
    for text, raw in zip(texts, encoder.encode_all(texts), strict=True):
        assert raw == np.array(library_ids(library, text)[:-1], dtype="<u4").tobytes(), repr(text)
    assert library_ids(library, END) == [50256, tokens.END_ID]


def test_store_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 100)
    encoder = tokens.Encoder(tokens.vocabulary_path())
    for n in range(50):
        encoder.encode(" ".join(f"word{n}x{i}" for i in range(60)) + " " + "y" * 1000)
        assert len(encoder.young) <= 200 and len(encoder.old) <= 200
        assert not any(len(p) > tokens.KEPT_CHARS for p in encoder.young)


def test_record_frames_find_damage():
    data = records.frame(records.pack(7, np.array([1, 70000]), 5))
    doc_id, before, ids = records.unpack(records.unframe(data))
    assert (doc_id, before, ids.tolist()) == (7, 5, [1, 70000])
    for place in (0, 9, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[place] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))


def test_records_round_trip(spark, docs, library):
    index = records.write(docs, tokens.vocabulary_path(), file_bytes=2000)
    assert index.select("file").distinct().count() > 1
    got = records.with_start(records.read(index), index).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter(
        (r.doc_id, tuple(library_ids(library, r.text))) for r in docs.collect()
    )
    start, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        key = (-1 if r.doc_id is None else r.doc_id)
        assert r.start == start and (last is None or last <= key) and r.ids_crc32 == crc(r.ids)
        start, last = start + r.n_tokens, key
    # any rows of the index can be read, in any order
    some = records.read(index.orderBy("length").limit(3)).count()
    assert some == 3
    assert records.write(docs.where("false"), tokens.vocabulary_path()).count() == 0


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing(spark, docs, library):
    got = packing.pack(packing.pieces(docs, tokens.vocabulary_path())).collect()
    bins = check_packed(got, 1024)
    want = Counter()
    for r in docs.collect():
        ids = library_ids(library, r.text)
        for n, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            want[(r.doc_id, n, start, length, crc(ids[start : start + length]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 1024) + 1
    assert packing.pack(packing.pieces(docs.where("false"), tokens.vocabulary_path())).count() == 0


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_limit(rule):
    rng = np.random.default_rng(1)
    counts = {int(k): int(v) for k, v in Counter(rng.integers(1, 101, 5000).tolist()).items()}
    limits = packing.Limits(tokens=100, documents=4, attention=6000, rule=rule, weights=(1, 1, 1))
    with pytest.raises(ValueError):
        packing.plan(counts, limits)
    counts = {k: v for k, v in counts.items() if k * k <= 6000}
    classes = packing.plan(counts, limits)
    used = Counter()
    for lengths, n in classes:
        assert sum(lengths) <= 100 and len(lengths) <= 4 and sum(x * x for x in lengths) <= 6000
        used.update({k: v * n for k, v in Counter(lengths).items()})
    assert used == counts


def test_numbers_of_a_hot_key_have_no_gaps(spark):
    rows = spark.range(3000).selectExpr("if(id % 10 < 9, 7, id) AS length", "id AS doc_id").repartition(5)
    got = packing.numbered(rows, "length", ["doc_id"]).groupBy("length").agg({"_number": "max", "doc_id": "count"}).collect()
    assert all(r["max(_number)"] == r["count(doc_id)"] - 1 for r in got)
