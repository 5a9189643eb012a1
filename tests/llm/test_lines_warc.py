"""Line dedup and web archives against plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from triage.llm import lines, warc


def key(line):
    low = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in low)


def kept(texts, min_docs, min_chars=1):
    found = Counter()
    for t in texts:
        found.update({key(x) for x in (t or "").split("\n")})
    drop = {k for k, n in found.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for t in texts:
        own = (t or "").split("\n")
        left = [x for x in own if key(x) not in drop]
        out.append(("\n".join(left), len(own), len(own) - len(left)))
    return out


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    lo, hi = rng.integers(0, 2**64, (2, 5000), dtype=np.uint64)
    made = lines.PerfectHash.build(lo, hi)
    assert sorted(made.number(lo, hi).tolist()) == list(range(5000))
    shard = lines.Shard.load(lines.Shard.build(lo, hi, np.arange(5000) + 1).dump())
    assert shard.count(lo, hi).tolist() == list(range(1, 5001))
    assert not shard.count(lo + np.uint64(1), hi ^ np.uint64(5)).any()


@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (3, 4)])
def test_lines(spark, min_docs, min_chars):
    texts = [
        "Same line\nown 1\n\tÄ b \n", " SAME LINE \nown 2\n\n", "same line", None, "", "ä b\nx\r", "\x0bX\nX\nown 3", "x",
        "a" * 100_000 + "\nx", "\n\n\n", "x\n日本語", "日本語 \nz", "日本語",
    ]
    rows = [(i if i % 5 else None, t, float(i), "lines") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n double, n_lines string").repartition(3)
    counts = lines.line_counts(docs, min_chars=min_chars).where(f"n >= {min_docs}")
    files = lines.build_index(counts, shard_keys=2)  # several shards
    assert len(files) > (min_docs == 2)
    got = lines.drop_frequent(docs, files, min_docs=min_docs, min_chars=min_chars, report="_r").collect()
    want = kept(texts, min_docs, min_chars)
    assert {(r.n, r.text, r._r.n_lines, r._r.n_dropped, r.n_lines) for r in got} == {
        (float(i), *w, "lines") for i, w in enumerate(want)
    }
    assert lines.dedup(docs.where("false")).count() == 0
    assert lines.dedup(docs, min_docs=1000).count() == len(texts)


def test_a_small_cache_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"l{i % 40}\nm{i % 7}") for i in range(200)], "doc_id long, text string")
    counts = lines.line_counts(docs)
    index = lines.Index(lines.build_index(counts, shard_keys=5), held_bytes=1)
    rows = counts.collect()
    lo, hi = (np.array([r[c] for r in rows]).astype(np.int64).view(np.uint64) for c in ("lo", "hi"))
    assert index.count(lo, hi).tolist() == [r.n for r in rows]
    assert len(index.held) == 1


def test_warc(spark):
    big, other = "é" * 600, "<p>" * 500
    rows = [
        (1, "http://a/ b\n", big), (5, "http://b", big), (3, None, big), (9, "http://c", other), (2, "u", "small"),
        (4, "u", "small"), (6, "u", None), (7, "u", ""), (5, "http://b", big), (None, "u", big), (8, "u", "x" * 300_000),
        (None, "u", "y" * 2000), (None, "v", "y" * 2000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnsRenamed({}).repartition(2)
    index = warc.write(pages, frame_bytes=3000, bundle_bytes=100)
    assert index.select("bundle").distinct().count() > 1
    got = warc.read(index).collect()
    want = Counter()
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None] if len(data) >= 1000 else []
        keeper = max(same) if same and max(same) != page_id else None
        want[(page_id, len(data), hashlib.sha1(data).hexdigest(), keeper)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == want
    for r in got:
        assert r.record_type == ("revisit" if r.refers_to is not None else "response")
        assert r.refers_to is not None or hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    assert "http://a/%20b%0A" in {r.url for r in got}
    one = index.where("page_id = 8")
    assert [r.payload_bytes for r in warc.read(one).collect()] == [300_000]
    assert warc.read(warc.write(pages.where("false"))).count() == 0


def test_bundles_are_plain_zstandard(spark):
    import io

    import zstandard

    index = warc.write(spark.createDataFrame([(i, "u", f"page {i}") for i in range(50)], "page_id long, url string, html string").coalesce(1), frame_bytes=2000)
    (name,) = {r.bundle for r in index.collect()}
    data = open(name.removeprefix("file:"), "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 50
    one = plain[: plain.index(b"WARC/1.1", 5)]
    assert warc.parse(one)[-1] == b"page 0"
    with pytest.raises(ValueError):
        warc.parse(one.replace(b"page 0", b"page x"))
