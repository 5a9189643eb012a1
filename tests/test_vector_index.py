"""The vector index in place: which buckets an update writes, tombstones, updates that die."""

import pytest
from pyspark.sql import functions as F

from triage.functions.vectors import hashed_terms
from triage.operators import files as fo
from triage.operators import symbols as sy
from triage.sources import vector_index as vi

BODY = "def {}(a):\n    return {}\n\n"


@pytest.fixture
def snapshot(make_files):
    def make(contents, repo="r"):
        return fo.with_hash(make_files(contents, repo=repo))

    return make


def live(spark, root, **more):
    return {(r.repo, r.chunk_id): r.written for r in vi.read(spark, root, **more).collect()}


def test_updates_write_only_buckets_of_changed_chunks(spark, snapshot, tmp_path):
    root = str(tmp_path / "index")
    contents = {f"m{i}.py": BODY.format(f"f{i}", i) for i in range(12)} | {"o.py": BODY.format("o", 1) + BODY.format("o", 2), "e.py": "", "x.py": "x = 1\n"}
    both = snapshot(contents).unionByName(snapshot({"m0.py": BODY.format("f0", 99)}, repo="s"))
    assert vi.update(spark, root, both, sy.extract, buckets=8) == 1
    first = live(spark, root)
    assert len(first) == 15 and set(first.values()) == {1} and ("r", "o.py::o@1") in first and ("r", "o.py::o@4") in first
    # one file edited, one gone, one overload gone; the other repository is not part of this update
    contents["m3.py"] = BODY.format("f3", "a + 1")
    contents["o.py"] = BODY.format("o", 2)
    del contents["m5.py"]
    scanned = []

    def scan(files):
        scanned.extend(r.path for r in files.select("path").collect())
        return sy.extract(files)

    assert vi.update(spark, root, snapshot(contents), scan) == 2
    assert sorted(scanned) == ["m3.py", "o.py"]
    now = live(spark, root)
    want = {k: 1 for k in first} | {("r", "m3.py::f3@1"): 2, ("r", "o.py::o@1"): 2}
    del want["r", "m5.py::f5@1"], want["r", "o.py::o@4"]
    assert now == want
    everything = vi.read(spark, root, removed=True)
    gone = {(r.chunk_id, r.written, r.embedding) for r in everything.where("removed").collect()}
    assert gone == {("m5.py::f5@1", 2, None), ("o.py::o@4", 2, None)}
    # rows of untouched buckets stand in the folders of the first version
    places = {r.b for r in everything.where("written = 2").select(F.pmod(F.xxhash64("repo", "chunk_id"), F.lit(8)).alias("b")).distinct().collect()}
    manifest = vi._manifest(spark, root, 2)
    assert {b for b, v in manifest.items() if v == 2} == places and len(places) < 8
    # vectors equal those of a new index; the old version stays readable
    fresh = str(tmp_path / "fresh")
    vi.update(spark, fresh, snapshot(contents).unionByName(snapshot({"m0.py": BODY.format("f0", 99)}, repo="s")), sy.extract)
    vectors = lambda where: sorted((r.repo, r.chunk_id, tuple(r.embedding)) for r in vi.read(spark, where).collect())
    assert vectors(root) == vectors(fresh)
    assert live(spark, root, version=1) == first
    # a chunk that comes back replaces its tombstone; then the rest of the tombstones go
    contents["m5.py"] = BODY.format("f5", 5)
    assert vi.update(spark, root, snapshot(contents), sy.extract) == 3
    assert live(spark, root)["r", "m5.py::f5@1"] == 3
    assert vi.drop_tombstones(spark, root) == 4 and vi.drop_tombstones(spark, root) == 4
    assert vi.read(spark, root, removed=True).where("removed").isEmpty() and len(live(spark, root)) == 14


def test_an_update_that_dies_is_not_seen(spark, snapshot, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        vi.read(spark, root)
    vi.update(spark, root, snapshot({"a.py": BODY.format("a", 1)}), sy.extract, buckets=4)
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            vi.update(spark, root, snapshot({"a.py": BODY.format("b", 1)}), sy.extract)
    assert list(live(spark, root)) == [("r", "a.py::a@1")]
    vi.update(spark, root, snapshot({"a.py": BODY.format("c", 1)}), sy.extract)
    assert list(live(spark, root)) == [("r", "a.py::c@1")]
    assert vi.update(spark, root, snapshot({"a.py": BODY.format("c", 1)}), sy.extract) == 3
    assert live(spark, root) == {("r", "a.py::c@1"): 2}


def test_names_with_marks_are_whole(spark, make_files):
    text = "def नमस्ते(x):\n    pass\n\nclass Zażółć:\n    def é́(self): pass\n"
    assert [r.qualified_name for r in sy.extract(make_files({"a.py": text})).orderBy("pos").collect()] == ["नमस्ते", "Zażółć", "Zażółć.é́"]


def test_vector_provider_is_the_callers(spark, snapshot, tmp_path):
    root = str(tmp_path / "index")
    vi.update(spark, root, snapshot({"a.py": BODY.format("a", 1)}), sy.extract, provider=lambda t: hashed_terms(t, 8), buckets=2)
    [row] = vi.read(spark, root).collect()
    assert len(row.embedding) == 8 and sum(row.embedding) == 10
