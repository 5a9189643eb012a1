"""The benchmark reaches its block files by tasks, not by the driver."""

from triage.llm import tiling


def test_driver_writes_no_block(spark, monkeypatch):
    def refuse(name):
        raise AssertionError(f"the driver wrote {name}")

    items = [(i, " ".join(f"i{i}w{k}" for k in range(8))) for i in range(40)]
    docs = spark.createDataFrame([(i, f"before {t} behind") for i, t in items], "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(7)
    monkeypatch.setattr(tiling.common, "open_out", refuse)
    files = tiling.write_blocks(benchmark, "item_id", "text", chars=300)
    assert len(files) > 4
    got = tiling.contamination(docs, benchmark, name="found", block_chars=300).collect()
    assert sorted((r.doc_id, [h.item_id for h in r.found]) for r in got) == [(i, [i]) for i, _ in items]
