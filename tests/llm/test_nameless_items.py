"""Benchmark items without an id in the pipeline."""

import corpus_pipeline
from strandweave.llm import decontaminate
from tests.llm.test_llm import docs


def test_nameless_items_are_searched(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta"), (None, "ghost words"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs(spark, ["x ghost words y", "alpha beta", "clean", None])
    got = corpus_pipeline.benchmark_decontamination(spark, rows, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == [2, 3]
    found = decontaminate.find_contamination(rows, "text", spark.read.parquet(str(tmp_path / "benchmark.parquet")), nameless=True, block_bytes=4)
    assert {r["doc_id"]: (r["h"], r["items"]) for r in found.select("row.doc_id", decontaminate.hit_words("out.spans").alias("h"), "out.items").collect()} == {0: (2, []), 1: (2, ["1"]), 2: (0, []), 3: (0, [])}
