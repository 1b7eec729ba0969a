"""The pipeline against a brute-force version of each stage, and the contract queries on the smallest tables."""

import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from strandweave.llm import quality
from strandweave.llm.queries import QUERIES
from tests.llm.test_llm import brute_components, brute_contamination, brute_repeats
from tests.llm.test_near_copies import brute_set

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, each written and read again."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_brute_force(spark, stages):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in stages]
    assert names == ["quality_classifier", "near_dedup", "substring_dedup", "benchmark_decontamination", "byte_bpe"]
    assert all(df.columns == documents.columns for _, df in stages[:-1])
    before = rows_of(documents)
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    learn = sorted((i, y, before[i]["text"]) for i, y in labels if len(before[i]["text"].encode()) <= quality.TRAIN_BYTES)
    w = quality.train([t for _, _, t in learn], [y for _, y, _ in learn])
    good = rows_of(stages[0][1])
    assert set(good) == {i for i, r in before.items() if quality.score(w, r["text"]) >= 0.3}

    ids = sorted(good)
    root = brute_components([brute_set(good[i]["text"]) for i in ids], lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    single = rows_of(stages[1][1])
    assert set(single) == {i for k, i in enumerate(ids) if root[k] == k} and all(single[i] == good[i] for i in single)

    ids = sorted(single)
    want = {}
    for i, (n, gone, kept) in zip(ids, brute_repeats([single[i]["text"] for i in ids], ids), strict=True):
        if gone < n or not n:
            want[i] = kept if gone else single[i]["text"]
    cut = rows_of(stages[2][1])
    assert {i: r["text"] for i, r in cut.items()} == want and all(r["n_chars"] == len(r["text"]) for r in cut.values())

    ids = sorted(cut)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_contamination([cut[i]["text"] for i in ids], items)
    clean = rows_of(stages[3][1])
    assert set(clean) == {i for i, h in zip(ids, hits, strict=True) if not h[1]}

    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    from strandweave.llm import bpe

    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    done = rows_of(stages[4][1])
    assert set(done) == set(clean) and all(r["round_trip"] and np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(clean[i]["text"]) for i, r in done.items())


def test_run_is_the_last_stage(spark, stages):
    got = rows_of(corpus_pipeline.run(spark, SF))
    assert {i: bytes(r["ids"]) for i, r in got.items()} == {i: bytes(r["ids"]) for i, r in rows_of(stages[-1][1]).items()}


COLUMNS = {
    "op1": ["page_id", "host", "path", "rule", "verdict"], "op2": ["doc_id", "fingerprint", "component_id"], "op4": ["doc_id", "held_out", "score", "predicted"],
    "op5": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op6": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op7": ["doc_id", "held_out", "score", "predicted"],
    "op8": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op9": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op10": ["query_id", "rank", "vec_id", "score"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract_columns(spark, name):
    df = QUERIES[name](spark, SF)
    n, want = df.count(), COLUMNS.get(name.split("_")[0], [])
    assert df.columns[: len(want)] == want and n > 0
    if name.split("_")[0] in ("op2", "op4", "op5", "op6", "op7", "op8", "op9"):
        assert n == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name, label, out", [("op4_byte_cnn_quality", "quality", 0.9), ("op7_string_kernel_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, out):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["predicted"], labels[r["doc_id"]]) for r in QUERIES[name](spark, sf).filter("held_out").collect() if r["doc_id"] in labels]
    assert len(got) > 30 and np.mean([a == b for a, b in got]) >= out
