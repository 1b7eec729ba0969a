"""Encoding and decoding share one worker a task, so an executor holds the tokenizer's tables once a task."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandweave.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_tokens_and_their_decoding_come_from_one_worker(spark):
    texts = ["some words", None, "", "naïve café \U0001f600", "x" * 3000, "tab\tand\nline  ", "some words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode_and_decode(docs, "text", ranks, public_tokenizers.PATTERN).select("row.doc_id", "out.ids", "out.decoded")
    encoded = bpe.encode(docs, "text", ranks, public_tokenizers.PATTERN).select("row.doc_id", "out.ids")
    apart = bpe.decode(encoded, "ids", ranks).select("row.doc_id", "row.ids", "out.decoded")
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, apart.collect()))
    stage = corpus_pipeline.byte_bpe(spark, docs, "")
    assert stage._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert stage.filter(F.col("round_trip")).count() == len(texts)
