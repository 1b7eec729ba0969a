"""A worker drops what an operator held in it when another operator's task comes."""

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from strandweave.llm import bpe
from strandweave.llm.common import map_rows

public_tokenizers = pytest.importorskip("public_tokenizers")


def held():
    import sys

    return lambda a: [pa.array([",".join(sorted(sys.__dict__.get("_strandweave_held", {})))] * len(a["text"]), pa.string())]


def test_tables_of_the_tokenizer_go_with_its_stage(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string").repartition(8)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.decode(bpe.encode(docs, "text", ranks, public_tokenizers.PATTERN).select("out.ids"), "ids", ranks).select("out.decoded").distinct().count() == 40
    found = {r[0] for _ in range(3) for r in map_rows(docs, {"text": "text"}, held, T.StructType([T.StructField("held", T.StringType())])).select("out.held").collect()}
    assert found == {""}
