"""Blocks and simulated reads come from every variant."""

import os

import pytest

from strandweave.plans import adapters as A
from strandweave.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["colinear_blocks", "simulated_reads"])
def test_every_variant_takes_part(spark, name):
    want = {r["cid"] for r in A.variants(spark, SF).select("cid").collect()}
    assert len(want) > 5 and {r["cid"] for r in Q.QUERIES[name](spark, SF).select("cid").distinct().collect()} == want
