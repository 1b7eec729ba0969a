"""The walks query runs by the search's stop rule, the load threshold by the data's conflicts."""

import os

import pytest

from strandweave.operators import conflicts as C
from strandweave.plans import adapters as A
from strandweave.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_walks_start_at_the_searchs_own_number(spark):
    assert sum(r["n"] for r in Q.QUERIES["walks"](spark, SF).collect()) >= 500


def test_threshold_takes_the_conflicts_from_the_sites(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(C, "max_load_threshold", lambda spark, bins, balls, simulations=100_000, **k: asked.append((balls, simulations)) or 1)
    Q.QUERIES["max_load_threshold"](spark, SF)
    assert asked == [(C.sites(Q.conflict_records(spark, SF), A.contigs(spark, SF)).count(), 100_000)]
