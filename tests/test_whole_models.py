"""Model selection and sampling see every candidate of ``model_cells``."""

import os

import pytest

from strandweave.operators import model as M
from strandweave.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_variant_is_sampled_and_selected_from(spark, monkeypatch):
    c = Q.model_cells(spark, SF)
    seen = []
    select = M.Cells.select
    monkeypatch.setattr(M.Cells, "select", lambda self, *a, **k: (seen.append((self.cids, len(self.x))), select(self, *a, **k))[1])
    Q.QUERIES["selected_model"](spark, SF).collect()
    assert seen == [(c.cids, len(c.x))]
    assert sorted(r["cid"] for r in Q.QUERIES["mcmc_means"](spark, SF).collect()) == c.cids and len(c.cids) > 4
