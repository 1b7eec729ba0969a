"""The number of mixture components is the best of all, not of the first few."""

import pytest

from strandweave.operators import conflicts as C


@pytest.mark.parametrize("many, gap", [(20, 60), (30, 100)])
def test_many_clusters_are_all_found(many, gap):
    x = [1000 + i * gap + d for i in range(many) for d in (-1, 0, 1)]
    m = C.Mixture().fit(x, [10] * len(x))
    assert m.means.tolist() == [1000 + i * gap for i in range(many)]
