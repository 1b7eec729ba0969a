"""The near-copy search deals fingerprints by vantage points: the same groups as from all pairs, with fewer comparisons."""

import numpy as np
import pytest

from strandweave.llm import similar as S


def drawn(rng, centres, each, flips):
    """Fingerprints around some centres, and the sizes of their sets, sorted."""
    n = centres * each
    f, g = (np.repeat(rng.integers(0, 1 << 63, centres, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, centres).astype(np.uint64), each) for _ in range(2))
    for x in (f, g):
        for _ in range(flips):
            x ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.sort(rng.integers(80, 110, n)), f, g


def plain(size, f, g, split):
    label = np.arange(len(size))
    last = len(size) if split is None else split
    for i in range(last):
        for j in range(i + 1 if split is None else split, len(size)):
            low, high = (int(x[i] ^ x[j]).bit_count() for x in (f, g))
            if low <= S.HALF and low + high <= S.WHOLE and S.NUM * max(size[i], size[j]) <= S.DEN * min(size[i], size[j]):
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("split", [None, 150, 0, 400])
def test_groups_are_those_of_all_pairs(monkeypatch, split):
    monkeypatch.setattr(S, "LEAF", 50)
    for seed, (centres, each, flips) in enumerate([(400, 1, 0), (40, 10, 8), (8, 50, 12)]):
        size, f, g = drawn(np.random.default_rng(seed), centres, each, flips)
        assert S.groups_of(size, f, g, split).tolist() == plain(size, f, g, split).tolist()


def test_clusters_far_apart_are_not_compared(monkeypatch):
    rng = np.random.default_rng(9)
    size, f, g = drawn(rng, 1, 6000, 2)
    turn = rng.integers(0, 2, len(f)).astype(bool)
    f[turn], g[turn] = ~f[turn], ~g[turn]
    pairs, real = [0], S.candidates

    def counted(f, g, rows, cols):
        pairs[0] += (rows.stop - rows.start) * (cols.stop - cols.start)
        return real(f, g, rows, cols)

    monkeypatch.setattr(S, "candidates", counted)
    assert len(np.unique(S.groups_of(size, f, g))) == 2
    assert pairs[0] < 0.6 * len(f) ** 2 / 2
