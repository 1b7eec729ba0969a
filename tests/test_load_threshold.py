"""The load threshold draws bins' loads where balls outnumber them: the same law, in time that doesn't grow with the balls."""

import time

import numpy as np
import pytest

from strandweave.operators import conflicts as C


@pytest.mark.parametrize("bins, balls", [(7, 60), (40, 41), (50, 30), (1, 9)])
def test_the_fullest_bin_has_the_law_of_single_balls(bins, balls):
    n, rng = 20_000, np.random.default_rng(5)
    plain = np.bincount([np.bincount(rng.integers(0, bins, balls)).max() for _ in range(n)], minlength=balls + 1)
    drawn = np.bincount([C.fullest(np.random.default_rng([1, i]), bins, balls) for i in range(n)], minlength=balls + 1)
    assert np.abs(np.cumsum(plain) - np.cumsum(drawn)).max() < 0.02 * n  # Kolmogorov: 0.02 is exceeded once in 1500 times


def test_no_ball_gives_no_load():
    assert C.fullest(np.random.default_rng(1), 5, 0) == 0


def test_time_does_not_grow_with_the_balls(spark):
    start = time.time()
    got = C.max_load_threshold(spark, 376, 54_000_000, simulations=10_000)
    mean = 54_000_000 / 376
    assert mean + 3 * mean**0.5 < got < mean + 6 * mean**0.5
    assert time.time() - start < 60
