"""Tables of narrow lengths, where the smallest length that fits is dear."""

import numpy as np
import pytest

from stafflens.llm import packing


def summary(out):
    bins = out.groupby("bin_id").agg(capacity=("capacity", "first"), used=("n_tokens", "sum"), n=("slot", "size"), last=("slot", "max"))
    assert (bins.used <= bins.capacity).all() and (bins["last"] == bins.n - 1).all()
    for c in packing.CAPACITIES:  # no bin is larger than its content asks for
        assert not ((bins.used <= c) & (bins.capacity > c)).any()
    used = bins.used.sum()
    return used / bins.capacity.sum(), sum(packing.cost(int(c)) for c in bins.capacity) / used, bins


@pytest.mark.parametrize("low,high,fill,rate", [(257, 400, 0.91, 1.21), (1100, 1400, 0.91, 1.40)])
def test_narrow_lengths_share_larger_bins(low, high, fill, rate):
    n = np.random.default_rng(4).integers(low, high + 1, 5000)
    out = packing.pack_lengths(np.arange(5000), n, 0)
    assert out.n_tokens.tolist() == n.tolist()
    got = summary(out)
    assert got[0] >= fill and got[1] <= rate, got[:2]


def test_a_bin_shrinks_and_mixed_lengths_stay_as_good():
    # 4096 takes three of 1100; opened for the last one it shrinks to 2048.
    _, _, bins = summary(packing.pack_lengths(np.arange(4), np.array([1100] * 4), 0))
    assert sorted(zip(bins.capacity, bins.n)) == [(2048, 1), (4096, 3)]
    rng = np.random.default_rng(5)
    mixed = np.minimum(rng.lognormal(5, 1, 5000).astype(int) + 1, 4096)
    assert summary(packing.pack_lengths(np.arange(5000), mixed, 0))[0] > 0.99
