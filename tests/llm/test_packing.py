import random

import numpy as np
import pytest

from stafflens.llm import packing


def test_place_takes_the_tightest_open_bin():
    rng = random.Random(1)
    for _ in range(20):
        packer = packing.Packer((16, 32, 64))
        room = {}
        for _ in range(300):
            n = rng.randint(1, 64)
            fits = sorted(r for r in room.values() if r >= n)
            b = packer.place(n)
            if fits:
                assert room[b] == fits[0]
            else:
                assert b not in room
                room[b] = min((c for c in (16, 32, 64) if c >= n), key=lambda c: (packing.cost(c) / max(n, 0.95 * c), c))
            room[b] -= n
        for used, c in zip(packer.used, packer.capacities()):
            assert used <= c and all(s < used for s in (16, 32, 64) if s < c)


def test_groups_hold_every_word_once(spark):
    rng = random.Random(2)
    texts = [" ".join(["w"] * rng.choice([0, 1, 50, 300, 900, 4096, 9000])) for _ in range(400)] + [None, "", " \n\t", "x" * 50_000]
    rows = [(None if i % 50 == 3 else i % 350, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bin_id int")
    got = packing.pack(df, group_rows=150).collect()
    want = sorted((i is None, i or 0, len((t or "").split())) for i, t, _ in rows)
    first = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got if r.piece == 0 and r.n_tokens < 4096)
    assert first == [w for w in want if w[2] < 4096]
    assert sum(r.n_tokens for r in got) == sum(w[2] for w in want)
    assert all((r.bin_id is None) == (r.n_tokens == 0) == (r.capacity is None) for r in got)
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault((r.bin_id, r.capacity), []).append(r)
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), own in bins.items():
        used = sum(r.n_tokens for r in own)
        assert used <= capacity and not any(used <= c < capacity for c in packing.CAPACITIES)
        assert sorted(r.slot for r in own) == list(range(len(own)))
    summary = {r.bin_id: (r.capacity, r.used, r.n_pieces) for r in packing.bins(packing.pack(df, group_rows=150)).collect()}
    assert sum(u for _, u, _ in summary.values()) == sum(w[2] for w in want)


def test_fill_and_length_column(spark):
    rng = np.random.default_rng(3)
    n = np.minimum(rng.lognormal(5, 1, 3000).astype(int) + 1, 4096)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)] + [(9999, None)], "doc_id long, n int")
    out = packing.pack(df, length="n", text="doc_id").where("bin_id is not null")
    used = out.agg({"n_tokens": "sum"}).first()[0]
    capacity = sum(r.capacity for r in packing.bins(out).collect())
    assert used == n.sum() and used / capacity > 0.98
    assert packing.pack(df.limit(0), length="n", text="doc_id").count() == 0


@pytest.mark.parametrize("n", [1, 512, 513, 4096])
def test_single_item_gets_the_smallest_length(n):
    out = packing.pack_lengths(np.array([1]), np.array([n]), 0)
    assert out.capacity.tolist() == [min(c for c in packing.CAPACITIES if c >= n)]


def test_any_id_comes_back(spark):
    ids = [-(1 << 62), (1 << 63) - 1, -(1 << 63), 0, None]
    df = spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in packing.pack(df).collect()) == sorted((i is None, i or 0) for i in ids)
