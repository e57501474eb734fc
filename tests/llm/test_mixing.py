import random
from collections import Counter

import plain
import pytest

from stafflens.llm import mixing


def _rows(seed, n=600):
    rng = random.Random(seed)
    sources = ["src0"] * 6 + ["src10", "src2", "é", "Z", None]
    return [(i, " ".join(["w"] * min(3000, int(rng.lognormvariate(3, 1)))), rng.choice(sources)) for i in range(n)] + [(9000, None, "src2"), (9001, "", "only empty")]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string")


def test_targets_and_copies_equal_plain(spark):
    rows = _rows(1)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(plain.words(t))
    want = plain.mix_targets(sizes)
    got = mixing.copies(_frame(spark, rows), keep=("doc_id", "source")).collect()
    for r in got:
        assert (r["source_size"], r.target) == (sizes[r.source], pytest.approx(want[r.source], rel=1e-12))
    assert sorted((r.doc_id, r.copies) for r in got) == sorted(plain.mix_copies(rows))
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_taken_words_come_near_the_targets(spark):
    rows = _rows(2, 6000)
    taken, target = Counter(), {}
    for r in mixing.copies(_frame(spark, rows), keep=("doc_id", "source")).collect():
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.15 * t


def test_mix_repeats_rows_alike_on_any_partitioning(spark):
    rows = _rows(3, 200)
    df = _frame(spark, rows)
    out = mixing.mix(df)
    assert out.columns == df.columns
    want = Counter({d: c for d, c in plain.mix_copies(rows) if c})
    assert Counter(r.doc_id for r in out.collect()) == want
    assert Counter(r.doc_id for r in mixing.mix(df.repartition(7, "text")).collect()) == want


def test_empty_null_and_repeated_rows(spark):
    assert mixing.mix(_frame(spark, _rows(4)).limit(0)).count() == 0
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c d e", None)]
    got = sorted((r.doc_id or 0, r.copies) for r in mixing.copies(_frame(spark, rows)).collect())
    assert got == sorted((d or 0, c) for d, c in plain.mix_copies(rows)) and len(set(got[1:])) == 1
    zero = mixing.copies(_frame(spark, [(1, None, "s"), (2, "", "t")])).collect()
    assert [(r["size"], r.target, r.copies) for r in zero] == [(0, 0.0, 0)] * 2
