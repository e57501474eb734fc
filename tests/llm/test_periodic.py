"""Periodic runs against a scan of every lag at every place, and the query against plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import pytest
from plain import words
from tables import SF, SMALL

from stafflens.llm import periodic, registry


def all_runs(w, length=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(length, exponent * q):
                found.setdefault((i, j + q), q)  # a smaller period of the same stretch came first
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sample(rnd):
    w, k = [], rnd.choice([1, 2, 3, 5, 10])
    while len(w) < rnd.randint(0, 70):
        if rnd.random() < 0.3:
            unit = [rnd.randrange(k) for _ in range(rnd.randint(1, 7))]
            w += unit * rnd.randint(1, 8) + unit[: rnd.randint(0, len(unit))]
        else:
            w.append(rnd.randrange(k + 5))
    return [str(x) for x in w]


@pytest.mark.parametrize("length, exponent", [(6, 4), (2, 2), (3, 3), (8, 5), (20, 2)])
def test_runs_equal_plain(length, exponent):
    rnd = random.Random(length * 10 + exponent)
    for _ in range(600):
        w = sample(rnd)
        assert periodic.runs_of(periodic.coded([x.encode() for x in w]), length, exponent) == all_runs(w, length, exponent), w


def test_segments_hold_frequent_words_only():
    rnd = random.Random(9)
    for _ in range(300):
        w = sample(rnd)
        code = periodic.coded([x.encode() for x in w])
        found = periodic.segments(code)
        assert all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
        for s, e in found:
            assert e - s >= 6 and min(w[s:e].count(x) for x in w[s:e]) >= 4
        assert all(any(s <= a and a + n <= e for s, e in found) for a, n, _ in all_runs(w))


@pytest.mark.parametrize("unit", [["a"], ["a", "b"], [str(i) for i in range(5003)]])
def test_one_long_run(unit):
    w = [x.encode() for x in unit * (60_000 // len(unit))]
    assert periodic.runs_of(periodic.coded(w)) == [(0, len(w), len(unit))]


def test_operator_edges(spark):
    texts = [None, "", " \n", "a a a a a", "a a a a a a", "x " + "a b " * 4 + "y", ("u v " * 3 + "u ") * 5, "k " * 200_000, "k " * 200_000, "a a " * 6]
    df = spark.createDataFrame([(None if i == 4 else i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, runs string").repartition(3)
    got = {r.doc_id: r for r in periodic.periodic_runs(df, keep=("doc_id", "row")).collect()}
    for i, t in enumerate(texts):
        r, w = got[None if i == 4 else i], words(t)
        want = all_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(w) and r.row == 1
        assert r.collapsed == collapsed(w, want)
        best = max(want, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (tuple(r.best) if r.best else None) == best
    assert got[3].runs == [] and got[3].best is None and tuple(got[None].best) == (0, 6, 1)
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, keep=("runs",))


def test_ties_of_the_best_run(spark):
    text = "a b " * 4 + "z " + "c d " * 4
    best = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().best
    assert tuple(best) == (0, 8, 2)


@pytest.mark.parametrize("sf", [SMALL, SF])
def test_query_equals_plain(spark, sf):
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall()
    got = {r.doc_id: tuple(r)[1:] for r in registry.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(rows)
    looped = 0
    for d, t in rows:
        w, h = words(t), zlib.crc32(str(d).encode())
        g, n = h // 10, len(w)
        if n > 3000:
            continue  # the plain scan is quadratic
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            looped += 1
        runs = all_runs(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        assert got[d] == (len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()), d
    assert looped > 5
