"""Stages of the pipeline where their rules differ from the queries'."""

import random

import plain

import corpus_pipeline
from stafflens.llm import neardup


def test_near_duplicates_of_similarity_080_go(spark):
    rng = random.Random(80)
    rows = []
    for n in (50, 54, 62):  # one changed word: 41/51, 45/55 and 53/63 of the shingles are common
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        near = [*base[: n // 2], "changed", *base[n // 2 + 1 :]]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(near))]
    far = [f"v{rng.randint(0, 10**6)}" for _ in range(48)]  # 39/49: below 0.8
    rows += [(6, " ".join(far)), (7, " ".join([*far[:24], "changed", *far[25:]]))]
    df = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert kept == {0, 2, 4, 6, 7} == {d for d, (_, c) in plain.near_components(rows, 80).items() if c == d}
    assert {d for d, (_, c) in plain.near_components(rows, 85).items() if c == d} == set(range(8))


def test_rows_are_judged_by_their_own_text(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(5, a), (9, a), (9, b), (3, c), (3, c), (None, d), (None, d), (None, a), (None, None), (None, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    want = [(5, a), (9, b), (3, c), (None, d), (None, None), (None, ""), (4, "")]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)
