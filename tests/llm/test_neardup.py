"""Near-duplicates against all pairs of full sets."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from stafflens.llm import neardup
from stafflens.llm import shingles as S


def _text(rng, n):
    return [rng.choice(["the", "of", "an", "El", "Über"]) + str(rng.randint(0, 3000)) for _ in range(n)]


def _edited(rng, base, edits):
    own = list(base)
    for _ in range(edits):
        i = rng.randrange(len(own))
        own[i : i + 1] = _text(rng, rng.choice([0, 1, 2]))
    return own


def _corpus(seed):
    rng = random.Random(seed)
    texts = []
    for n in (12, 40, 150, 400):
        base = _text(rng, n)
        for _ in range(25):
            texts.append(" ".join(_edited(rng, base, rng.randint(0, max(1, n // 20)))))
    texts += [" ".join(_text(rng, rng.randint(1, 60))) for _ in range(40)]
    texts += ["", None, "one two", "One  TWO", "one two three", "\t\n ", texts[0].upper(), texts[0]]
    rng.shuffle(texts)
    return texts


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, id int, bands int").repartition(3)


@pytest.mark.parametrize("block", [64, 5])
def test_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # 5: families are thinned and cut
    rows = list(enumerate(_corpus(block)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components_of_documents(_frame(spark, rows)).collect()}
    assert got == plain.near_components(rows)


def test_hot_family_and_one_kept(spark):
    rng = random.Random(9)
    base = _text(rng, 120)
    rows = [(i, " ".join(_edited(rng, base, rng.randint(0, 3)))) for i in range(250)]
    rows += [(i, " ".join(base)) for i in range(250, 300)] + [(1000, " ".join(_text(rng, 90)))]
    want = plain.near_components(rows)
    df = _frame(spark, rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components_of_documents(df).collect()}
    assert got == want
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in want.items() if c == d}


def test_null_and_repeated_ids_and_empty_table(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(None, t), (None, None), (4, t), (4, t), (7, t), (8, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in neardup.components_of_documents(df).collect()), key=repr)
    assert rows == sorted([(-1, 0, None, True), (-1, 4, None, True), (4, 4, 4, True), (4, 4, 4, True), (7, 4, 4, False), (8, 0, 8, True)], key=repr)
    assert neardup.components_of_documents(df.limit(0)).count() == 0
    assert neardup.keep_one(df.where(F.col("doc_id") > 100)).count() == 0


def test_shingle_sets_equal_sets_of_tuples():
    rng = random.Random(5)
    texts = _corpus(1) + [" ".join(_text(rng, 5000)), "x" * 300_000, "a\x0bb\x0cc\rd\te\nf", "á b　c d e f"]
    for t, s in zip(texts, S.shingle_sets(texts)):
        assert len(s) == len(plain.shingles(t)) and (s[1:] > s[:-1]).all()
    a, b = S.shingle_sets([texts[0], (texts[0] or "x").upper()])
    assert len(a) == len(b)


def test_words_made_to_collide_are_different(spark):
    """Words of a doubling pattern and their complements collide in every polynomial modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other), (3, word.upper())], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.components_of_documents(df).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}
    assert not set(S.shingle_sets([word])[0].tolist()) & set(S.shingle_sets([other])[0].tolist())


def test_long_texts_have_the_keys_of_short_ones(monkeypatch):
    text = " \x0b".join(f"W{i % 977}é" for i in range(3000))
    want = S.shingle_sets([text])[0].tolist()
    monkeypatch.setattr(S, "_CHUNK", 100)
    assert S.shingle_sets(["x", text, None])[1].tolist() == want


def test_keep_one_keeps_every_column_whatever_its_name(spark):
    df = spark.createDataFrame([(1, "a b c", 5, 9), (2, "a b c", 6, 9)], "doc_id long, text string, __row int, whole int")
    out = neardup.keep_one(df)
    assert out.dtypes == df.dtypes and [tuple(r) for r in out.collect()] == [(1, "a b c", 5, 9)]
