from collections import Counter

import numpy as np
import pytest
from tables import SF
from pyspark.sql import functions as F

from stafflens.llm import langid, registry


def _plain_counts(text):
    out = Counter()
    padded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                out[g] += 1
    return out


def _decoded(code):
    code = int(code)
    n = 3 if code >> 63 else 2 if code >> 62 else 1
    code &= ~(1 << 63) if n == 3 else ~(1 << 62) if n == 2 else ~0
    return "".join(chr((code >> 21 * (n - 1 - i)) & 0x1FFFFF or 32) for i in range(n))


@pytest.mark.parametrize("text", ["The cat, the CAT!", "éß 日本語 x", "a", "--", "", "one  two\nthree4four", "abc " * 3000])
def test_counts_equal_plain(text, monkeypatch):
    for piece in (1 << 20, 64):
        monkeypatch.setattr(langid, "_PIECE", piece)
        codes, counts = langid.count_grams(text)
        want = _plain_counts(text)
        if piece == 1 << 20:
            assert Counter({_decoded(c): int(n) for c, n in zip(codes, counts)}) == want
        else:  # pieces end between words
            assert {_decoded(c): int(n) for c, n in zip(codes, counts) if 32 not in map(ord, _decoded(c))} == {g: n for g, n in want.items() if " " not in g}


def test_distance_equals_plain():
    profiles = {k: langid.ranked(*langid.count_grams(t), 20) for k, t in (("en", "the cat sat on the mat with that hat"), ("de", "der hund und die katze und das haus"), ("fr", "le chat est sur la table avec le chien"))}
    scorer = langid.Profiles(profiles, 20)
    for text in ("the hat", "und das", "le chien est la", "zzz", "日本"):
        own = langid.ranked(*langid.count_grams(text), 20).tolist()
        distance = {}
        for k, p in profiles.items():
            p = p.tolist()
            distance[k] = sum(abs(p.index(g) - i) if g in p else 20 for i, g in enumerate(own))
        best = min(sorted(distance), key=lambda k: distance[k])
        assert scorer.predict(text) == (best, pytest.approx(1 - distance[best] / (20 * len(own))))


def test_edges(spark):
    df = spark.createDataFrame([(1, "the cat", "en"), (2, None, "en"), (3, "le chat", None), (4, "42 !", "de"), (None, "der hund", "de"), (5, "x" * 300_000, None)], "doc_id long, text string, lang string")
    profiles = langid.learn(df)
    assert set(profiles) == {"en", "de"}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, profiles).collect()}
    assert got[2] == got[4] == ("und", 0.0) and got[1][0] == "en" and got[None][0] == "de" and got[3][0] in ("en", "de")
    assert langid.learn(df.limit(0)) == {}
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}


def test_held_out_accuracy(spark):
    rows = registry.op6_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(truth, "doc_id")
    n, right = held.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right >= 0.98 * n
    assert rows.where("score < 0 or score > 1").count() == 0 and isinstance(np.float64(1), float)


def test_marks_alone_are_no_letters(spark):
    rows = [(1, "the cat", "en"), (2, "́́ ̂", None), (3, "é", None), (4, "12 ⃝", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(df.where("lang is not null"))
    assert {r.doc_id: r.lang_pred for r in langid.identify(df, profiles).collect()} == {1: "en", 2: "und", 3: "en", 4: "und"}
