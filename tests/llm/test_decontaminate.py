"""Item windows in documents against a plain search over every place."""

import hashlib
import random
import re

import pytest

from stafflens.llm import decontaminate, registry

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(texts, items, window=10):
    own = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)):
            if w:
                own.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in own}:
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                if g in own:
                    hit |= set(range(i, i + k))
                    found |= {str(x) for x in own[g] if x is not None}
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def result(df):
    return {r["key"]: (r["n_words"], sorted({i for s in r["spans"] for i in range(s["start"], s["end"])}), r["items"]) for r in df.collect()}


def tables(spark, texts, items):
    # Columns of other meaning share the operator's own names.
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "key long, text string, spans string, window int").repartition(3)
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, words int")
    return docs, bench


def sample(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "the", "Of", "été", "日本", "x1", "zz", "and", "to"]
    text = lambda n: rnd.choice([" ", "-", "\n", ", "]).join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 3, 4, 5, 9, 10, 11, 14, 30]))) for i in range(25)]
    texts = [text(rnd.randint(0, 60)) for _ in range(60)]
    for _, item in items:
        texts += [item, f"{text(5)} {item.upper() if item.isascii() else item}. {text(7)}", f"{item} {item}"]
    return texts, items


@pytest.mark.parametrize("part_bytes", [decontaminate.PART_BYTES, 400])
def test_equals_plain(spark, part_bytes):
    texts, items = sample(1)
    docs, bench = tables(spark, texts, items)
    got = result(decontaminate.find_items(docs, bench, keep=("key",), part_bytes=part_bytes))
    assert got == dict(enumerate(plain(texts, items)))
    assert sum(bool(x[2]) for x in got.values()) > 40


def test_pieces_and_candidates_of_any_size(monkeypatch):
    texts, items = sample(2)
    by_words = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)):
            by_words.setdefault(" ".join(w[i : i + 10]), []).append(str(item))
    windows = decontaminate.Windows(list(by_words))
    raw = [t.encode() for t in texts]
    import numpy as np

    for piece, candidates in ((1 << 22, 1 << 18), (7, 2)):
        monkeypatch.setattr(decontaminate, "_PIECE", piece)
        monkeypatch.setattr(decontaminate, "_CANDIDATES", candidates)
        rarity = np.zeros(windows.n, dtype=np.int64)
        for _, _, ids in decontaminate.Reader(windows).batches(raw):
            for _, _, number in decontaminate.Reader(windows).places(ids):
                rarity += np.bincount(number, minlength=windows.n)
        joiner = decontaminate.Joiner(windows, windows.prefixes(rarity), list(by_words.values()))
        got = [(int(n), sorted({i for s, e in spans for i in range(s, e)}), found) for counts, all_spans, items_ in joiner.find(raw) for n, spans, found in zip(counts, all_spans, items_)]
        assert got == plain(texts, items)


def test_edges(spark):
    items = [(1, "one two three"), (1, "one two three"), (2, None), (3, " - "), (None, "four five six seven"), (10, "one two three"), (4, "word " * 200)]
    texts = [None, "", "?!", "ONE two; three", "four five six seven eight", "one two", "Word " * 3000, "one two three " * 2, "one two three " * 2, "three one two"]
    docs, bench = tables(spark, texts, items)
    got = result(decontaminate.find_items(docs, bench, keep=("key",)))
    assert got == dict(enumerate(plain(texts, items)))
    assert got[3] == (3, [0, 1, 2], ["1", "10"]) and got[4] == (5, [0, 1, 2, 3], []) and got[6][0] == 3000 == len(got[6][1])
    assert {x[1:] == ([], []) for x in result(decontaminate.find_items(docs, bench.limit(0), keep=("key",))).values()} == {True}
    assert decontaminate.find_items(docs.limit(0), bench, keep=("key",)).count() == 0
    with pytest.raises(ValueError):
        decontaminate.find_items(docs, bench, keep=("spans",))


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(7, "a b c"), (8, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, "b c"), (11, "c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in registry.op11_benchmark_decontamination(spark, str(tmp_path)).collect()}
    assert tuple(got[7])[1:] == (3, 2, 2, hashlib.sha256(b"11,2").hexdigest(), True)
    assert tuple(got[8])[1:] == (0, 0, 0, hashlib.sha256(b"").hexdigest(), False)
