"""Repeated substrings against a dictionary of all windows."""

import hashlib
import random
from collections import defaultdict

import pytest
from stafflens.llm import substrings


def brute(texts, length):
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    places = defaultdict(int)
    for r in raw:
        for i in range(len(r) - length + 1):
            places[r[i : i + length]] += 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if places[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, length, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame(list(zip(ids, texts, [1] * len(texts))), "doc_id long, text string, unit int").repartition(3)
    rows = substrings.repeated_spans(df, length=length).collect()
    for r in rows:
        assert sum(s.hi - s.lo for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return sorted(((r.doc_id is None, r.doc_id or 0), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in rows)


def expect(texts, length, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return sorted(((i is None, i or 0), b) for i, b in zip(ids, brute(texts, length)))


def word(rng):
    return "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))


def corpus(seed, n=60):
    rng = random.Random(seed)
    pool = [" ".join(word(rng) for _ in range(30)) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word(rng) for _ in range(rng.randint(0, 20)))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(pool)
            a, b = sorted(rng.sample(range(len(p)), 2))
            parts += [p[a:b], word(rng)]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    return texts


def test_transform_finds_repeated_windows():
    for seed in range(25):
        texts = [t.encode() for t in corpus(seed, 12)]
        length = 8 + seed
        places = defaultdict(int)
        for t in texts:
            for i in range(len(t) - length + 1):
                places[t[i : i + length]] += 1
        want = [[i for i in range(len(t) - length + 1) if places[t[i : i + length]] > 1] for t in texts]
        assert [f.tolist() for f in substrings.repeated_starts(texts, length)] == want


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    texts = corpus(seed) + ["", None, "a" * 200, "ab" * 90, "short", *corpus(seed)[:5]]
    assert run(spark, texts, 24) == expect(texts, 24)


def test_hot_passage_is_cut_and_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST", 4)
    rng = random.Random(7)
    passage = " ".join(word(rng) for _ in range(20))
    texts = [" ".join([word(rng), word(rng), passage, word(rng), word(rng)]) for _ in range(40)] + ["x" * 300] * 3
    assert run(spark, texts, 32) == expect(texts, 32)


def test_repeated_rows_null_ids_and_empty_table(spark):
    texts = ["one two three four five six seven", "one two three four five six seven", "eight nine ten", None]
    ids = [5, 5, None, None]
    assert run(spark, texts, 16, ids) == expect(texts, 16, ids)
    assert substrings.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_crosses_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_PIECE", 256)
    rng = random.Random(3)
    texts = [" ".join(word(rng) for _ in range(600))]
    texts.append(texts[0][:700] + "Q" + texts[0][690:1500])
    assert sorted(substrings.anchored([texts[0].encode()], 24)[2].tolist())[0] == 0
    assert run(spark, texts, 24) == expect(texts, 24)


def run_short(spark, texts, length, short):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = substrings.repeated_spans(df, length=length, short=short).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_repeated_short) for r in rows)


def expect_short(texts, length, short):
    return [(i, *a, b[1]) for i, (a, b) in enumerate(zip(brute(texts, length), brute(texts, short)))]


@pytest.mark.parametrize("seed,short", [(1, 16), (2, 10), (3, 24)])
def test_a_shorter_bound_leaves_the_removal_as_it_is(spark, seed, short):
    texts = corpus(seed) + ["", None, "a" * 200, "ab" * 90, "short", "a" * short, "b" * 20, "b" * 20, *corpus(seed)[:5]]
    assert run_short(spark, texts, 24, short) == expect_short(texts, 24, short)


def test_hot_short_passage_with_a_tail_of_its_own_each(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST", 4)
    rng = random.Random(8)
    passage = " ".join(word(rng) for _ in range(8))[:26]
    tails = [" ".join(word(rng) for _ in range(6)) for _ in range(12)]
    texts = [" ".join([word(rng), word(rng), passage, rng.choice(tails), word(rng)]) for _ in range(40)]
    texts += ["x" * 300, passage, passage + tails[0][:9]]
    assert run_short(spark, texts, 32, 20) == expect_short(texts, 32, 20)


def test_a_shorter_bound_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_PIECE", 256)
    rng = random.Random(5)
    texts = [" ".join(word(rng) for _ in range(600))]
    texts.append(texts[0][:700] + "Q" + texts[0][680:1500] + "Q" + texts[0][300:318])
    assert run_short(spark, texts, 24, 16) == expect_short(texts, 24, 16)


def test_windows_of_two_lengths_and_context():
    rng = random.Random(4)
    for k in range(150):
        letters = "ab" if k % 3 else "abcdefgh "
        base = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))).encode() for _ in range(3)]
        strings = [rng.choice(base) * rng.randint(1, 3) + rng.choice(base)[: rng.randint(0, 30)] for _ in range(rng.randint(1, 12))]
        windows = [rng.randint(0, len(s) + 2) for s in strings]
        lengths = sorted({rng.randint(1, 20), rng.randint(5, 90)})
        found = substrings._repeated_starts(strings, windows, lengths)
        for length, own in zip(lengths, found):
            starts = [range(max(0, min(n, len(s) - length + 1))) for s, n in zip(strings, windows)]
            places = defaultdict(int)
            for s, at in zip(strings, starts):
                for i in at:
                    places[s[i : i + length]] += 1
            assert [f.tolist() for f in own] == [[i for i in at if places[s[i : i + length]] > 1] for s, at in zip(strings, starts)]


def periodic(rng):
    body = "bletion " * 60
    texts = [word(rng) + " " + body[: rng.randint(200, 400)] + word(rng) + " " + " ".join([word(rng)] * 40) for _ in range(12)]
    return texts + ["a" * 150 + word(rng) for _ in range(12)] + [body[3:], "zu " * 90]


@pytest.mark.parametrize("most", [256, 4])
def test_periodic_texts_stay_exact(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST", most)
    texts = periodic(random.Random(9))
    assert run_short(spark, texts, 40, 24) == expect_short(texts, 40, 24)


def test_a_periodic_text_is_not_copied_for_each_period(spark):
    """Segments and their parts grow with a text's bytes, not with its bytes times a window's length."""
    text = "x" + "bletion " * 500
    key = substrings.anchored([text.encode()], 250)[1].view("int64").tolist()
    moved = spark.createDataFrame([(b"u", text, sorted(set(key)))], "unit binary, text string, hashes array<long>")
    segments = substrings._segments(moved, [250, 400])
    rows = segments.collect()
    assert sum(r.windows for r in rows) == len(text) - 249
    assert sum(len(r.seg) for r in rows) < 4 * len(text) and len(rows) < len(set(key)) + len(text) // 400 + 2 < len(key) // 4
    for length in (250, 400):
        parts = substrings._cut(segments, length, 27).collect()
        assert sum(p.windows for p in parts) == len(text) - 249 - (length - 250) * sum(r.start + r.windows == len(text) - 249 for r in rows)
        assert len(parts) < len(key) // 4


def test_parts_of_a_bound_are_one_whatever_follows(spark):
    """A passage with a tail of its own in each of many texts: its windows of the shorter bound become the same few parts."""
    rng = random.Random(10)
    passage = "".join(word(rng) + " " for _ in range(120)).encode()[:300]
    segs = [(str(i).encode(), passage[:290] + bytes(str(i) * 60, "ascii"), [100], 41) for i in range(1000, 1050)]
    hot = spark.createDataFrame(segs, "seg_id binary, seg binary, anchors array<int>, windows int")
    parts = substrings._cut(hot, 250, 10).collect()
    assert len({p.seg_id for p in parts}) <= 5 and sum(p.windows for p in parts) == 50 * 41
