"""Alignment against whole-text encodings and all overlaps by comparison of byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from sentencepiece import SentencePieceProcessor
from tables import SMALL
from tokenizers import Tokenizer

from stafflens.llm import alignment, registry

A_PATH, B_PATH = registry.TOKENIZERS
with open(A_PATH, encoding="utf-8") as f:
    A_JSON = f.read()
with open(B_PATH, "rb") as f:
    B_MODEL = f.read()
A, B = Tokenizer.from_str(A_JSON), SentencePieceProcessor(model_proto=B_MODEL)
A.encode_special_tokens = True
#: The printable stand-ins of a byte-level vocabulary, from the decoder of the library itself.
ALPHABET = ["a", "b ", " ", ",", ".", "'s", "\n", "\t", "\r\n", "12", "ß", "é", "日本", " ", " ", "​", "᠎", "\x00", "\x1c", "\u0085", "▁", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", " the", "ﬁ", "é", "🙂", "Ʊ", "ʒ"]


def spans(ids, bytes_of):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(bytes_of(i))))
        at = out[-1][1]
    return out


def a_bytes(i, side=alignment.byte_side(A_JSON)):
    return side.bytes[i]


def b_bytes(i):
    return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def plain(text):
    """(n_a, n_b, groups, links) of the whole text, encoded at once."""
    a, b = (A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)) if text else ([], [])
    whole = (" " + (text or "")).encode()
    if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
        return 0, 0, [], Counter()
    x, y = spans(a, a_bytes), spans(b, b_bytes)
    links, low = Counter(), 0
    for i, (s, e) in enumerate(x):
        while y[low][1] <= s:
            low += 1
        j = low
        while j < len(y) and y[j][0] < e:
            links[a[i], b[j]] += 1
            j += 1
    groups, before = [], 0
    for cut in sorted({e for _, e in x} & {e for _, e in y}):
        groups.append([[str(i) for i, (_, e) in zip(ids, at) if before < e <= cut] for ids, at in ((a, x), (b, y))])
        before = cut
    return len(a), len(b), groups, links


def expected(texts):
    found = [plain(t) for t in texts]
    total = Counter()
    for *_, links in found:
        total.update(links)
    highest = defaultdict(int)
    for (_, b), n in total.items():
        highest[b] = max(highest[b], n)
    out = []
    for n_a, n_b, groups, links in found:
        best = sum(n for (a, b), n in links.items() if total[a, b] == highest[b])
        text = ";".join("|".join(",".join(side) for side in g) for g in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), best, sum(n * total[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def nasty():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    return [*texts, None, "", " ", "  ", "\n", "x" * 700, "a" * 99 + " " + "b" * 101, "word", "word"]


@pytest.mark.parametrize("piece", [1 << 18, 30])
def test_aligner_equals_plain(monkeypatch, piece):
    monkeypatch.setattr(alignment, "_PIECE", piece)
    monkeypatch.setattr(alignment, "_KNOWN", 300)
    texts = nasty()
    found = alignment.Aligner(A_JSON, B_MODEL).align(texts)
    for i, text in enumerate(texts):
        n_a, n_b, groups, links = plain(text)
        assert (found["n_a"][i], found["n_b"][i], found["n_groups"][i], found["n_links"][i]) == (n_a, n_b, len(groups), sum(links.values())), text
        assert ";".join(found["groups"][i]) == ";".join("|".join(",".join(side) for side in g) for g in groups), text
        keys, counts = found["pairs"][i][0] if found["pairs"][i] else ([], [])
        assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(n) for k, n in zip(keys, counts)} == dict(links), text


def test_query_equals_plain_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in registry.op12_cross_tokenizer_alignment(spark, SMALL).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, expected([d.text for d in docs]))}


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_edges(spark, broadcast_pairs):
    texts = nasty()[-60:]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "id long, text string, n int, pairs int").repartition(3)
    got = alignment.align(df, A_PATH, B_PATH, keep=("id", "n"), with_groups=True, broadcast_pairs=broadcast_pairs).collect()
    assert {r.id: tuple(r[c] for c in COLUMNS) for r in got} == dict(enumerate(expected(texts)))
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got)
    assert alignment.align(df.limit(0), A_PATH, B_PATH, keep=("id",)).count() == 0
    with pytest.raises(ValueError):
        alignment.align(df, A_PATH, B_PATH, keep=("pairs",))


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, None), (3, "two")], "doc_id long, text string")
    got = sorted((tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in alignment.align(df, A_PATH, B_PATH).collect()), key=str)
    want = [(d, *w) for d, w in zip((None, None, 3, 3), expected(["one two", "one two", None, "two"]))]
    assert got == sorted(want, key=str)
