"""Pseudonyms against a plain Python version of the same permutation."""

import datetime as dt
import hashlib
import re

from stafflens.llm import pii

KEY = "k"


def _feistel(l, r, a, b, kind):
    def f(i, half):
        return int(hashlib.sha256(f"{KEY}:{kind}:{i}:{half}:{a}:{b}".encode()).hexdigest()[:12], 16)

    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            l = (l + f(i, r)) % a
        else:
            r = (r + f(i, l)) % b
    return l, r


def _permuted(s, kind):
    digits, letters = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    out = ""
    for at in range(0, len(s), 20):
        p = s[at : at + 20]
        parts = p[: len(p) // 2], p[len(p) // 2 :]
        nums, sizes = [], []
        for part in parts:
            n, m = 0, 1
            for c in part:
                alphabet = digits if c.isdigit() else letters
                n, m = n * len(alphabet) + alphabet.index(c), m * len(alphabet)
            nums.append(n)
            sizes.append(m)
        for n, part in zip(_feistel(*nums, *sizes, kind), parts):
            text = ""
            for c in reversed(part):
                alphabet = digits if c.isdigit() else letters
                n, k = divmod(n, len(alphabet))
                text = alphabet[k] + text
            out += text
    return out


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def _fill(m, chars):
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in m)


def _run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.asDict() for r in pii.pseudonymise(df, KEY, counts=True).orderBy("doc_id").collect()]


def test_each_kind_matches_the_plain_version(spark):
    card = "4111111111111111"
    rows = _run(spark, [
        f"a {card} b", "mail Jo.Doe42@mail8.example.com!", "call +1 (988) 555-2485 now", "at 42.144.35.254,",
        "id 123-45-6789", "born 1987-02-28 or 02/28/1987", "4111 1111 1111 1111",
    ])
    payload = _permuted(card[:-1], "card")
    check = next(str(c) for c in range(10) if _luhn(payload + str(c)) == 0)
    assert rows[0]["text"] == f"a {payload}{check} b" and rows[0]["n_card"] == 1
    local = _fill("Jo.Doe42", _permuted("jodoe42", "email"))
    assert rows[1]["text"] == f"mail {local}@mail8.example.com!" and rows[1]["n_email"] == 1
    assert rows[2]["text"] == "call " + _fill("+1 (988) 555-2485", "1" + _permuted("9885552485", "phone")) + " now"
    l, r = _feistel(42 * 256 + 144, 35 * 256 + 254, 65536, 65536, "ip")
    assert rows[3]["text"] == f"at {l >> 8}.{l & 255}.{r >> 8}.{r & 255},"
    l, r = _feistel(122 * 99 + 44, 6788, 898 * 99, 9999, "ssn")
    area = l // 99 + (2 if l // 99 >= 665 else 1)
    assert rows[4]["text"] == f"id {area:03d}-{l % 99 + 1:02d}-{r + 1:04d}"
    since = (dt.date(1987, 2, 28) - dt.date(1600, 1, 1)).days
    l, r = _feistel(since // 5411, since % 5411, 27, 5411, "date")
    day = dt.date(1600, 1, 1) + dt.timedelta(days=l * 5411 + r)
    assert rows[5]["text"] == f"born {day:%Y-%m-%d} or {day:%m/%d/%Y}" and rows[5]["n_date"] == 2
    assert rows[6]["text"].replace(" ", "") == payload + check  # linked to the unspaced form


def test_invalid_candidates_and_edges_stay(spark):
    texts = ["4111111111111112", "999.1.1.1", "2023-02-30", "000-12-3456", "", None, "x" * 100_000, "12345678901234567890123", "no data", "v4.0."]
    rows = _run(spark, texts)
    assert [r["text"] for r in rows] == texts
    assert all(r[f"n_{k}"] == 0 for r in rows for k in pii.KINDS)


def test_long_text_repeats_and_extra_columns(spark):
    text = "1.2.3.4 " * 5000 + "é 10.0.0.1"
    df = spark.createDataFrame([(1, text, "a", 5), (1, text, "a", 5)], "doc_id long, text string, __m string, n_chars int")
    out = pii.pseudonymise(df, KEY)
    a, b = out.collect()
    assert a == b and out.columns == df.columns and a["__m"] == "a"
    assert len(set(a.text.split(" ")[:5000])) == 1 and not re.search(r"\b1\.2\.3\.4\b", a.text)
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0


def test_permutation_has_no_collisions(spark):
    df = spark.createDataFrame([(i, f"{i % 256}.{i // 256}.0.1 u{i}@x.org") for i in range(3000)], "doc_id long, text string")
    rows = [r.text for r in pii.pseudonymise(df, KEY).collect()]
    assert len({r.split(" ")[0] for r in rows}) == 3000 and len({r.split(" ")[1] for r in rows}) == 3000


def test_more_formats_match_the_plain_version(spark, tmp_path):
    rows = _run(spark, [
        "card 3782 822463 10005.", "tel +33 1 23 45 67 89 or +33123456789", "pay GB82 WEST 1234 5698 7654 32 now", "DE89370400440532013000",
        "from 2001:db8::8a2e:370:7334 and 2001:0DB8:0:0:0:8a2e:0370:7334", "std::vector at 10:20:30, ::1, a::b, GB82 WEST 1234 5698 7654 33, +1 23",
    ])
    payload = _permuted("37828224631000", "card")
    check = next(str(c) for c in range(10) if _luhn(payload + str(c)) == 0)
    assert rows[0]["text"] == "card " + _fill("3782 822463 10005", payload + check) + "." and rows[0]["n_card"] == 1
    phone = _permuted("123456789", "phone")
    assert rows[1]["text"] == "tel " + _fill("+33 1 23 45 67 89", "33" + phone) + " or +33" + phone and rows[1]["n_phone"] == 2

    def mod97(s):
        return int("".join(str(int(c, 36)) for c in s)) % 97

    for row, country, account, shape in ((rows[2], "GB", "west12345698765432", "GB82 WEST 1234 5698 7654 32"), (rows[3], "DE", "370400440532013000", "DE89370400440532013000")):
        p = _permuted(account, "iban").upper()
        want = _fill(shape, f"{country}{98 - mod97(p + country + '00'):02d}{p}")
        assert want in row["text"] and row["n_iban"] == 1 and mod97(p + country + want[2:4]) == 1
    net = _feistel(0x20010DB8, 0, 1 << 32, 1 << 32, "ip6-net")
    host = _feistel(0x8A2E, 0x03707334, 1 << 32, 1 << 32, "ip6")
    address = ":".join(f"{x:x}" for n in (*net, *host) for x in (n >> 16, n & 65535))
    assert rows[4]["text"] == f"from {address} and {address}" and rows[4]["n_ip6"] == 2
    assert rows[5]["text"].startswith("std::vector at 10:20:30, ::1, a::b, GB82 WEST 1234 5698 7654 33, +1 23")


def test_a_key_from_a_file_is_in_no_plan(spark, tmp_path):
    (tmp_path / "key").write_text(KEY + "\n")
    df = spark.createDataFrame([(1, "mail jo.doe@x.org and 10.1.2.3", 7)], "doc_id long, text string, n_email int")
    out = pii.pseudonymise(df, pii.secret(spark, str(tmp_path / "key")), counts=True)
    assert out.columns == ["doc_id", "text", *(f"n_{k}" for k in pii.KINDS)]
    assert out.select("text", "n_email").collect() == pii.pseudonymise(df, KEY, counts=True).select("text", "n_email").collect()
    (tmp_path / "long").write_text("a-secret-of-its-own")
    out = pii.pseudonymise(df, pii.secret(spark, str(tmp_path / "long")))
    out.collect()
    assert "a-secret-of-its-own" not in out._jdf.queryExecution().toString()
    assert "a-secret-of-its-own" in pii.pseudonymise(df, "a-secret-of-its-own")._jdf.queryExecution().toString()
