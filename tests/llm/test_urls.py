import random

import pytest
import xxhash

from stafflens.llm import urls

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("block", "a.com/x"), ("allow", "a.com/xy"), ("block", "b.a.com/"), ("allow", "dup.net/"), ("block", "dup.net/")]
URLS = [
    "http://example.org/es/1", "HTTP://WWW.Example.ORG/en/12?x=/es/", "https://example.org", "https://example.org?q", "x", None, "", "://", "http:///p", "ftp://org/", "http://notorg/",
    "http://a.com/xyz", "http://b.a.com/xyz", "http://b.a.com/q#/f", "http://c.b.a.com/", "http://dup.net/a", "http://example.org:80/es/", "a://b://example.org/es/", "http://example.org/ES/", "http://Ünï.org/", "http://org\n/x", "http://a.com" + "/x" * 5000,
]


def _plain(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = []
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), len(h), verdict == "block", rule, verdict))
    best = max(fits, default=None)
    return (host, path, best[3], best[4]) if best else (host, path, None, "allow")


def _frame(spark):
    rng = random.Random(8)
    more = [f"http://{rng.choice(['x.', ''])}{rng.choice(['a.com', 'example.org', 'b.a.com', 'z.net'])}/{rng.choice(['x', 'xy', 'en/1', 'es/', ''])}{rng.randint(0, 9)}" for _ in range(200)]
    rows = [(i, u, "r", 1) for i, u in enumerate(URLS + more)]
    return spark.createDataFrame(rows, "page_id long, url string, rule string, host int").repartition(4), rows


def test_both_paths_equal_plain(spark):
    df, rows = _frame(spark)
    want = {i: _plain(u) for i, u, _, _ in rows}
    index = urls.build_index(spark, RULES)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, index).collect()} == want
    table = spark.createDataFrame([(rule, verdict) for verdict, rule in RULES], "rule string, verdict string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_by_join(df, table).collect()} == want
    assert urls.judge(df.limit(0), index).count() == 0


def test_collisions_are_told_apart_by_the_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: len(b) % 2)
    path = tmp_path / "index"
    rules = urls._checked(RULES)
    path.write_bytes(urls.pack_index(rules).tobytes())
    array = urls.DigestArray(str(path))
    probes = [r.encode() for r in rules] + [b"nowhere/", b"org", b"zzz/"]
    found = array.find(probes)
    assert [array.string(p).decode() if p >= 0 else None for p in found] == [*rules, None, None, None]


def test_rules_are_checked(spark):
    for bad in ([("deny", "a/")], [("block", "a")], [("block", None)]):
        with pytest.raises(ValueError):
            urls.build_index(spark, bad)
    assert urls.judge(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), urls.build_index(spark, [])).collect()[0].verdict == "allow"


def test_hosts_of_any_size_cost_what_the_rules_cost(spark):
    hosts = ["a." * 50_000 + "example.org", "b" * 100_000 + ".example.org", "." * 100_000 + "a.com", "c" * 100_000, "example.org" + "." * 1000]
    rows = [(i, f"http://{h}/x/es/") for i, h in enumerate(hosts)] + [(9, "http://www.a.com/xy")]
    assert max(len(urls._probes(h, "/x/es/", [1, 3, 5], 2, 11)) for h in hosts) <= 6
    df = spark.createDataFrame(rows, "page_id long, url string")
    want = {i: _plain(u)[2:] for i, u in rows}
    table = spark.createDataFrame([(rule, verdict) for verdict, rule in RULES], "rule string, verdict string")
    for out in (urls.judge(df, urls.build_index(spark, RULES)), urls.judge_by_join(df, table)):
        assert {r.page_id: (r.rule, r.verdict) for r in out.collect()} == want
    assert urls.judge_by_join(df, table.limit(0)).where("rule is null and verdict = 'allow'").count() == len(rows)
