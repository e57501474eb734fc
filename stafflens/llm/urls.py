"""URL allow and block rules in a sorted digest array.

Rules are strings ``host/path``. The 64-bit xxhash of each rule is kept in one
sorted array, beside an array of the rule's place in a table of full strings.
The arrays are written once to the shared folder, fetched by each executor and
memory-mapped there, so all tasks of a machine share one copy of the pages.

A batch of urls is turned into probes (each domain suffix of the host with each
path prefix of a length that some rule has), the probes are hashed, found by
one vectorised binary search, and confirmed against the stored full string, so
a collision of digests can never decide. The longest fitting rule wins, then
the longer host.

The index is fitted to what a machine can map: ``MAX_INDEX_BYTES`` is checked
when it is built; a larger rule set is joined instead (``judge_by_join``).

Defined results: a url that is null or has no ``://`` has an empty host and path
and no rule; a url without a rule gets ``default``; repeated rows are judged
alike; an empty table gives an empty result; repeated rules are one, and of
equal rules that disagree block wins; rules that are null or have no ``/`` are
an error.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stafflens.llm.common import shared_folder

MAX_INDEX_BYTES = 256 << 20
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _checked(rules: Iterable[tuple[str, str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    for verdict, rule in rules:
        if verdict not in (ALLOW, BLOCK) or not rule or "/" not in rule:
            raise ValueError(f"not a rule: {verdict} {rule}")
        if out.get(rule) != BLOCK:
            out[rule] = verdict
    return out


def pack_index(rules: dict[str, str]) -> np.ndarray:
    """One array of bytes: counts and largest host, sorted digests, places, verdicts, string offsets, path lengths, strings."""
    texts = sorted(rules)
    raw = [t.encode() for t in texts]
    keys = np.fromiter((xxhash.xxh64_intdigest(r) for r in raw), dtype=np.uint64, count=len(raw))
    order = np.argsort(keys, kind="stable")
    lengths = np.unique([len(t) - t.index("/") for t in texts]).astype(np.int64)
    offsets = np.cumsum([0, *map(len, raw)]).astype(np.int64)
    verdicts = np.array([rules[t] == BLOCK for t in texts], dtype=np.int64)
    hosts = [t[: t.index("/")] for t in texts]
    labels, longest = max((h.count(".") + 1 for h in hosts), default=0), max(map(len, hosts), default=0)
    head = np.array([len(raw), len(lengths), labels, longest], dtype=np.int64)
    parts = [head, keys[order], order.astype(np.int64), verdicts, offsets, lengths, np.frombuffer(b"".join(raw), dtype=np.uint8)]
    return np.concatenate([p.view(np.uint8) for p in parts])


class DigestArray:
    """A memory-mapped index; ``find`` gives the place of each probe or -1."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype=np.uint8, mode="r")
        n, n_lengths, self.labels, self.longest = data[:32].view(np.int64).tolist()
        at = 32

        def take(count: int, kind) -> np.ndarray:
            nonlocal at
            part = data[at : at + 8 * count].view(kind)
            at += 8 * count
            return part

        self.keys, self.places, self.block = take(n, np.uint64), take(n, np.int64), take(n, np.int64)
        self.offsets, self.lengths = take(n + 1, np.int64), take(n_lengths, np.int64).tolist()
        self.strings = data[at:]

    def string(self, place: int) -> bytes:
        return self.strings[self.offsets[place] : self.offsets[place + 1]].tobytes()

    def find(self, probes: list[bytes]) -> np.ndarray:
        keys = np.fromiter(map(xxhash.xxh64_intdigest, probes), dtype=np.uint64, count=len(probes))
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(probes), -1, dtype=np.int64)
        for i in np.flatnonzero(at < len(self.keys)).tolist():
            k = at[i]
            while k < len(self.keys) and self.keys[k] == keys[i]:  # equal digests stand together
                if self.string(self.places[k]) == probes[i]:
                    out[i] = self.places[k]
                    break
                k += 1
        return out


@lru_cache(maxsize=4)
def _mapped(name: str) -> DigestArray:
    """The executor's copy of an index (``SparkFiles`` fetches it once an executor)."""
    return DigestArray(SparkFiles.get(name))


def build_index(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Write the index to the shared folder and hand it to the executors; returns its name.

    Executors that start later, also in place of lost ones, fetch it too.
    """
    packed = pack_index(_checked(rules))
    if len(packed) > MAX_INDEX_BYTES:
        raise ValueError(f"an index of {len(packed)} bytes is over {MAX_INDEX_BYTES}: use judge_by_join")
    data = packed.tobytes()
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/llm/{name}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        out = store.create(path, True)
        try:
            out.write(data)
        finally:
            out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def _probes(host: str, path: str, lengths: list[int], labels: int, longest: int) -> list[bytes]:
    """Strings that a fitting rule must equal, longest first.

    Of the host only endings of at most ``labels`` labels and ``longest`` characters are
    tried: no rule has a larger one, so a host of any size costs what the rules cost.
    """
    hosts, at = [], len(host)
    while at >= 0 and len(hosts) < labels and len(host) - at <= longest:
        at = host.rfind(".", 0, at)
        hosts.append(host[at + 1 :])
    found = [(len(h) + n, len(h), h + path[:n]) for n in lengths if n <= len(path) for h in hosts if h and len(h) <= longest]
    return [p.encode() for _, _, p in sorted(found, reverse=True)]


def judge(pages: DataFrame, index: str, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """(key, host, path, rule, verdict): one row per row of ``pages``. No shuffle, so no host can be hot."""
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = _mapped(index)
        for batch in batches:
            probes, owner = [], []
            for i, (host, path) in enumerate(zip(batch["host"], batch["path"])):
                own = _probes(host, path, array.lengths, array.labels, array.longest)
                probes += own
                owner += [i] * len(own)
            place = array.find(probes)
            rule: list[str | None] = [None] * len(batch)
            verdict = [default] * len(batch)
            for j in np.flatnonzero(place >= 0)[::-1].tolist():  # the first of a url is the longest and comes last here
                rule[owner[j]] = probes[j].decode()
                verdict[owner[j]] = BLOCK if array.block[place[j]] else ALLOW
            yield batch.assign(rule=rule, verdict=verdict)

    kind = dict(rows.dtypes)[key]
    return rows.mapInPandas(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """The same judgement for rule sets beyond one machine: (rule, verdict) rows are joined on the rule.

    Each url's probes are exploded with the position of its row; the digest is the join key
    and the full string is compared, and the best rule of a row is a partial maximum.
    """
    one = rules.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    shapes = one.select(F.substring_index("rule", "/", 1).alias("h"), (F.length("rule") - F.instr("rule", "/") + 1).alias("n")).distinct()
    most, longest = shapes.agg(F.max(F.size(F.split("h", r"\."))), F.max(F.length("h"))).first()  # the largest host of a rule
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = rows.select("host", "path").distinct()
    labels = F.least(F.size(F.split("host", r"\.")), F.lit(most or 1))
    end = F.right("host", F.lit((longest or 0) + 1))  # one character more: a cut host is longer than any rule's
    ends = urls.where("host != ''").select("host", "path", end.alias("end"), labels.alias("labels"))
    hosts = F.expr("array_distinct(transform(sequence(1, labels), i -> substring_index(end, '.', -i)))")
    probes = ends.select("host", "path", F.explode(hosts).alias("h")).where("h != ''")
    probes = probes.join(shapes, "h").where(F.col("n") <= F.length("path"))
    probes = probes.select("host", "path", F.concat("h", F.substr(F.col("path"), F.lit(1), F.col("n"))).alias("rule"), F.length("h").alias("h"))
    best = probes.join(one, "rule").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("h"))).alias("b"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(key, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def remove_index(path: str) -> None:
    """Delete a local copy of an index (tests)."""
    if os.path.exists(path):
        os.remove(path)
