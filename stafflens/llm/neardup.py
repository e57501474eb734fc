"""Near-duplicates by MinHash banding, verified on full sets, as connected components.

1. One pass over the texts: shingle set, 128-bit digest of the set, and the band
   keys of the universal hash minima. Sets themselves are not moved.
2. Equal sets are one class (a partial minimum of the ids), one of its rows
   represents it.
3. Rows that share a band key are linked to the smallest one of the
   bucket (a star, never pairs; one shuffle of the keys of some bands at a time). The components of these unverified links are
   *families*: every pair that shares a bucket lies in one family, so no link
   can cross two of them.
4. The sets of family members are made again from their texts and stored. A
   family of up to ``BLOCK`` members is compared in one task. A larger one is
   thinned and cut first (see ``_large_families``).
5. In a task, pairs that are not yet connected are compared by size, then by
   signature, then on their full sets; the links that join something new are
   returned, at most one less than the rows of the task.
6. Components of the verified links by alternating large-star and small-star.

Two texts of similarity 0.85 miss each other in all 25 bands of five minima
with a probability of 4e-7, and 0.8 with 5e-5 (1e-7 in 40 bands, which the pipeline
takes); a signature rejects a true link with less than 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stafflens.llm import shingles as S
from stafflens.llm.common import components, discard, stored

ROWS = 5
#: Members of a family, or of one side of a pair of blocks, that a task compares.
BLOCK = 64
#: A large family is cut into at most this many blocks while its blocks stay small enough for a task.
PARTS = 32
MOST = 4096
#: Bands whose keys are grouped in one job.
SLICE = 10
#: Up to so many keys in all, sets are compared by one product instead of pair by pair.
SMALL = 4096


class Seen:
    """The digests that a task has had, up to a bound; one that is forgotten counts as new again."""

    MOST = 1 << 17

    def __init__(self):
        self.had: set[tuple[int, int]] = set()

    def first(self, digests: list[tuple[int, int]]) -> list[bool]:
        out = []
        for d in digests:
            out.append(d not in self.had)
            self.had.add(d)
        if len(self.had) > self.MOST:
            self.had.clear()
        return out


def _digest(texts: DataFrame, carry: list[str], bands: int) -> DataFrame:
    """``carry``, n_shingles, k1, k2 (digest of the set), bands (null for empty sets and for one that the task had before)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Seen()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                sets = S.shingle_sets(part["__text"].tolist())
                keys = S.band_keys(S.signatures(sets, bands * ROWS), ROWS)
                out = part[carry].copy()
                out["n_shingles"] = [len(s) for s in sets]
                digest = [S.set_key(s) for s in sets]
                out["k1"], out["k2"] = [d[0] for d in digest], [d[1] for d in digest]
                new = seen.first(digest)
                out["bands"] = [k if len(s) and n else None for k, s, n in zip(keys, sets, new)]
                yield out

    kinds = dict(texts.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    return texts.mapInPandas(run, f"{schema}, n_shingles long, k1 long, k2 long, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """id, family and the sorted shingle keys of ``__text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                out = part[["id", "family"]].copy()
                out["shingles"] = [s.view(np.int64) for s in S.shingle_sets(part["__text"].tolist())]
                yield out

    kinds = dict(texts.dtypes)
    return texts.select("id", "family", "__text").mapInPandas(run, f"id {kinds['id']}, family {kinds['family']}, shingles array<long>")


def links_among(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning set of the links (100 * common >= percent * union) among sorted sets.

    ``sides`` (0 or 1 for each set) restricts the pairs to those across.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    if size.sum() <= SMALL:
        # Few keys in all: the sizes of all intersections in one product.
        owner = np.repeat(np.arange(n), size)
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        holds = np.zeros((n, token.max() + 1), dtype=np.float32)
        holds[owner, token] = 1
        common = (holds @ holds.T).astype(np.int64)
        linked = np.triu(100 * common >= percent * (size[:, None] + size[None, :] - common), 1)
        if sides is not None:
            linked &= sides[:, None] != sides[None, :]
        for i, k in np.argwhere(linked).tolist():
            a, b = find(i), find(k)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, k))
        return out

    width = 125
    sig = S.signatures(sets, width)
    # Five standard deviations below the share of equal minima that a pair at the threshold expects.
    p = percent / 100
    floor = p - 5 * (p * (1 - p) / width) ** 0.5
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        if sides is not None:
            j = j[sides[j] != sides[i]]
        j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
        if len(j):
            j = j[(sig[j] == sig[i]).mean(axis=1) >= floor]
        for k in j.tolist():
            a, b = find(i), find(k)
            if a != b:
                common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if 100 * common >= percent * (size[i] + size[k] - common):
                    root[max(a, b)] = min(a, b)
                    out.append((i, k))
    return out


def _compare(blocks: DataFrame, percent: int, id_type: str) -> DataFrame:
    """Links (a, b) inside each key of ``blocks``: (key, side, id, shingles).

    The rows are dealt by key and stream through the task in key order; only
    one key's rows are held.
    """

    def verified(rows: list[tuple]) -> list[tuple]:
        sets = [np.asarray(r[3], dtype=np.int64).view(np.uint64) for r in rows]
        sides = np.array([r[1] for r in rows])
        across = sides if (sides != sides[0]).any() else None
        return [(rows[i][2], rows[k][2]) for i, k in links_among(sets, percent, across)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            out = []
            for row in zip(batch["key"], batch["side"], batch["id"], batch["shingles"]):
                if row[0] != key and held:
                    out += verified(held)
                    held = []
                key = row[0]
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
        if held and (out := verified(held)):
            yield pd.DataFrame(out, columns=["a", "b"])

    dealt = blocks.select("key", "side", "id", "shingles").repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(run, f"a {id_type}, b {id_type}")


def _large_families(members: DataFrame, sizes: DataFrame, percent: int, id_type: str) -> DataFrame:
    """Links of the families of more than BLOCK members.

    A shingle that no other member has lies in no intersection: members with
    too few shared ones for a link to the smallest possible partner leave. The
    member whose shingles are most shared is the centre; all others are
    compared with it natively, one row each. Members linked to it are in one
    component, so only the rest is left to be compared, with itself and with
    those, in pairs of blocks; a block has at most MOST members.
    """
    rows = members.join(sizes.where(F.col("members") > BLOCK), "family")
    rows = stored(rows.select("family", "id", "shingles"), "large")
    tokens = rows.select("family", "id", F.explode("shingles").alias("h"))
    df = stored(tokens.groupBy("family", "h").agg(F.count("*").alias("df")), "df")
    shared = tokens.join(df, ["family", "h"]).groupBy("family", "id").agg(F.count("*").alias("n"), F.sum((F.col("df") > 1).cast("long")).alias("shared"), F.avg("df").alias("score"))
    # A partner has at least percent % of a member's keys, and no fewer than the family's smallest member.
    least = stored(rows.groupBy("family").agg(F.min(F.size("shingles")).alias("least")), "least")
    partner = F.greatest(F.ceil(percent * F.col("n") / 100), F.col("least"))
    possible = (100 + percent) * F.col("shared") >= percent * (F.col("n") + partner)
    shared = stored(shared.join(least, "family").where(possible).drop("least"), "shared")
    centre = shared.groupBy("family").agg(F.max_by("id", F.struct("score", F.col("n"))).alias("centre"))
    centre = stored(centre.join(rows, (centre.centre == rows.id) & (centre.family == rows.family)).select(centre.family, "centre", F.col("shingles").alias("core")), "centre")
    left = stored(rows.join(shared.select("family", "id"), ["family", "id"]), "eligible")
    common = F.size(F.array_intersect("shingles", "core"))
    union = F.size("shingles") + F.size("core") - common
    left = left.join(centre, "family").withColumn("linked", 100 * common >= percent * union)
    left = stored(left.select("family", "id", "shingles", "centre", "linked"), "centred")
    star = left.where("linked and id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))

    counts = left.groupBy("family").agg(F.sum((~F.col("linked")).cast("long")).alias("rest"), F.count("*").alias("n"))
    size = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST), F.ceil(F.col("n") / PARTS)))
    counts = stored(counts.where("rest > 0").withColumn("g_rest", F.ceil(F.col("rest") / size).cast("int")).withColumn("g_linked", F.ceil((F.col("n") - F.col("rest")) / size).cast("int")), "counts")
    cut = left.join(counts, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("linked"), F.greatest("g_linked", F.lit(1))).otherwise(F.col("g_rest"))).cast("int"))

    def pair(r: Column, kind: str, other: Column) -> Column:
        return F.concat_ws(":", F.col("family").cast("string"), r.cast("string"), F.lit(kind), other.cast("string"))

    each_rest = F.sequence(F.lit(0), F.col("g_rest") - 1)
    # A block of the rest meets itself and each other block of the rest once, and each block of the linked.
    own = F.transform(each_rest, lambda i: F.struct(pair(F.least(i, F.col("block")), "rest", F.greatest(i, F.col("block"))).alias("key"), (F.col("block") > i).cast("int").alias("side")))
    to_linked = F.when(F.col("g_linked") > 0, F.transform(F.sequence(F.lit(0), F.greatest("g_linked", F.lit(1)) - 1), lambda i: F.struct(pair(F.col("block"), "linked", i).alias("key"), F.lit(0).alias("side")))).otherwise(F.array().cast("array<struct<key:string,side:int>>"))
    of_linked = F.transform(each_rest, lambda i: F.struct(pair(i, "linked", F.col("block")).alias("key"), F.lit(1).alias("side")))
    meets = F.when(F.col("linked"), of_linked).otherwise(F.concat(own, to_linked))
    blocks = cut.select("id", "shingles", F.explode(meets).alias("m")).select("m.key", "m.side", "id", "shingles")
    return star.union(_compare(blocks, percent, id_type))


def classes(df: DataFrame, carry: list[str], key: Column, text: str, percent: int, bands: int, label: str) -> DataFrame:
    """``carry``, n_shingles, component: the smallest key that verified links reach.

    ``key`` is an orderable expression over ``carry``. Rows with a null key,
    and empty sets, are linked with nothing (their component is their own key).
    """
    texts = df.select(*carry, F.col(text).alias("__text"))
    digests = stored(_digest(texts, carry, bands).withColumn("id", key), f"{label}-digest")

    def sets(families: DataFrame) -> DataFrame:
        # The number of members grows with the corpus: this join is a shuffle of the texts at every size.
        moved = stored(texts.withColumn("id", key).join(families.hint("merge"), "id").select("id", "family", "__text"), f"{label}-moved")
        members = stored(_sets(moved), f"{label}-sets")
        discard(moved)
        return members

    return linked(digests, carry, sets, percent, bands, label)


def linked(digests: DataFrame, carry: list[str], sets, percent: int, bands: int, label: str) -> DataFrame:
    """``classes`` from a stored table of digests (``carry``, n_shingles, k1, k2, bands, id), which is deleted.

    Of equal sets one at least has its band keys, the others may have null; sets that can have no link to
    another one have none. ``sets(families)`` stores the sets (id, family, shingles) of the ids of ``families``.
    """
    full = digests.where("id is not null and n_shingles > 0")
    id_type = dict(full.dtypes)["id"]

    # The smallest id names a class; the smallest one with band keys stands for it.
    keyed = F.min(F.when(F.col("bands").isNotNull(), F.col("id")))
    reps = full.groupBy("k1", "k2").agg(F.min("id").alias("low"), keyed.alias("id"))
    reps = stored(reps.select("k1", "k2", "low", F.coalesce("id", "low").alias("id")), f"{label}-classes")
    pairs = []
    for at in range(0, bands, SLICE):
        # A band's number is part of its key. Some bands at a time: so many rows of keys are on disk at once.
        keys = full.select("id", F.explode(F.slice("bands", at + 1, SLICE)).alias("key"))
        low = F.min("id").over(Window.partitionBy("key")).alias("low")
        pairs.append(stored(keys.select("id", low).where("id != low"), f"{label}-buckets"))
    narrow = stored(digests.select(*carry, "n_shingles", "k1", "k2", "id"), f"{label}-rows")
    discard(digests)
    links = pairs[0]
    for p in pairs[1:]:
        links = links.union(p)
    found = components(links, f"{label}-family")
    discard(*pairs)
    families = found.select(F.col("node").alias("id"), F.col("root").alias("family"))
    families = stored(families.join(reps.select("id").distinct(), "id", "left_semi"), f"{label}-families")
    discard(found)

    members = sets(families)
    sizes = stored(members.groupBy("family").agg(F.count("*").alias("members")), f"{label}-sizes")
    small = members.join(sizes.where(F.col("members") <= BLOCK), "family")
    small = small.select(F.col("family").cast("string").alias("key"), F.lit(0).alias("side"), "id", "shingles")
    links = _compare(small, percent, id_type)
    if sizes.where(F.col("members") > BLOCK).limit(1).count():
        links = links.union(_large_families(members, sizes, percent, id_type))
    links = stored(links, f"{label}-links")
    discard(families, members, sizes)
    roots = components(links, f"{label}-cc")

    found = stored(reps.join(roots, reps.id == roots.node, "left").select("k1", "k2", "low", "root"), f"{label}-found")
    discard(reps, roots, links)
    least = found.where("root is not null").groupBy("root").agg(F.min("low").alias("least"))
    roots = stored(found.join(least, "root", "left").select("k1", "k2", F.coalesce("least", "low").alias("least")), f"{label}-roots")
    discard(found)
    out = narrow.join(roots, ["k1", "k2"], "left")
    alone = F.col("id").isNull() | (F.col("n_shingles") == 0)
    return out.select(*carry, "n_shingles", F.when(alone, F.col("id")).otherwise(F.coalesce("least", "id")).alias("component"))


def components_of_documents(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, bands: int = 25) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``df``.

    Defined results: a null or empty text has an empty set and is linked with
    nothing; equal texts are linked whatever their ids; a row without id has a
    null component and is kept; a row that repeats an id is judged by its own
    text; an empty table gives an empty result; extra columns are ignored.
    """
    named = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = classes(named, ["doc_id"], F.col("doc_id"), "text", percent, bands, "near")
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, bands: int = 25) -> DataFrame:
    """One row of each component of ``df``, that of the smallest id (null ids last), columns unchanged.

    Rows are judged by their own text whatever their ids: of equal rows, and of
    equal texts without id, one stays. A null or empty text stays.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("whole")  # its names meet none of these
    rows = stored(df.select(whole, F.monotonically_increasing_id().alias("__row")), "rows")
    named = rows.select("__row", F.col("whole")[key].cast("long").alias("__id"), F.col("whole")[text].alias("text"))
    found = stored(classes(named, ["__row", "__id"], F.col("__row"), "text", percent, bands, "near"), "near-rows")
    order = F.struct(F.col("__id").isNull().alias("none"), "__id", "__row")
    first = found.groupBy("component").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").select("component", F.col("first.__row").alias("first"))
    dropped = found.join(stored(first, "near-first"), "component").where(F.col("__row") != F.col("first")).select("__row")
    return rows.join(stored(dropped, "dropped").hint("merge"), "__row", "left_anti").select("whole.*")
