"""Language identification by rank-order n-gram profiles.

A language's profile is its ``PROFILE`` most frequent letter n-grams (one to
three letters, words padded with a blank) in rank order; a document's profile
is made the same way from its whole text. The document gets the language with
the least out-of-place distance: the sum, over the document's n-grams, of the
difference of the two ranks, or ``PROFILE`` where the language lacks the n-gram.

Learning counts n-grams over every training text: each task adds up its own
texts per language, Spark adds the tasks' counts, and the ranks are cut in two
steps, within parts of the n-grams and then over the parts' best. Only the
profiles reach the tasks: ``PROFILE`` entries a language.

Defined results: a null text or one without a letter is ``und`` with score 0;
a text whose n-grams no profile knows gets the first language in order, with
score 0; ties in rank go to the smaller n-gram, ties in distance to the first
language in code-point order; without training rows all is ``und``; empty
tables give empty results; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stafflens.llm.common import stored

PROFILE = 300
UNKNOWN = "und"
#: Profiles are broadcast with the tasks: at most so many languages, 300 entries of 12 bytes each.
MOST_LANGUAGES = 5000
#: Characters counted at once; a longer text is counted in pieces that end between words.
_PIECE = 1 << 20
_PARTS = 16


def _letters() -> np.ndarray:
    """For each code point whether it is a letter or a combining mark, found on first use."""
    global _LETTER
    if _LETTER is None:
        import unicodedata

        _LETTER = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])
    return _LETTER


def _has_letter(grams: np.ndarray) -> bool:
    """Whether one of the n-gram codes is a single letter; marks alone are none."""
    import unicodedata

    return any(unicodedata.category(chr(c))[0] == "L" for c in grams[grams < 1 << 62].tolist())


_LETTER: np.ndarray | None = None


def _grams(text: str) -> np.ndarray:
    """Codes of all n-grams of up to ``_PIECE`` characters; 21 bits a letter, 0 is the blank."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(_letters()[points], points, 0)
    points = np.concatenate(([0], points, [0])).astype(np.uint64)
    points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]  # one blank between words
    two = points[:-1] << np.uint64(21) | points[1:]
    three = two[:-1] << np.uint64(21) | points[2:]
    one = points[points != 0]
    # A pair or triple is kept if its middle or ends hold a letter; a triple never has a blank in its middle.
    return np.concatenate((one, two | np.uint64(1 << 62), three[points[1:-1] != 0] | np.uint64(1 << 63)))


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of the whole text in order, and their counts."""
    text = text.lower()
    codes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    at = 0
    while at < len(text):
        to = at + _PIECE
        while to < len(text) and _letters()[ord(text[to])]:
            to += 1
        found = np.sort(_grams(text[at:to]))
        at = to
        if not len(found):
            continue
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        new, n = found[first], np.diff(np.append(first, len(found)))
        codes, counts = _added(codes, counts, new, n)
    return codes, counts


def _added(codes, counts, new, n):
    if not len(codes):
        return new, n
    both, where = np.unique(np.concatenate((codes, new)), return_inverse=True)
    return both, np.bincount(where, weights=np.concatenate((counts, n))).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The ``n`` most frequent codes in rank order; ties go to the smaller code."""
    if len(codes) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:n]


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over whole texts: one row per language and n-gram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(held: dict) -> Iterator[pd.DataFrame]:
            for name, (codes, n) in held.items():
                yield pd.DataFrame({"lang": name, "gram": codes.view(np.int64), "n": n})

        for batch in batches:
            for name, part in batch.groupby("lang", sort=True)["text"]:
                joined, size = [], 0
                for t in [*part.tolist(), None]:
                    if t is None or size > _PIECE // 2:
                        if joined:
                            totals[name] = _added(*totals.get(name, (np.empty(0, np.uint64), np.empty(0, np.int64))), *count_grams("\n".join(joined)))
                        joined, size = [], 0
                    if t is not None:
                        joined.append(t)
                        size += len(t)
            if sum(len(c) for c, _ in totals.values()) > 2_000_000:  # bounds what a task holds
                yield from rows(totals)
                totals = {}
        yield from rows(totals)

    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInPandas(run, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Language to its ranked n-gram codes, learned from all rows of ``df``."""
    counts = stored(gram_counts(df, text, lang), "grams")
    order = [F.col("n").desc(), F.col("gram") < 0, F.col("gram")]  # as unsigned codes
    part = F.pmod(F.xxhash64("gram"), F.lit(_PARTS))
    best = counts.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("r") <= profile)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= profile)
    n = counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out: dict[str, list] = {}
    for row in best.select("lang", "gram").orderBy("lang", "r").collect():  # at most MOST_LANGUAGES * profile rows
        out.setdefault(row[0], []).append(row[1])
    return {k: np.array(v, dtype=np.int64).view(np.uint64) for k, v in out.items()}


class Profiles:
    """Distances of a document's profile to all languages at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names = sorted(profiles, key=lambda k: k.encode())
        self.size = size
        self.codes = np.unique(np.concatenate([profiles[k] for k in self.names])) if self.names else np.empty(0, np.uint64)
        # Rank of each known code in each language; the last row is for unknown codes.
        self.rank = np.full((len(self.codes) + 1, len(self.names)), -1, dtype=np.int32)
        for j, k in enumerate(self.names):
            self.rank[np.searchsorted(self.codes, profiles[k]), j] = np.arange(len(profiles[k]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not isinstance(text, str):
            return UNKNOWN, 0.0
        codes, counts = count_grams(text)
        if not _has_letter(codes):
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == own[known]
        ranks = self.rank[np.where(known, at, len(self.codes))]
        off = np.abs(ranks - np.arange(len(own))[:, None])
        distance = np.where(ranks < 0, self.size, off).sum(axis=0)
        best = int(np.argmin(distance))
        # 1 for a profile in place, 0 for one without a common n-gram.
        return self.names[best], float(1 - distance[best] / (self.size * len(own)))


def identify(df: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = PROFILE) -> DataFrame:
    """``keep``, lang_pred, score (0 to 1): one row per row of ``df``, from the text alone."""
    rows = df.select(*keep, F.col(text).alias("__text"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Profiles(profiles, size)
        for batch in batches:
            found = [scorer.predict(t) for t in batch.pop("__text")]
            yield batch.assign(lang_pred=[f[0] for f in found], score=[f[1] for f in found])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return rows.mapInPandas(run, f"{schema}, lang_pred string, score double")
