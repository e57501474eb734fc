"""Benchmark decontamination by a prefix-filtered join of item windows with documents.

An item's windows are its runs of ``window`` consecutive words; an item of
fewer words is one window. A window's tokens are its shingles of ``SHINGLE``
words (all its words, if it has fewer). A document that holds a window holds
all its shingles, so at containment 1 the necessary prefix is one token: the
window's rarest shingle, by occurrences in all documents. The join is on that
token alone; a shingle that no document holds leaves its windows out.

Per candidate the position bound gives the place where the window would start,
the length bound asks that it ends within the document, and the words then
verify it. Words are numbered by the benchmark's own vocabulary (0: a word of
no item), so equal numbers are equal words and nothing rests on digests: those
only preselect.

Documents are read twice, once to count the shingles and once to join, and
never shuffled. The windows go out with the tasks, in parts of at most
``PART_BYTES`` of text; a larger benchmark takes several parts one after the
other, each adding its hits to the stored rows of the one before. Windows are
dealt to parts by their text, so no item or hot phrase can outgrow a part.

Defined results: a null text, or one without words, has no hits; a null or
empty item has no window; a null item id counts no item, but its windows hit;
repeated ids and items count once; without items nothing is hit; empty tables
give empty results. Ties in rarity go to the first shingle of the window.
``keep`` must not name an output column; other columns may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stafflens.llm.common import stored

WINDOW = 10
SHINGLE = 5
OUTPUT = ("n_words", "spans", "items")
#: Text of the windows that are sent to the tasks at once.
PART_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text whose words are held at once, and candidates that are verified at once.
_PIECE = 1 << 22
_CANDIDATES = 1 << 18
#: A word's characters: digits, a to z, and all beyond ASCII; A to Z count as a to z.
_KEPT = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
SPAN = "struct<start:long,end:long>"


def _words(text: Column) -> Column:
    """The words of a text as an array, by JVM functions."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), "")


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, words): distinct windows of each item, words joined by one space, ids as strings."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), _words(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("words"))
    return rows.distinct()


def _keys(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit key of the ``k`` numbers at each place."""
    out = np.zeros(max(len(ids) - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        out = (out + ids[j : j + len(out)].astype(np.uint64)) * np.uint64(_BASE)
        out ^= out >> np.uint64(29)
    return out


class Windows:
    """One part's windows, by number: their words, their items and their shingles."""

    def __init__(self, words: list[str]):
        self.vocabulary: dict[bytes, int] = {}
        self.ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in x.encode().split(b" ")], dtype=np.int64) for x in words]
        # Per shingle length: the sorted distinct keys; a shingle's number counts on over the lengths.
        self.lengths: dict[int, tuple[int, np.ndarray]] = {}
        found = defaultdict(list)
        for ids in self.ids:
            k = min(SHINGLE, len(ids))
            found[k].append(_keys(ids, k))
        self.n = 0
        for k in sorted(found):
            keys = np.unique(np.concatenate(found[k]))
            self.lengths[k] = (self.n, keys)
            self.n += len(keys)

    def shingles(self, window: int) -> np.ndarray:
        """The shingles' numbers of a window in order."""
        ids = self.ids[window]
        k = min(SHINGLE, len(ids))
        first, keys = self.lengths[k]
        return first + np.searchsorted(keys, _keys(ids, k))

    def prefixes(self, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, window, place of the shingle in it), by shingle: each window's rarest; none for a shingle that is nowhere."""
        out = []
        for w in range(len(self.ids)):
            own = self.shingles(w)
            at = int(np.argmin(rarity[own]))
            if rarity[own[at]]:
                out.append((own[at], w, at))
        shingle, window, place = np.array(sorted(out), dtype=np.int64).reshape(-1, 3).T
        return shingle, window, place


class Reader:
    """Numbers of words, and places of the part's shingles, for texts."""

    def __init__(self, windows: Windows, wanted: np.ndarray | None = None):
        self.known, self.lengths = windows.vocabulary, []
        for k, (first, keys) in windows.lengths.items():
            number = first + np.arange(len(keys))
            if wanted is not None:
                keys, number = keys[np.isin(number, wanted)], number[np.isin(number, wanted)]
            bits = max(10, min(24, int(len(keys)).bit_length() + 6))
            maybe = np.zeros(1 << bits, dtype=bool)
            maybe[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.lengths.append((k, keys, number, np.uint64(64 - bits), maybe))

    def ids(self, raw: bytes) -> Iterator[np.ndarray]:
        """Numbers of the words of a text, in pieces that end between words."""
        raw, get, at = raw.translate(_KEPT), self.known.get, 0
        while at < len(raw):
            to = len(raw) if len(raw) - at <= _PIECE else raw.find(b" ", at + _PIECE)
            to = len(raw) if to < 0 else to
            words = raw[at:to].split()
            yield np.fromiter((get(w, 0) for w in words) if len(words) < 8 else map(get, words, [0] * len(words)), dtype=np.int64, count=len(words))
            at = to

    def batches(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, their numbers of words, numbers of all their words with a 0 after each text)."""
        held, counts, first, size = [], [], 0, 0
        for i, raw in enumerate(texts):
            own = list(self.ids(raw)) if raw else []
            held += [*own, np.zeros(1, dtype=np.int64)]
            counts.append(sum(map(len, own)))
            size += len(raw or b"")
            if size >= _PIECE:
                yield first, np.array(counts), np.concatenate(held)
                held, counts, first, size = [], [], i + 1, 0
        if counts:
            yield first, np.array(counts), np.concatenate(held)

    def places(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shingle length, places, shingle numbers) of the wanted shingles."""
        for k, keys, number, shift, maybe in self.lengths:
            if not len(keys):
                continue
            # Only runs of k known words can be a shingle.
            known = np.concatenate(([0], np.cumsum(ids != 0)))
            at = np.flatnonzero(known[k:] - known[:-k] == k) if len(ids) >= k else np.empty(0, dtype=np.int64)
            found = _keys(ids, k)[at]
            some = maybe[(found >> shift).astype(np.int64)]
            at, found = at[some], found[some]
            where = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            same = keys[where] == found
            yield k, at[same], number[where[same]]


def occurrences(df: DataFrame, windows: Windows, text: str) -> np.ndarray:
    """How often each of the windows' shingles occurs in all texts (by number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(windows), np.zeros(windows.n, dtype=np.int64)
        for batch in batches:
            for _, _, ids in reader.batches(batch.column(0).cast(pa.large_binary()).to_pylist()):
                for _, _, number in reader.places(ids):
                    total += np.bincount(number, minlength=windows.n)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["shingle", "n"])

    counts = df.select(F.col(text).alias("text")).where("text is not null").mapInArrow(run, "shingle long, n long")
    out = np.zeros(windows.n, dtype=np.int64)
    for shingle, n in counts.groupBy("shingle").agg(F.sum("n")).collect():  # at most one row per shingle of the part
        out[shingle] = n
    return out


class Joiner:
    """Finds the part's windows in texts."""

    def __init__(self, windows: Windows, prefixes: tuple[np.ndarray, np.ndarray, np.ndarray], items: list[list[str]]):
        self.shingle, self.window, self.place = prefixes
        self.reader = Reader(windows, self.shingle)
        self.items = items
        self.length = np.array([len(x) for x in windows.ids], dtype=np.int64)
        # Words of all windows in one array.
        self.flat = np.concatenate([np.empty(0, np.int64), *windows.ids])
        self.first = np.cumsum(self.length) - self.length

    def _verified(self, ids: np.ndarray, start: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Candidates whose every word is the window's; places before a text or past its end have another number."""
        ok = (start >= 0) & (start + self.length[window] <= len(ids))
        for j in range(int(self.length[window].max(initial=0))):
            left = np.flatnonzero(ok & (j < self.length[window]))
            ok[left] = ids[start[left] + j] == self.flat[self.first[window[left]] + j]
        return ok

    def find(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]]:
        """Per text: number of words, hit spans of words, items."""
        for _, counts, ids in self.reader.batches(texts):
            hits, pairs = np.zeros(len(ids) + 1, dtype=np.int64), []
            begin = np.cumsum(counts + 1) - counts - 1
            for _, at, number in self.reader.places(ids):
                low, high = np.searchsorted(self.shingle, number), np.searchsorted(self.shingle, number, side="right")
                n = high - low
                to = np.cumsum(n)
                # Windows that share a prefix shingle all become candidates, a bounded number at a time.
                cut = [0]
                while cut[-1] < len(n):
                    done = to[cut[-1] - 1] if cut[-1] else 0
                    cut.append(max(cut[-1] + 1, int(np.searchsorted(to, done + _CANDIDATES, side="right"))))
                for a, b in zip(cut, cut[1:]):
                    row = np.repeat(np.arange(a, b), n[a:b])
                    entry = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
                    window = self.window[entry]
                    start = at[row] - self.place[entry]
                    ok = self._verified(ids, start, window)
                    start, window = start[ok], window[ok]
                    np.add.at(hits, start, 1)
                    np.add.at(hits, start + self.length[window], -1)
                    doc = np.searchsorted(begin, start, side="right") - 1
                    pairs.append(np.unique(doc * len(self.length) + window))
            inside = np.cumsum(hits) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
            spans: list[list] = [[] for _ in counts]
            for s, e, d in zip(edge[::2].tolist(), edge[1::2].tolist(), (np.searchsorted(begin, edge[::2], side="right") - 1).tolist()):
                spans[d].append((s - int(begin[d]), e - int(begin[d])))
            items: list[set] = [set() for _ in counts]
            for p in np.unique(np.concatenate([np.empty(0, np.int64), *pairs])).tolist():
                items[p // len(self.length)].update(self.items[p % len(self.length)])
            yield counts, spans, [sorted(x) for x in items]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_items(df: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``keep``, n_words, spans (hit words: start, end), items (their ids as strings, sorted): one row per row of ``df``."""
    if window < 1 or set(keep) & {*OUTPUT, "__text"}:
        raise ValueError(f"window is 1 or more, and keep names none of {OUTPUT}, __text")
    found = stored(windows_of(items, item_id, item_text, window), "windows")
    size = found.agg(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    kinds = dict(df.select(*keep).dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + f"`__text` string, n_words long, spans array<{SPAN}>, items array<string>"
    rows = df.select(*keep, F.col(text).alias("__text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(f"array<{SPAN}>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for part in range(parts):
        own = found if parts == 1 else found.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part)
        rows = _joined(rows, own, df, text, schema, len(keep), last=part + 1 == parts)
        if part + 1 < parts:
            rows = stored(rows, "hits")
    return rows.drop("__text")


def _joined(rows: DataFrame, own: DataFrame, df: DataFrame, text: str, schema: str, n_keep: int, last: bool) -> DataFrame:
    """``rows`` with the hits of one part's windows added."""
    by_words: dict[str, list[str]] = {}
    for item, words in own.collect():  # one part: PART_BYTES of text
        by_words.setdefault(words, []).extend([item] if item is not None else [])
    windows = Windows(list(by_words))
    prefixes = windows.prefixes(occurrences(df, windows, text))
    of_items = list(by_words.values())
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner(windows, prefixes, of_items)
        for batch in batches:
            texts = batch.column(n_keep).cast(pa.large_binary()).to_pylist()
            counts, spans, items = (list(chain.from_iterable(x)) for x in zip(*joiner.find(texts))) if texts else ([], [], [])
            before = zip(batch.column(n_keep + 2).to_pylist(), batch.column(n_keep + 3).to_pylist())
            for i, (old, ids) in enumerate(before):
                if old:
                    spans[i] = _merged([*spans[i], *((s["start"], s["end"]) for s in old)])
                if ids:
                    items[i] = sorted({*items[i], *ids})
            made = [pa.nulls(len(texts), pa.string()) if last else batch.column(n_keep), pa.array(counts, pa.int64())]
            made += [pa.array([[dict(zip(("start", "end"), s)) for s in x] for x in spans], pa.list_(span)), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *made], names=batch.schema.names)

    return rows.mapInArrow(run, schema)
