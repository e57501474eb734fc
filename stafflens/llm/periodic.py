"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) that is at least ``LENGTH`` words and ``EXPONENT`` periods long
and that neither neighbour extends. Each word of a run stands in it
``EXPONENT`` times or more. So a segment is split at every word that occurs
less often within it; its parts are counted anew until no segment changes, and
parts that are shorter than a run go. Prose falls apart in two or three rounds.

A surviving segment is scanned at every lag q it has room for, at the places
0, q, 2q, ... only: a run holds ``EXPONENT`` - 1 neighbouring ones at which the
word q further is the same. Equal window hashes keep the places worth a look,
and the words themselves then give the run's ends. The places of a run already
found with a period that divides q lead to the same run and are passed over.
So a segment of m words costs m log m steps, however long its runs are.

Work is one pass over the rows without a shuffle; a task holds one batch of
texts, and of a very long text its words.

Defined results: a null text has no words, no run and an empty ``collapsed``;
so has a text without words. Ties of the best run go to the smallest start,
then period. Repeated rows are judged alike, ids play no part, an empty table
gives an empty result. ``keep`` must not name an output column; other columns
of the table may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 6
EXPONENT = 4
#: A run: first word, number of words, smallest period.
RUN = "struct<start:long,length:long,period:long>"
OUTPUT = ("n_words", "runs", "best", "collapsed")
#: Multiplier of the window hashes; equal windows have equal hashes, and words confirm.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 64


def coded(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict = defaultdict(count().__next__)
    return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def segments(code: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Stretches (start, end) of ``length`` words or more in which each word occurs ``exponent`` times or more."""
    if len(code) < length:
        return []
    done: list[tuple[int, int]] = []
    at = np.arange(len(code))
    often = np.bincount(code)[code] >= exponent
    own = np.zeros(len(code), dtype=np.int64)
    width = int(code.max()) + 1
    while len(at):
        # Parts without a rare word are stable; the others fall apart at their rare words.
        broken = np.zeros(int(own[-1]) + 1, dtype=bool)
        broken[own[~often]] = True
        stable = ~broken[own]
        if stable.any():
            held, part = at[stable], own[stable]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            done += [(int(held[i]), int(held[j - 1]) + 1) for i, j in zip(first, [*first[1:], len(held)])]
        left = often & ~stable
        at, own = at[left], own[left]
        if not len(at):
            break
        edge = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])))
        part = np.cumsum(edge) - 1
        room = np.bincount(part)[part] >= length
        at, part = at[room], part[room]
        if not len(at):
            break
        own = np.cumsum(np.concatenate(([True], part[1:] != part[:-1]))) - 1
        _, where, n = np.unique(own * width + code[at], return_inverse=True, return_counts=True)
        often = n[where] >= exponent
    return sorted(done)


def _window_hashes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power = np.full(len(code) + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    x = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    np.cumsum((x ^ (x >> np.uint64(29))) * power[:-1], out=total[1:])
    return total, power


def _agree(code: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The stretch (from, to) of places around ``i`` whose word equals the word ``q`` further."""
    to, size = i + 1, _BLOCK
    while to < len(code) - q:
        off = np.flatnonzero(code[to : to + size][: len(code) - q - to] != code[to + q : to + q + size])
        if len(off):
            to += int(off[0])
            break
        to = min(to + size, len(code) - q)
        size *= 2
    start, size = i, _BLOCK
    while start > 0:
        low = max(0, start - size)
        off = np.flatnonzero(code[low:start] != code[low + q : start + q])
        if len(off):
            start = low + int(off[-1]) + 1
            break
        start = low
        size *= 2
    return start, to


def lag_scan(code: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of the words ``code``."""
    found: list[tuple[int, int, int]] = []
    ends: set[tuple[int, int]] = set()
    wide: list[tuple[int, int, int]] = []  # runs that may hold the places of a larger lag
    hashes = None
    for q in range(1, len(code) // exponent + 1):
        stride = code[::q]
        same = stride[1:] == stride[:-1]
        tail = len(same) - exponent + 2
        if tail < 1:
            break
        hit = same[:tail].copy()
        for k in range(1, exponent - 1):
            hit &= same[k : tail + k]
        at = np.flatnonzero(hit) * q
        if not len(at):
            continue
        wide = [r for r in wide if r[1] - r[0] > q]
        for s, e, p in wide:
            if q % p == 0:
                at = at[(at < s) | (at + q >= e)]
        if not len(at):
            continue
        hashes = hashes or _window_hashes(code)
        total, power = hashes
        span = (exponent - 2) * q + 1
        at = at[(total[at + span] - total[at]) * power[q] == total[at + q + span] - total[at + q]]
        past = -1
        for i in at.tolist():
            if i < past or code[i] != code[i + q]:
                continue
            start, past = _agree(code, i, q)
            end = past + q
            if end - start >= max(length, exponent * q) and (start, end) not in ends:
                ends.add((start, end))
                wide.append((start, end, q))
                found.append((start, end - start, q))
    return found


def runs_of(code: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) by start, then period."""
    found = []
    for start, end in segments(code, length, exponent):
        found += [(start + s, n, q) for s, n, q in lag_scan(code[start:end], length, exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        step = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, q in runs:
            step[s + q] += 1
            step[s + n] -= 1
        words = [w for w, dropped in zip(words, np.cumsum(step[:-1]).tolist()) if not dropped]
    return b" ".join(words)


def periodic_runs(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """``keep``, n_words, runs, best (null without a run) and collapsed: one row per row of ``df``.

    ``collapsed`` is the text's words joined by one space, without the words
    that a run repeats: those after its first period.
    """
    if exponent < 2 or length < 2 or set(keep) & set(OUTPUT):
        raise ValueError(f"exponent and length are 2 or more, and keep names none of {OUTPUT}")
    rows = df.select(*keep, F.col(text).alias("__text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, best, collapsed = [], [], [], []
            for raw in batch.column(len(keep)).cast(pa.large_binary()):
                words = (raw.as_py() or b"").split()  # bytes: at space and U+0009 to U+000D
                found = runs_of(coded(words), length, exponent)
                n_words.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                best.append(dict(zip(("start", "length", "period"), _best(found))) if found else None)
                collapsed.append(_collapsed(words, found))
            made = [pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(best, run_type), pa.array(collapsed, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *OUTPUT])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return rows.mapInArrow(run, f"{schema + ', ' if keep else ''}n_words long, runs array<{RUN}>, best {RUN}, collapsed string")
