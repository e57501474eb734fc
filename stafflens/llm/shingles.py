"""Word shingles of whole texts as 64-bit keys, and their minima, in numpy.

A word is a maximal run of bytes other than space and U+0009 to U+000D, with
A-Z in lower case. A text's set holds a key for each distinct run of five
words; a text of one to four words has one key for all of them; a text without
words has none. A word's key is its xxhash64 with a fixed seed, and a shingle's
mixes those of its words: two different shingles share one with a probability of
2^-64. (A polynomial modulo 2^64 would not do: words of a doubling pattern collide
under every base.)
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

SHINGLE = 5
_SEED = 20240501
_SEPARATOR = re.compile(rb"[\x20\x09-\x0d]")
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PRIMES = tuple(np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_CHUNK = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20240501))
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_LENGTH = _rng.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK * 2)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_keys(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of the texts in order, and the number of words of each text."""
    keys, counts = [np.empty(0, dtype=np.uint64)], []
    for lo, hi in _groups(raw):
        own, starts = _text_keys(b" ".join(raw[lo:hi]).lower())  # bytes.lower() changes A-Z only
        ends = np.cumsum([len(r) + 1 for r in raw[lo:hi]])
        at = np.searchsorted(starts, ends)
        keys.append(own)
        counts.append(np.diff(at, prepend=0))
    return np.concatenate(keys), np.concatenate([np.empty(0, dtype=np.int64), *counts])


def _text_keys(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of a text in lower case, and where each begins; a long text is read piece by piece."""
    found, at = [(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))], 0
    while at < len(text):
        cut = _SEPARATOR.search(text, at + _CHUNK)
        to = cut.end() if cut else len(text)
        keys, starts = _hashed(text[at:to])
        found.append((keys, starts + at))
        at = to
    return np.concatenate([k for k, _ in found]), np.concatenate([s for _, s in found])


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """xxhash64 of each word and where it begins; words of equal length below 32 bytes are hashed at once."""
    p1, p2, p3, p4, p5 = _PRIMES
    padded = text + b" " * 8
    data = np.frombuffer(padded, dtype=np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edges = edges if blank[0] else np.concatenate(([0], edges))
    starts, ends = edges[::2], edges[1::2]
    eight, four = (np.ndarray((len(data) - k + 1,), dtype=f"<u{k}", buffer=padded, strides=(1,)) for k in (8, 4))
    size = np.minimum(ends - starts, 32).astype(np.uint8)
    order = np.argsort(size, kind="stable")
    cuts = np.searchsorted(size[order], np.arange(33))
    out = np.empty(len(starts), dtype=np.uint64)
    for n in range(1, 32):
        own = order[cuts[n] : cuts[n + 1]]
        if not len(own):
            continue
        at = starts[own]
        h = np.full(len(own), (_SEED + int(p5) + n) % (1 << 64), dtype=np.uint64)
        for _ in range(n // 8):
            h = _rotated(h ^ (_rotated(eight[at] * p2, 31) * p1), 27) * p1 + p4
            at = at + 8
        if n % 8 >= 4:
            h = _rotated(h ^ (four[at].astype(np.uint64) * p1), 23) * p2 + p3
            at = at + 4
        for k in range(n % 4):
            h = _rotated(h ^ (data[at + k].astype(np.uint64) * p5), 11) * p1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        out[own] = h ^ (h >> np.uint64(32))
    for i in order[cuts[32] :].tolist():
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]], _SEED)
    return out, starts


def _groups(texts: list[bytes]):
    """Slices of the list of about _CHUNK bytes each; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle keys of each text."""
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    out: list[np.ndarray] = []
    for lo, hi in _groups(raw):
        keys, counts = _word_keys(raw[lo:hi])
        ends = np.cumsum(counts)
        if len(keys) >= SHINGLE:
            full = keys[: len(keys) - SHINGLE + 1] * _PLACE[0]
            for k in range(1, SHINGLE):
                full = full + keys[k : len(keys) - SHINGLE + 1 + k] * _PLACE[k]
            full = mixed(full + _LENGTH[SHINGLE])
        for end, n in zip(ends, counts):
            s = end - n
            if n >= SHINGLE:
                own = np.sort(full[s : end - SHINGLE + 1])
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif n:
                out.append(mixed((keys[s:end] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _LENGTH[n]))
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``n`` universal hash functions x -> a x + b modulo 2^64."""
    rng = np.random.Generator(np.random.PCG64(7_700_417))
    return rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The ``n`` hash minima of each set (upper halves), one row per set; empty sets give all ones."""
    a, b = coefficients(n)
    out = np.full((len(sets), n), 0xFFFFFFFF, dtype=np.uint32)
    rows = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(rows):
        size, to = 0, at
        while to < len(rows) and (to == at or size + len(sets[rows[to]]) <= 1 << 15):
            size += len(sets[rows[to]])
            to += 1
        x = np.concatenate([sets[i] for i in rows[at:to]])
        offsets = np.cumsum([0, *(len(sets[i]) for i in rows[at : to - 1])])
        v = np.empty_like(x)
        for k in range(n):
            np.multiply(x, a[k], out=v)
            np.add(v, b[k], out=v)
            out[rows[at:to], k] = np.minimum.reduceat(v, offsets) >> np.uint64(32)
        at = to
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A signed 64-bit key for each band of ``rows`` consecutive minima."""
    n, width = signature.shape
    bands = signature.reshape(n, width // rows, rows).astype(np.uint64)
    key = np.zeros((n, width // rows), dtype=np.uint64) + np.arange(1, width // rows + 1, dtype=np.uint64)
    for k in range(rows):
        key = mixed(key * np.uint64(_BASE) + bands[:, :, k])
    return key.view(np.int64)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set (two signed words)."""
    one = int(mixed(s).sum(dtype=np.uint64))
    two = int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return one - (1 << 64) * (one >> 63), two - (1 << 64) * (two >> 63)
