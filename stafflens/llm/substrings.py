"""Exact removal of long repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Every string of ``length`` bytes that starts at two places of the corpus is
found, and all bytes that such a string covers are removed. One transform of a
large corpus fits no task, so the corpus is first cut into many small ones that
lose no match:

1. *Anchors.* The anchor of a window of ``length`` bytes is the leftmost of its
   k-grams with the smallest hash: it depends on the window's bytes only, so equal
   windows have equal anchors at equal offsets. The windows of a text that share
   an anchor are consecutive; together they are a *segment*. Where a text repeats
   itself with a period, the next anchor has the same hash a period later: the
   windows of such anchors that follow each other are one segment too, so that a
   byte is not copied into a segment for each period around it. One pass over the
   texts lists the anchors' hashes (about one for 185 bytes).
2. *Candidates.* Hashes that occur once cannot anchor a repeated window. Only
   texts with another hash are moved, only their candidate segments are cut out,
   and equal segments become one, with a count. A segment of several anchors may
   hold a window twice, so it is a candidate by itself.
3. *Transform.* The distinct segments of a hash form a group; groups are batched
   to a quarter of a megabyte, and each batch gets its own Burrows-Wheeler transform. Starting
   from the interval of the empty string, all intervals of strings of l bytes are
   extended by one byte to the left, breadth first; the right bounds that are new
   are exactly the places where neighbouring suffixes share l bytes. The expansion
   stops at ``length``: places that are still unset share at least that much.
   Prefixes come by increasing length, so a second, shorter bound costs no second
   run: the bounds as they stand at ``short`` bytes tell the strings of that length.
   Anchors are then those of windows of ``short`` bytes, and a segment carries the
   bytes that its windows need to be read up to ``length``.
4. *Hot groups.* A group with more than ``MOST`` distinct segments is cut again:
   its windows are split by offset, and the part's key is the bytes that all its
   windows have in common, which grow with every cut until a window is its own
   key. Parts of one key that follow each other stay one, and each length is cut for
   itself, so that parts are one whatever follows their windows. So no task holds a passage's every context, and no match is lost.

Texts are identified by their 128-bit digest; a text that several rows hold is
processed once and, if it is long enough, removed whole in each.

Defined results: a null text counts as empty, with the digest of no bytes; rows
are judged by their text whatever their id, null or repeated; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stafflens.llm import shingles as S
from stafflens.llm.common import discard, stored

LENGTH = 400
#: Bytes of a passage of over fifty words of about five bytes; reported, not removed.
SHORT = 250
GRAM = 32
MOST = 256
BATCH_BYTES = 1 << 18
#: No byte of UTF-8.
BREAK = 0xFF
_POSITION = 23  # bits for a place in a piece
_PIECE = 1 << 18


def _gram(length: int) -> int:
    return min(GRAM, max(1, length // 4))


def _gram_keys(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit key for each run of ``k`` bytes."""
    power, inverse = S._tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=total[1:])
    return S.mixed((total[k:] - total[:-k]) * inverse[: len(data) - k + 1])


_BYTES = np.random.Generator(np.random.PCG64(90_210)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _pieces(raw: list[bytes], length: int):
    """(text, offset, bytes) so that each window of a text lies in exactly one piece."""
    for i, r in enumerate(raw):
        for at in range(0, max(1, len(r) - length + 1), _PIECE):
            yield i, at, r[at : at + _PIECE + length - 1]


def anchored(raw: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of all texts: text, hash of the anchor, first and last window start, place of the anchor."""
    out = []
    held, size = [], 0
    for piece in _pieces(raw, length):
        if len(piece[2]) < length:
            continue
        if size + len(piece[2]) > _PIECE and held:
            out.append(_anchored(held, length))
            held, size = [], 0
        held.append(piece)
        size += len(piece[2])
    if held:
        out.append(_anchored(held, length))
    if not out:
        none = np.empty(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchored(pieces: list[tuple[int, int, bytes]], length: int):
    k = _gram(length)
    width = length - k + 1
    data = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
    hashes = _gram_keys(data, k)
    order = (hashes >> np.uint64(_POSITION) << np.uint64(_POSITION)) | np.arange(len(hashes), dtype=np.uint64)
    n = len(data) - length + 1
    # Least of each run of ``width`` keys: of the end of one block and the beginning of the next.
    full = np.full(-(-len(order) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(order)] = order
    block = full.reshape(-1, width)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    sizes = np.array([len(p[2]) for p in pieces])
    begin = np.cumsum(sizes) - sizes
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + sizes - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    own = np.searchsorted(begin, window, side="right") - 1
    anchor = place[window]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]))))
    last = np.append(first[1:], len(window)) - 1
    text = np.array([p[0] for p in pieces])[own[first]]
    shift = np.array([p[1] for p in pieces])[own[first]] - begin[own[first]]
    return text, hashes[anchor[first]], window[first] + shift, window[last] + shift, anchor[first] + shift


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string the starts of its windows of ``length`` bytes that occur again in any of the strings."""
    return _repeated_starts(strings, [len(s) for s in strings], [length])[0]


def _repeated_starts(strings: list[bytes], windows: list[int], lengths: list[int]) -> list[list[np.ndarray]]:
    """For each of the ascending ``lengths``, for each string: the starts of windows of that many bytes that occur again.

    Only the first ``windows`` starts of a string count, as places and as places to be equal to; what follows is context.

    A Burrows-Wheeler transform of the strings (rotations in the order of their
    first ``length`` bytes or more, which fixes every interval that is used),
    then the expansion of intervals up to the last length.
    """
    length = lengths[-1]
    reached = {}
    data = np.frombuffer(bytes([BREAK]) + b"".join(s + bytes([BREAK]) for s in strings), dtype=np.uint8)
    n = len(data)
    order = _rotations(data, length)
    before = data[order - 1]  # the transform; order 0 takes the last byte
    step = np.empty(n, dtype=np.int64)  # from a rotation to the one that starts a byte earlier
    step[np.argsort(before, kind="stable")] = np.arange(n)
    bound = np.zeros(n + 1, dtype=bool)  # neighbours that share less than ``length`` bytes
    bound[0] = bound[n] = True
    # Runs of one byte in the transform: the places of a run move together.
    head = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1], [True])))
    run = np.cumsum(np.concatenate(([0], before[1:] != before[:-1])))
    left, right = np.array([0]), np.array([n])
    for done in range(length):
        if done in lengths:
            reached[done] = bound.copy()
        if not len(left):
            break
        first, last = run[left], run[right - 1]
        plain = first == last  # one byte comes before all places of the interval: one longer interval
        lo = step[left[plain]]
        hi = lo + (right - left)[plain]
        if not plain.all():
            first, count, l, r = first[~plain], (last - first + 1)[~plain], left[~plain], right[~plain]
            owner = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
            begin, end = np.maximum(head[at], l[owner]), np.minimum(head[at + 1], r[owner])
            to, char = step[begin], before[begin]
            # Runs of the same byte in one interval move to neighbouring places.
            by = np.argsort((owner << 32) | to)
            to, end, owner, char = to[by], to[by] + (end - begin)[by], owner[by], char[by]
            cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (char[1:] != char[:-1]))))
            lo = np.concatenate((lo, to[cut]))
            hi = np.concatenate((hi, end[np.append(cut[1:], len(to)) - 1]))
        new = ~bound[hi]
        bound[hi[new]] = True
        left, right = lo[new], hi[new]
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    begin = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    out = []
    for most in lengths:
        # Rotations between two bounds share ``most`` bytes.
        same = np.cumsum(reached.get(most, bound)[:-1]) - 1
        own = np.clip(np.minimum(sizes - most + 1, windows), 0, None)
        counts = np.zeros(n + 1, dtype=np.int64)
        np.add.at(counts, begin, 1)
        np.add.at(counts, begin + own, -1)
        place = (np.cumsum(counts[:n]) > 0)[order]
        again = place & (np.bincount(same, weights=place, minlength=1)[same] > 1)
        starts = np.zeros(n, dtype=bool)
        starts[order[again]] = True
        out.append([np.flatnonzero(starts[at : at + k]) for at, k in zip(begin.tolist(), own.tolist())])
    return out


def _rotations(data: np.ndarray, length: int) -> np.ndarray:
    """Starts of all rotations in the order of their first ``length`` bytes or more, by doubling.

    Two ranks and a start are sorted as one 64-bit number, which takes batches of up to two million bytes.
    """
    n = len(data)
    bits = np.uint64(n.bit_length())
    if 3 * int(bits) > 64:
        raise ValueError("too many bytes for one transform")
    start = np.arange(n, dtype=np.uint64)
    done = (64 - int(bits)) // 8
    key = np.zeros(n, dtype=np.uint64)
    for i in range(done):
        key = key << np.uint64(8) | np.roll(data, -i).astype(np.uint64)
    both = key << bits | start
    both.sort()
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    both >>= bits
    # A rank is the slot of the first rotation of its class, so a class that is split leaves the other ranks as they are.
    slot = np.arange(n)
    fresh = np.concatenate(([True], both[1:] != both[:-1]))
    rank = np.empty(n, dtype=np.uint64)
    rank[order] = np.maximum.accumulate(np.where(fresh, slot, 0)).astype(np.uint64)
    while done < length:
        # Only rotations that are still equal to another one are sorted again, within the slots of their class.
        slot = slot[~(fresh & np.append(fresh[1:], True))]
        if not len(slot):
            break
        own = order[slot]
        ahead = own + done
        ahead[ahead >= n] %= n
        both = ((rank[own] << bits | rank[ahead]) << bits) | own.astype(np.uint64)
        both.sort()
        own = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        both >>= bits
        order[slot] = own
        fresh = np.concatenate(([True], both[1:] != both[:-1]))
        rank[own] = slot[np.maximum.accumulate(np.where(fresh, np.arange(len(slot)), 0))].astype(np.uint64)
        done *= 2
    return order


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows of ``length`` bytes with these sorted starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    first = starts[np.concatenate(([0], gap + 1))]
    last = starts[np.concatenate((gap, [len(starts) - 1]))]
    return [(int(a), int(b) + length) for a, b in zip(first, last)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(texts: DataFrame, length: int) -> DataFrame:
    """doc_id, unit (digest of the text), n_bytes, sha256, hashes (distinct), twice (those with two places)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in part["text"]]
                text, key, _, _, place = anchored(raw, length)
                # Windows of one anchor that lie in two pieces of a text are one place.
                new = np.concatenate(([True], (text[1:] != text[:-1]) | (place[1:] != place[:-1]))) if len(text) else np.empty(0, dtype=bool)
                text, key = text[new], key[new].view(np.int64)
                ends = np.searchsorted(text, np.arange(len(raw) + 1))
                hashes, twice = [], []
                for i in range(len(raw)):
                    own, n = np.unique(key[ends[i] : ends[i + 1]], return_counts=True)
                    hashes.append(own)
                    twice.append(own[n > 1])
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "unit": [hashlib.md5(r).digest() for r in raw], "n_bytes": [len(r) for r in raw],
                    "sha256": [hashlib.sha256(r).hexdigest() for r in raw], "hashes": hashes, "twice": twice,
                })

    return texts.mapInPandas(run, "doc_id long, unit binary, n_bytes long, sha256 string, hashes array<long>, twice array<long>")


_SEGMENT = ["unit", "start", "key", "seg_id", "seg", "anchors", "windows"]
_SEGMENT_TYPES = "unit binary, start long, key binary, seg_id binary, seg binary, anchors array<int>, windows int"


def _joined(text: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray, most: int) -> np.ndarray:
    """Where segments begin when those of one hash that follow each other are one, up to ``most`` starts at a time."""
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (first[1:] != last[:-1] + 1)
    run = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    part = (first - first[run]) // most
    new[1:] |= part[1:] != part[:-1]
    return np.flatnonzero(new)


def _segments(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """Candidate segments: unit, start, key, seg_id, seg, anchors (their places in the segment), windows (that begin in it)."""
    length, reach = lengths[0], lengths[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                raw = [t.encode("utf-8", "surrogatepass") for t in part["text"]]
                text, key, first, last, place = anchored(raw, length)
                key = key.view(np.int64)
                begins = _joined(text, key, first, last, reach)
                ends = np.append(begins[1:], len(text))
                units, wanted = part["unit"].tolist(), [set(h.tolist()) for h in part["hashes"]]
                rows = []
                for i, h, a, b, lo, hi in zip(text[begins].tolist(), key[begins].tolist(), first[begins].tolist(), last[ends - 1].tolist(), begins.tolist(), ends.tolist()):
                    if h in wanted[i]:
                        seg = raw[i][a : b + reach]
                        own = hashlib.md5((b - a).to_bytes(4, "big") + seg).digest()
                        # An anchor whose windows lie in two pieces of a text is there twice.
                        anchors = place[lo : lo + 1] - a if hi - lo == 1 else np.unique(place[lo:hi]) - a
                        rows.append((units[i], a, h.to_bytes(8, "big", signed=True), own, seg, anchors, b - a + 1))
                yield pd.DataFrame(rows, columns=_SEGMENT)

    return texts.mapInPandas(run, _SEGMENT_TYPES)


def _cut(segments: DataFrame, length: int, width: int) -> DataFrame:
    """Segments of hot groups cut by the anchor's offset: unit (the parent's seg_id), and the rest as ``_segments``.

    The windows whose anchor is ``r * width`` to ``r * width + width - 1`` bytes from their start all
    hold the same ``length - width + 1`` bytes around it; r and those bytes are the key.
    The anchors of a segment have one hash, so a window's anchor is the first one that is not before its start.
    Parts of one key that follow each other are one, but for single windows, which are all equal by their key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for parent, seg, anchors, windows in zip(batch["seg_id"], batch["seg"], batch["anchors"], batch["windows"].tolist()):
                begin, parts = 0, []
                windows = min(windows, len(seg) - length + 1)  # those of a longer bound may end before
                for anchor in anchors.tolist():
                    if begin >= windows:
                        break
                    end = min(anchor, windows - 1)
                    for r in range((anchor - begin) // width, (anchor - end) // width - 1, -1):
                        lo, hi = max(begin, anchor - r * width - width + 1), min(end, anchor - r * width)
                        common = seg[anchor - r * width : anchor - r * width - width + 1 + length]
                        key = hashlib.md5(width.to_bytes(4, "big") + r.to_bytes(4, "big", signed=True) + common).digest()
                        if width > 1 and parts and parts[-1][2] == key:
                            parts[-1][1] = hi
                            parts[-1][3].append(anchor)
                        else:
                            parts.append([lo, hi, key, [anchor]])
                    begin = end + 1
                for lo, hi, key, own in parts:
                    part = seg[lo : hi + length]
                    rows.append((parent, lo, key, hashlib.md5(key + (hi - lo).to_bytes(4, "big") + part).digest(), part, [p - lo for p in own], hi - lo + 1))
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=_SEGMENT)
                    rows = []
            yield pd.DataFrame(rows, columns=_SEGMENT)

    return segments.select("seg_id", "seg", "anchors", "windows").mapInPandas(run, _SEGMENT_TYPES)


def _expanded(groups: DataFrame, lengths: list[int]) -> DataFrame:
    """Repeated runs (seg_id, bound, lo, hi) among the segments of each key, batch after batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, strings, windows, size, key = [], [], [], 0, None

        def spans() -> pd.DataFrame:
            found = _repeated_starts(strings, windows, lengths)
            out = []
            for n, starts in zip(lengths, found):
                # As ``covered``, for all segments at once.
                start, own = np.concatenate(starts), np.repeat(np.arange(len(ids)), [len(x) for x in starts])
                new = np.ones(len(start) + 1, dtype=bool)
                new[1:-1] = (own[1:] != own[:-1]) | (np.diff(start) > n)
                first, last = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
                out.append(pd.DataFrame({"seg_id": [ids[i] for i in own[first].tolist()], "bound": np.full(len(first), n, dtype=np.int32), "lo": start[first], "hi": start[last] + n}))
            return pd.concat(out, ignore_index=True)

        for batch in batches:
            for k, i, seg, n in zip(batch["key"], batch["seg_id"], batch["seg"], batch["windows"].tolist()):
                if k != key and size > BATCH_BYTES:
                    yield spans()
                    ids, strings, windows, size = [], [], [], 0
                key = k
                ids.append(i)
                strings.append(seg)
                windows.append(n)
                size += len(seg)
        if strings:
            yield spans()

    dealt = groups.select("key", "seg_id", "seg", "windows").repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(run, "seg_id binary, bound int, lo long, hi long")


def _repeats(segments: DataFrame, lengths: list[int], widths: list[int]) -> DataFrame:
    """Repeated runs (unit, bound, lo, hi) of the places of ``segments``, a stored table that is deleted."""
    firsts = [F.first(c).alias(c) for c in ("key", "seg", "anchors", "windows")]
    distinct = stored(segments.groupBy("seg_id").agg(*firsts, F.count("*").alias("n")), "segments")
    places = stored(segments.select("unit", "start", "seg_id"), "places")
    discard(segments)
    groups = distinct.groupBy("key").agg(F.count("*").alias("members"), F.max(F.size("anchors")).alias("most"))
    groups = stored(groups.where("members > 1 or most > 1").drop("most"), "groups")
    most = max(2, min(MOST, (1 << 20) // (3 * lengths[-1])))  # a segment has less than three times the length

    def whole(rows: DataFrame, length: int) -> DataFrame:
        end = F.least(F.length("seg"), F.col("windows") - 1 + length).cast("long")
        return rows.where(F.length("seg") >= length).select("seg_id", F.lit(length).alias("bound"), F.lit(0).cast("long").alias("lo"), end.alias("hi"))

    rest = distinct.join(groups, "key")
    found = _expanded(rest.where(F.col("members") <= most), lengths)
    for length in lengths:  # an equal segment at another place repeats whole
        found = found.union(whole(distinct.where("n > 1"), length))
    large = rest.where(F.col("members") > most)
    below = []
    if groups.where(F.col("members") > most).limit(1).count():
        for length in lengths if widths else []:
            parts = stored(_cut(large, length, widths[0]), "parts")
            deeper = _repeats(parts, [length], widths[1:]).withColumnRenamed("unit", "seg_id")
            below.append(deeper)
            found = found.union(deeper.select("seg_id", "bound", "lo", "hi"))
        if not widths:
            # The parts of a key are one window of the first length each, all equal; those that go on alike are equal parts.
            found = found.union(whole(large, lengths[0]))
    found = stored(found, "runs")
    discard(distinct, groups, *below)
    return places.join(found, "seg_id").select("unit", "bound", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))


def _kept(texts: DataFrame, length: int) -> DataFrame:
    """unit, n_removed, n_spans, sha256 of what remains, n_short (bytes under spans of the first bound), from text and spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for unit, text, spans in zip(batch["unit"], batch["text"], batch["spans"]):
                raw = text.encode("utf-8", "surrogatepass")
                runs = merged([(s["lo"], s["hi"]) for s in spans if s["bound"] == length])
                short = merged([(s["lo"], s["hi"]) for s in spans])
                digest, at = hashlib.sha256(), 0
                for a, b in runs:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                rows.append((unit, sum(b - a for a, b in runs), len(runs), digest.hexdigest(), [a for a, _ in runs], [b for _, b in runs], sum(b - a for a, b in short)))
            yield pd.DataFrame(rows, columns=["unit", "n_removed", "n_spans", "sha256", "los", "his", "n_short"])

    return texts.mapInPandas(run, "unit binary, n_removed long, n_spans long, sha256 string, los array<long>, his array<long>, n_short long")


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, short: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of lo, hi in bytes): one row per row of ``df``.

    With ``short`` (at most ``length``) also n_repeated_short: bytes covered by strings of that many bytes that occur again.
    """
    lengths = sorted({short or length, length})
    texts = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scan = stored(_scan(texts, lengths[0]), "scan")
    units = stored(scan.groupBy("unit").agg(F.count("*").alias("rows"), F.min("doc_id").alias("rep")), "units")
    one = scan.select("unit", "doc_id", "hashes", "twice").join(units, "unit").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    one = stored(one.select("unit", "rep", F.xxhash64("unit").alias("u"), "hashes", "twice"), "anchors")
    places = one.select("u", F.explode("hashes").alias("h"), F.lit(False).alias("twice")).union(one.select("u", F.explode("twice"), F.lit(True)))
    hot = places.groupBy("h").agg(F.min("u").alias("a"), F.max("u").alias("b"), F.max("twice").alias("twice")).where("a != b or twice").select("h")
    hot = stored(hot, "hot")
    wanted = one.select("unit", "rep", F.explode("hashes").alias("h")).join(hot, "h")
    wanted = stored(wanted.groupBy("unit", "rep").agg(F.collect_set("h").alias("hashes")), "wanted")
    # What later steps read of the scan, without its hashes.
    known = stored(scan.select("doc_id", "unit", "n_bytes", "sha256"), "known")
    discard(scan, one, hot)

    mine = F.unhex(F.md5(F.col("text").cast("binary")))
    moved = texts.where("text is not null").withColumn("unit", mine).join(wanted.withColumnRenamed("unit", "w").hint("merge"), (F.col("unit") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    moved = stored(moved.select("unit", "text", "hashes"), "moved")
    discard(wanted)
    segments = stored(_segments(moved, lengths), "cut")
    # Offsets of an anchor in a window run to length - gram; the first cut leaves a quarter, each further one a sixth, at last single windows.
    widths, w = [], lengths[0] - _gram(lengths[0]) + 1
    while w > 1:
        w = max(1, w // (6 if widths else 4))
        widths.append(w)
    found = _repeats(segments, lengths, widths)
    spans = stored(found.groupBy("unit").agg(F.collect_set(F.struct("bound", "lo", "hi")).alias("spans")), "spans")
    discard(found)
    kept = _kept(moved.select("unit", "text").join(spans, "unit"), length)
    kept = stored(kept.dropDuplicates(["unit"]), "kept")  # rows that repeat id and text
    discard(moved, spans)

    whole = (F.col("rows") > 1) & (F.col("n_bytes") >= length)
    results = stored(units.select("unit", "rows").join(kept, "unit", "left"), "results")
    discard(units, kept)
    out = known.select("doc_id", "unit", "n_bytes", F.col("sha256").alias("own")).join(results, "unit")
    empty = hashlib.sha256(b"").hexdigest()
    parts = F.coalesce(F.arrays_zip(F.col("los").alias("lo"), F.col("his").alias("hi")), F.array().cast("array<struct<lo:long,hi:long>>"))
    in_short = (F.col("rows") > 1) & (F.col("n_bytes") >= lengths[0])
    repeated = F.when(in_short, F.col("n_bytes")).otherwise(F.coalesce("n_short", F.lit(0).cast("long")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("sha256", "own")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))).otherwise(parts).alias("spans"),
        *([repeated.alias("n_repeated_short")] if short else []),
    )
