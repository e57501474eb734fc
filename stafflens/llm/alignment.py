"""Token alignment of two tokenizers over the same texts, by an as-of merge per batch.

Both tokenizers tile a text's bytes. A batch holds the tokens of many texts,
each side a table (document, start, place); ``pandas.merge_asof``, keyed by
document, finds for each token's start the other side's token that covers it.
Two tokens overlap if and only if the later of their starts lies within the
other one, so the two directions together give every overlap; those with equal
starts come twice and count once. Equal ends cut both sides into groups.

Texts are encoded word by word: a single space between two characters that are
no white space always begins a token of either side (the byte-level pattern
splits there, and no piece of the other vocabulary has a space after another
character, which is checked), so the tokens of a text are those of its parts,
and a part that comes again is not encoded again. Very long texts go through
the merge in several pieces that end at such a space.

A text has tokens only if the bytes of either side joined give a space and the
text. Corpus-wide counts of linked id pairs are made from each text's distinct
pairs, which are stored once: partial sums per pair, then a join of the pairs
back to them, by broadcast up to ``BROADCAST_PAIRS`` counted pairs and by
shuffle beyond.

Defined results: a null or empty text, or one whose bytes differ, has zeros and
an empty ``groups``; a repeated row counts again like any other; a null id is
carried; an empty table gives an empty result. ``keep`` must not name an output
column; other columns of the table may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stafflens.llm.common import stored

OUTPUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
#: Pairs of ids (three numbers each) that are broadcast after a count; more are joined by shuffle.
BROADCAST_PAIRS = 2_000_000
#: Characters that are merged at once, and parts whose tokens a worker remembers.
_PIECE = 1 << 18
_KNOWN = 300_000
_MARK = "▁"
#: How byte-level vocabularies split a text before the merges, and the first character beyond Latin letters.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATIN = "\u0250"
_SHORT = 100
_OTHER_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_CUT = re.compile(r"(?<=\S) (?=\S)")


def parts_of(text: str) -> list[str]:
    """The text cut at every single space between characters that are no white space, without those spaces."""
    plain = not (text[:1] in " \n" or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or any(c in text for c in _OTHER_BLANKS))
    return text.split(" ") if plain else _CUT.split(text)


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), then those of start[1], and so on."""
    to = np.cumsum(n)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(start - to + n, n)


class Side:
    """One tokenizer: ids of parts, and each id's bytes."""

    def __init__(self, encode, token_bytes: list[bytes | None]):
        self.encode, self.bytes = encode, token_bytes
        self.width = np.array([len(b or b"") for b in token_bytes], dtype=np.int64)

    def joined(self, ids: list[int]) -> bytes | None:
        found = [self.bytes[i] for i in ids]
        return None if None in found else b"".join(found)

    def spells(self, ids: np.ndarray, n: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether the tokens of each part, ``n`` of them in order, join to its bytes."""
        flat = self.joined(ids.tolist())
        ends = np.cumsum(np.concatenate(([0], self.width[ids])))[np.cumsum(n)]
        if flat == b"".join(raw) and np.array_equal(ends, np.cumsum([len(r) for r in raw])):
            return np.ones(len(raw), dtype=bool)
        to = np.cumsum(n)
        return np.array([self.joined(ids[t - k : t].tolist()) == r for t, k, r in zip(to, n, raw)], dtype=bool)


def byte_side(tokenizer_json: str) -> Side:
    """A byte-level BPE of the ``tokenizers`` library; the text's first part gets its space here.

    Where the vocabulary's order is that of the merges, short parts of Latin letters,
    whose classes no Unicode version changes, go through the same merges in
    ``tiktoken``, which is several times faster on short texts.
    """
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json)
    t.encode_special_tokens = True
    byte = _byte_of_char()
    made = json.loads(tokenizer_json)
    special = {x["id"] for x in made.get("added_tokens", ())}
    token_bytes: list[bytes | None] = [None] * t.get_vocab_size()
    for token, i in t.get_vocab().items():
        token_bytes[i] = bytes(byte[c] for c in token) if i not in special else None

    def slow(parts: list[str]) -> list[list[int]]:
        return [e.ids for e in t.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]

    vocab = made["model"]["vocab"]
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in made["model"]["merges"]]
    if merged != sorted(merged) or made["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or made["normalizer"]:
        return Side(slow, token_bytes)
    ranks = {b: i for i, b in enumerate(token_bytes) if b is not None}
    one = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(parts: list[str]) -> list[list[int]]:
        out = [one(" " + p) if len(p) <= _SHORT and (p.isascii() or max(p) < _LATIN) else None for p in parts]
        left = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(left, slow([parts[i] for i in left]) if left else ()):
            out[i] = ids
        return out

    return Side(encode, token_bytes)


def piece_side(model: bytes) -> Side:
    """A sentencepiece model that puts a space before a text."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    token_bytes: list[bytes | None] = []
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if _MARK in piece.lstrip(_MARK):
            raise ValueError(f"piece {i} holds a space after another character: texts can't be encoded by parts")
        if sp.is_byte(i):
            token_bytes.append(bytes([int(piece[3:5], 16)]))
        else:
            token_bytes.append(None if sp.is_control(i) or sp.is_unknown(i) else piece.replace(_MARK, " ").encode())
    return Side(lambda parts: sp.encode(parts, num_threads=1), token_bytes)


class _Memory:
    """Tokens of the parts seen so far, both sides, in flat arrays."""

    def __init__(self, a: Side, b: Side):
        self.sides = (a, b)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.good = np.empty(0, dtype=bool)
        self.ids = [np.empty(0, dtype=np.int32) for _ in self.sides]
        self.n = [np.empty(0, dtype=np.int64) for _ in self.sides]

    def look_up(self, parts: list[str]) -> np.ndarray:
        """The number of each part; parts not seen before are encoded."""
        if len(self.number) > _KNOWN:
            self.clear()
        before = len(self.number)
        number = np.fromiter(map(self.number.__getitem__, parts), dtype=np.int64, count=len(parts))
        new = list(islice(self.number, before, None))
        if new:
            raw = [b" " + p.encode() for p in new]
            good = np.ones(len(new), dtype=bool)
            for k, side in enumerate(self.sides):
                found = side.encode(new)
                n = np.fromiter(map(len, found), dtype=np.int64, count=len(new))
                ids = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(n.sum()))
                good &= side.spells(ids, n, raw)
                self.n[k], self.ids[k] = np.append(self.n[k], n), np.append(self.ids[k], ids)
            self.good = np.append(self.good, good)
        return number

    def tokens(self, k: int, number: np.ndarray, doc: np.ndarray) -> pd.DataFrame:
        """(doc, id, start, end) of side ``k`` for parts of documents in order; starts count within the document."""
        n = self.n[k]
        first = np.cumsum(n) - n
        ids = self.ids[k][_ranges(first[number], n[number])]
        width = self.sides[k].width[ids]
        end = np.cumsum(width)
        doc = np.repeat(doc, n[number])
        new = np.flatnonzero(np.diff(doc, prepend=-1))
        base = np.repeat((end - width)[new], np.diff(np.append(new, len(doc))))
        return pd.DataFrame({"doc": doc, "id": ids, "start": end - width - base, "end": end - base, "base": base})


def links(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` whose byte ranges overlap, each pair once; both tile their documents."""
    found = []
    sides = [pd.DataFrame({"doc": t["doc"], "at": t["start"] + t["base"], "place": np.arange(len(t))}) for t in (a, b)]
    for left, right in (sides, sides[::-1]):
        # Starts count over the batch for the order; ``doc`` keys the merge.
        found.append(pd.merge_asof(left[["doc", "at"]], right, on="at", by="doc")["place"].to_numpy())
    jb, ia = found
    twice = sides[0]["at"].to_numpy()[ia] == sides[1]["at"].to_numpy()
    return np.concatenate((np.arange(len(a)), ia[~twice])), np.concatenate((jb, np.flatnonzero(~twice)))


def _texts_of_groups(a: pd.DataFrame, b: pd.DataFrame, n_docs: int, names: list[np.ndarray]) -> tuple[np.ndarray, list[str]]:
    """Per document of the batch: number of groups, and its groups as text."""
    end_a, end_b = (t["end"].to_numpy() + t["base"].to_numpy() for t in (a, b))
    cut_a, cut_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    size_a, size_b = np.bincount(group_a), np.bincount(group_b)
    place_a = np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(size_a)[group_b]
    doc_a, doc_b = a["doc"].to_numpy(), b["doc"].to_numpy()
    last_b = np.append(doc_b[1:] != doc_b[:-1], True)
    text = np.empty(len(a) + len(b), dtype=object)
    # names: ids as text with what follows: comma within a side, bar after side A, semicolon after a group, nothing at the end.
    text[place_a] = names[0][a["id"].to_numpy() * 4 + cut_a]
    text[place_b] = names[1][b["id"].to_numpy() * 4 + np.where(last_b, 3, 2 * cut_b)]
    n = np.bincount(doc_a, minlength=n_docs) + np.bincount(doc_b, minlength=n_docs)
    to = np.cumsum(n)
    return np.bincount(doc_a[cut_a], minlength=n_docs), ["".join(text[t - k : t]) for t, k in zip(to.tolist(), n.tolist())]


class Aligner:
    """Aligns texts and remembers the tokens of up to ``_KNOWN`` parts and those of one batch."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, b = byte_side(a_json), piece_side(b_model)
        self.memory = _Memory(a, b)
        self.names = [np.array([f"{i}{c}" for i in range(len(s.bytes)) for c in (",", "|", ";", "")], dtype=object) for s in (a, b)]

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """For each text: counts, distinct linked id pairs with their counts, and groups as pieces of text."""
        out = {"n_a": [0] * len(texts), "n_b": [0] * len(texts), "n_groups": [0] * len(texts), "n_links": [0] * len(texts), "groups": [[] for _ in texts], "pairs": [[] for _ in texts]}
        bad: set[int] = set()
        held, size = [], 0
        for i, text in enumerate(texts):
            if not text or _MARK in text:
                continue
            parts = parts_of(text)
            # A long text comes in pieces of whole parts.
            step = max(1, len(parts) * _PIECE // len(text))
            for at in range(0, len(parts), step):
                held.append((i, parts[at : at + step]))
                size += len(text) * min(step, len(parts) - at) // len(parts)
                if size >= _PIECE:
                    self._merge(held, out, bad)
                    held, size = [], 0
        if held:
            self._merge(held, out, bad)
        for i in bad:
            out["groups"][i], out["pairs"][i] = [], []
            for name in ("n_a", "n_b", "n_groups", "n_links"):
                out[name][i] = 0
        for i, found in enumerate(out["pairs"]):
            if len(found) > 1:
                keys, counts = (np.concatenate(x) for x in zip(*found))
                keys, where = np.unique(keys, return_inverse=True)
                out["pairs"][i] = [(keys, np.bincount(where, weights=counts).astype(np.int64))]
        return out

    def _merge(self, held: list[tuple[int, list[str]]], out: dict[str, list], bad: set[int]) -> None:
        """Adds the pieces' results; ``bad`` gets the texts of which a part's bytes differ on either side."""
        number = self.memory.look_up([p for _, parts in held for p in parts])
        doc = np.repeat(np.arange(len(held)), [len(parts) for _, parts in held])
        wrong = np.bincount(doc, weights=~self.memory.good[number]) > 0
        bad.update(held[k][0] for k in np.flatnonzero(wrong))
        number, doc = number[~wrong[doc]], doc[~wrong[doc]]
        if not len(doc):
            return
        a, b = (self.memory.tokens(k, number, doc) for k in (0, 1))
        ia, jb = links(a, b)
        n_groups, texts = _texts_of_groups(a, b, len(held), self.names)
        of = a["doc"].to_numpy()[ia]
        n_links = np.bincount(of, minlength=len(held))
        # One number for piece and id pair: sorted, equal links of a piece are neighbours.
        ids_a, ids_b = (len(side.bytes) for side in self.memory.sides)
        key = np.sort((of * ids_a + a["id"].to_numpy()[ia]) * ids_b + b["id"].to_numpy()[jb])
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        counts = np.diff(np.append(first, len(key)))
        pair, id_b = np.divmod(key[first], ids_b)
        of, id_a = np.divmod(pair, ids_a)
        key, to = id_a << 32 | id_b, np.cumsum(np.bincount(of, minlength=len(held)))
        n_a, n_b = (np.bincount(t["doc"], minlength=len(held)) for t in (a, b))
        at = 0
        for k, (i, _) in enumerate(held):
            for name, n in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links)):
                out[name][i] += int(n[k])
            out["groups"][i].append(texts[k])
            out["pairs"][i].append((key[at : to[k]], counts[at : to[k]]))
            at = to[k]


_aligners: dict[str, Aligner] = {}


def _aligner(a_json: str, b_model: bytes) -> Aligner:
    """One object a worker process: the tasks it runs one after another share the parts they know."""
    key = hashlib.sha256(a_json.encode() + b_model).hexdigest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(a_json, b_model)
    return _aligners[key]


def aligned(df: DataFrame, a_json: str, b_model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_groups: bool = False) -> DataFrame:
    """``keep``, n_a, n_b, n_groups, n_links, groups_sha256, groups, pairs (a, b, n): one row per row of ``df``.

    ``groups`` is null unless ``with_groups``: `a1,a2|b1;a3|b2,b3`, ids of both sides group by group.
    """
    rows = df.select(*keep, F.col(text).alias("__text"))
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_json, b_model)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = aligner.align(batch.column(len(keep)).to_pylist())
                pairs = [p[0] if p else (np.empty(0, np.int64), np.empty(0, np.int64)) for p in found["pairs"]]
                keys, counts = (np.concatenate(x) for x in zip(*pairs))
                values = pa.StructArray.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(counts.astype(np.int64))], fields=list(pair))
                offsets = np.cumsum([0, *(len(k) for k, _ in pairs)]).astype(np.int32)
                texts = [";".join(g) for g in found["groups"]]
                made = [pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                made.append(pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], pa.string()))
                made.append(pa.array(texts if with_groups else [None] * len(texts), pa.string()))
                made.append(pa.ListArray.from_arrays(pa.array(offsets), values))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return rows.mapInArrow(run, f"{schema + ', ' if keep else ''}n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<struct<a:int,b:int,n:long>>")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best): corpus-wide links of each id pair of rows (a, b, n); best: the highest of its ``b``, ties included."""
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_groups: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` with n_best (links whose count is their B id's highest) and count_sum (over links) in place of the pairs."""
    if set(keep) & {*OUTPUT, "pairs", "__row"}:
        raise ValueError(f"keep names none of {OUTPUT}, pairs, __row")
    with open(a_path, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    numbered = df.select(*keep, F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    rows = stored(aligned(numbered, a_json, b_model, "__text", (*keep, "__row"), with_groups), "aligned")
    pairs = rows.select("__row", F.explode("pairs").alias("p")).select("__row", "p.a", "p.b", "p.n")
    known = stored(pair_counts(pairs), "pair-counts")
    if known.count() <= broadcast_pairs:
        known = F.broadcast(known)
    sums = pairs.join(known, ["a", "b"]).groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    sums = sums.withColumnRenamed("__row", "__of")
    zero = F.lit(0).cast("long")
    out = rows.drop("pairs").join(sums, F.col("__row") == F.col("__of"), "left")
    return out.select(*keep, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", "groups")
