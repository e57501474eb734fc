"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost. Documents longer than
the largest length are cut into pieces that fill it; all pieces are then placed
in decreasing length: into the open bin of any size that leaves the least room,
else into a new bin of the size whose cost per expected token is least. When a
group is done each bin shrinks to the cheapest permitted length that still
holds its contents. Against that stands a second packing of the group: bin by
bin, the longest piece left opens the size that costs least per token of what
it really takes from the pieces left (the longest that fits, again and again),
after shrinking. The cheaper of the two is the result.

Only lengths travel. Rows are dealt evenly over groups of about ``group_rows``
(round robin, so no key can be hot); a group is packed on its own in one task,
which bounds the memory of a task and costs at most a few part-filled bins per
group.

Defined results: a null or empty text has length 0 and gets no bin (bin_id and
capacity null, one row); repeated rows are packed each; an empty table gives no
rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stafflens.llm.common import words

#: Permitted lengths in tokens, and what a sequence of each costs (linear work plus attention).
CAPACITIES = (512, 1024, 2048, 4096)
COLUMNS = "doc_id long, piece int, start long, n_tokens long, bin_id long, capacity int, slot int"


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / 16384


class Packer:
    """Best-fit over open bins of several sizes; ``place`` returns a bin number."""

    def __init__(self, capacities=CAPACITIES, cost=cost, fill: float = 0.95):
        self.sizes = sorted(capacities)
        self.cost, self.fill = cost, fill
        self.room: list[int] = []  # rooms that at least one open bin has, sorted
        self.open: dict[int, list[int]] = {}  # room: bins
        self.used: list[int] = []

    def _opened(self, n: int) -> int:
        """The size with the least cost per token that it is expected to hold."""
        return min((c for c in self.sizes if c >= n), key=lambda c: (self.cost(c) / max(n, self.fill * c), c))

    def place(self, n: int) -> int:
        at = bisect_left(self.room, n)
        if at < len(self.room):
            room = self.room[at]
            bins = self.open[room]
            b = bins.pop()
            if not bins:
                del self.open[room], self.room[at]
        else:
            room, b = self._opened(n), len(self.used)
            self.used.append(0)
        self.used[b] += n
        if left := room - n:
            if left not in self.open:
                insort(self.room, left)
            self.open.setdefault(left, []).append(b)
        return b

    def capacities(self) -> list[int]:
        """Each bin's final size: the cheapest permitted one that holds its contents."""
        return [min((c for c in self.sizes if c >= u), key=lambda c: (self.cost(c), c)) for u in self.used]


class Completer:
    """Bins of the lengths left, one at a time; each size competes with what it would really hold."""

    def __init__(self, lengths: np.ndarray, capacities=CAPACITIES, cost=cost):
        self.sizes, self.cost = sorted(capacities), cost
        values, counts = np.unique(lengths, return_counts=True)
        self.lengths: list[int] = values.tolist()  # those left, sorted
        self.left: dict[int, int] = dict(zip(self.lengths, counts.tolist()))

    def _content(self, capacity: int) -> tuple[int, list[tuple[int, int]]]:
        """Tokens and (length, pieces) that a bin takes, the longest that fit first."""
        taken, room, at = [], capacity, bisect_right(self.lengths, capacity) - 1
        while at >= 0:
            n = self.lengths[at]
            k = min(self.left[n], room // n)
            taken.append((n, k))
            room -= k * n
            at = min(at, bisect_right(self.lengths, room)) - 1
        return capacity - room, taken

    def bins(self) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Capacity and content of each bin."""
        while self.lengths:
            best = None
            for opened in (c for c in self.sizes if c >= self.lengths[-1]):
                used, taken = self._content(opened)
                shrunk = min((c for c in self.sizes if c >= used), key=lambda c: (self.cost(c), c))
                rate = (self.cost(shrunk) / used, shrunk)
                if best is None or rate < best[0]:
                    best = rate, taken
            for n, k in best[1]:
                self.left[n] -= k
                if not self.left[n]:
                    del self.left[n], self.lengths[bisect_left(self.lengths, n)]
            yield best[0][1], best[1]


def completed(sizes: np.ndarray, capacities=CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and slot of each piece of the decreasing ``sizes``, and the capacity of each bin, by ``Completer``."""
    bins, slots, final = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int32), []
    values, first = np.unique(-sizes, return_index=True)
    at = dict(zip((-values).tolist(), first.tolist()))  # next piece of each length
    for capacity, content in Completer(sizes, capacities).bins():
        slot = 0
        for n, k in content:
            bins[at[n] : at[n] + k] = len(final)
            slots[at[n] : at[n] + k] = np.arange(slot, slot + k)
            at[n], slot = at[n] + k, slot + k
        final.append(capacity)
    return bins, slots, np.array(final, dtype=np.int64)


def pack_lengths(ids: np.ndarray, lengths: np.ndarray, group: int, capacities=CAPACITIES) -> pd.DataFrame:
    """Pack one group; ``group`` makes its bin ids distinct from other groups'."""
    largest = max(capacities)
    n_pieces = np.maximum(1, -(-lengths // largest))
    row = np.repeat(np.arange(len(lengths)), n_pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    start = piece * largest
    size = np.minimum(lengths[row] - start, largest)
    packer = Packer(capacities)
    bins, slots, filled = np.full(len(row), -1), np.zeros(len(row), dtype=np.int32), {}
    order = np.lexsort((piece, ids[row], -size))
    order = order[size[order] > 0]
    for k in order:
        bins[k] = b = packer.place(int(size[k]))
        slots[k] = filled[b] = filled.get(b, -1) + 1
    final = np.array([*packer.capacities(), 0])
    other, places, capacity = completed(size[order], capacities)
    if sum(map(cost, capacity.tolist())) < sum(map(cost, final[:-1].tolist())):
        bins[order], slots[order], final = other, places, np.append(capacity, 0)
    some = bins >= 0
    return pd.DataFrame({
        "row": row, "piece": piece.astype(np.int32), "start": start, "n_tokens": size,
        "bin_id": pd.Series(bins + (group << 32), dtype="Int64").where(some),
        "capacity": pd.Series(final[bins], dtype="Int32").where(some),
        "slot": pd.Series(slots, dtype="Int32").where(some),
    })


def pack(df: DataFrame, text: str = "text", key: str = "doc_id", length: str | None = None, capacities: tuple[int, ...] = CAPACITIES, group_rows: int = 50_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin_id, capacity, slot (place in the bin).

    ``length`` names a column of token counts; else the words of ``text`` are counted.
    """
    size = F.size(words(F.col(text))) if length is None else F.coalesce(F.col(length), F.lit(0))
    doc_id = F.col(key).cast("long")
    # Null ids travel as zeros and a mark: pandas would turn a column of longs with nulls into doubles.
    lengths = df.select(F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc_id"), doc_id.isNull().alias("id_is_null"), size.cast("long").alias("n"))
    groups = max(1, -(-df.count() // group_rows))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)  # ids and lengths of one group
        if not rows:
            return
        rows = pd.concat(rows, ignore_index=True)
        ids = rows["doc_id"].to_numpy(dtype=np.int64)
        out = pack_lengths(ids, rows["n"].to_numpy(dtype=np.int64), TaskContext.get().partitionId(), capacities)
        at = out.pop("row").to_numpy()
        out.insert(0, "doc_id", pd.Series(ids[at], dtype="Int64").mask(rows["id_is_null"].to_numpy(dtype=bool)[at]))
        for at in range(0, len(out), 100_000):
            yield out.iloc[at : at + 100_000]

    return lengths.repartition(groups).mapInPandas(packed, COLUMNS)


def bins(packed: DataFrame) -> DataFrame:
    """One row per bin: bin_id, capacity, used tokens and pieces."""
    return packed.where("bin_id is not null").groupBy("bin_id", "capacity").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_pieces"))
