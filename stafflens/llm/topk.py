"""Exact top-k inner products by aggregation without random access.

The candidates are dealt into groups, and a group into blocks of ``BLOCK_ROWS``
rows. In a block each dimension is a list of its rows sorted by component; a query
reads a list from its high end if its own component is positive, else from the low
end, so that contributions come in falling order. The lists are read in step. A row's
lower bound is what was read of it plus the least contribution each unread list
still holds, its upper bound uses the contribution at the list's present depth
instead. Rows whose upper bound is below the k-th best lower bound, or below the
k-th best score of the blocks before, cannot qualify and leave. A query that still
has outsiders reads on, each time half of what is left of the lists; one without
stops, and the final scores of its rows are resolved in full.

Sums of integers below 2^53 are exact in floating point. Where components are so
large that a bound may be beyond, bounds are widened by their rounding error, and
final scores are resolved in whole numbers of any size.

Query groups meet candidate groups, both bounded in bytes; a meeting returns at
most k rows a query, and the best k of them is a ranking per query over those.
Every exact search meets all candidates with all queries; what is shuffled for it
is the candidates once for each group of queries (16,000 of 64 dimensions) and the
queries once for each group of candidates (65,000).

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without id; vectors of other lengths count
as padded with zeros; a query with fewer candidates gets all; rows that repeat
an id are candidates each, but none is its own query's; an empty table gives an
empty result; components and scores beyond a long are held at its end, and rank so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stafflens.llm.common import stored

BLOCK_ROWS = 4096
#: Queries that a block answers at once.
QUERY_ROWS = 256
#: Bytes of vectors in a group of candidates and of queries, which one task holds.
GROUP_BYTES = 32 << 20
ASKED_BYTES = 8 << 20
#: Candidates are dealt into this many groups at least, while a group has a block's rows.
GROUPS = 64
_END = 2.0**63
SCALE = 1024


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long, null where a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.coalesce(fine, F.lit(False)) & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


class SortedLists:
    """The lists of one block: for each dimension the rows in rising order of their component.

    ``entries`` counts what queries read of the lists: rows of one list, of all that it has.
    """

    def __init__(self, vectors: np.ndarray):
        order = np.argsort(vectors, axis=0, kind="stable")
        self.whole = vectors
        self.vectors = vectors.astype(np.float64)
        self.sorted = np.take_along_axis(self.vectors, order, axis=0)
        self.place = np.empty_like(order)  # of each row in each list
        np.put_along_axis(self.place, order, np.arange(len(vectors))[:, None], axis=0)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.entries = [0, 0]

    def bounds(self, high: np.ndarray, low: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (row, query) after ``depth`` entries of each list from its gainful end.

        ``high`` and ``low`` hold the positive and the negative components of the queries.
        What is read of a row is counted above the least contribution of its list.
        """
        n = len(self.vectors)
        down, up = self.place >= n - depth, self.place < depth
        least, most = self.sorted[0], self.sorted[-1]
        read = np.hstack((np.where(down, self.vectors - least, 0), np.where(up, self.vectors - most, 0)))
        lower = read @ np.vstack((high, low)) + (least @ high + most @ low)
        front = np.vstack(((self.sorted[n - depth] - least)[:, None] * high, (self.sorted[depth - 1] - most)[:, None] * low))
        return lower, lower + np.hstack((~down, ~up)).astype(np.float64) @ front

    def _errors(self, q: np.ndarray) -> np.ndarray:
        """For each query how far a bound or a score may be off: nothing while all sums stay below 2^53."""
        size = 8 * len(q) * self.largest * np.abs(q).max(axis=0, initial=0)  # of all that a bound adds up
        return np.where(size < 2.0**53, 0, size * (8 * len(q) + 16) * 2.0**-53)

    def top(self, queries: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray, known: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """For each query up to ``k`` (row, score), best first, ties to the smaller id; rows with its own id are left out.

        ``known`` has a score for each query that ``k`` rows elsewhere reach: rows below it may be missing.
        """
        n = len(self.vectors)
        alive = ids[:, None] != own[None, :]
        few = max(4 * k, n // 16)
        q = queries.astype(np.float64).T
        error = self._errors(q)
        floor = np.full(len(queries), -np.inf) if known is None else known

        def bar(scores: np.ndarray, which) -> np.ndarray:
            kth = np.partition(scores, n - k, axis=0)[n - k] if n >= k else np.full(scores.shape[1], -np.inf)
            return np.clip(np.maximum(kth - error[which], floor[which]), -_END, _END)  # scores beyond are equal

        depth = -(-n // 4)
        self.entries[1] += n * len(queries)
        open_ = np.flatnonzero(alive.sum(axis=0) > few)
        read = np.zeros(len(queries), dtype=np.int64)
        while len(open_) and depth < n:
            read[open_] = depth
            lower, upper = self.bounds(np.maximum(q[:, open_], 0), np.minimum(q[:, open_], 0), depth)
            lower[~alive[:, open_]] = -np.inf
            alive[:, open_] &= upper + error[open_] >= bar(lower, open_)
            open_ = open_[alive[:, open_].sum(axis=0) > few]
            depth += max(1, (n - depth) // 2)
            if n - depth <= n // 16:  # what is unread costs less in full
                break
        self.entries[0] += int(read.sum())
        out = []
        for j in range(len(queries)):
            rows = np.flatnonzero(alive[:, j])
            scores = self.vectors[rows] @ q[:, j]
            if len(rows) > k:
                kth = np.clip(np.partition(scores, len(rows) - k)[len(rows) - k] - error[j], -_END, _END)
                near = np.flatnonzero(scores + error[j] >= kth)
                rows, scores = rows[near], scores[near]
            if error[j]:
                asked = queries[j].astype(object)
                held = [min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in self.whole[rows].astype(object) @ asked]
            else:
                held = scores.astype(np.int64).tolist()
            best = sorted(zip(held, ids[rows].tolist(), rows.tolist()), key=lambda x: (-x[0], x[1]))[:k]
            out.append([(row, score) for score, _, row in best])
        return out


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _answers(block: pd.DataFrame, questions: pd.DataFrame, k: int, width: int, block_rows: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score): the ``k`` best rows of a group for each question, block after block."""
    vectors, ids = _matrix(block["v"].tolist(), width), block["vec_id"].to_numpy(dtype=np.int64)
    asked, own = _matrix(questions["v"].tolist(), width), questions["vec_id"].to_numpy(dtype=np.int64)
    best: list[list[tuple[int, int]]] = [[] for _ in own]  # (score, id)
    for at in range(0, len(ids), block_rows):
        lists, some = SortedLists(vectors[at : at + block_rows]), ids[at : at + block_rows]
        for lo in range(0, len(own), QUERY_ROWS):
            held = best[lo : lo + QUERY_ROWS]
            known = np.array([b[k - 1][0] if len(b) >= k else -np.inf for b in held])
            found = lists.top(asked[lo : lo + QUERY_ROWS], k, some, own[lo : lo + QUERY_ROWS], known)
            for j, new in enumerate(found):
                both = held[j] + [(score, int(some[row])) for row, score in new]
                best[lo + j] = sorted(both, key=lambda x: (-x[0], x[1]))[:k]
    return [(q, i, score) for q, b in zip(own.tolist(), best) for score, i in b]


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows for each row where ``queries`` holds."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("v"), queries.alias("asks"))
    rows = stored(rows.where("vec_id is not null and v is not null"), "vectors")
    n, width, n_queries = rows.agg(F.count("*"), F.max(F.size("v")), F.sum(F.col("asks").cast("long"))).first()
    width = width or 0
    group_rows = min(max(block_rows, GROUP_BYTES // (8 * max(1, width))), max(block_rows, -(-n // GROUPS)))
    groups = max(1, -(-n // group_rows))
    asked = max(1, -(-(n_queries or 0) * 8 * max(1, width) // ASKED_BYTES))
    # The hash of id and vector deals rows evenly even if an id repeats with other vectors.
    deal = F.xxhash64("vec_id", "v")
    candidates = rows.withColumn("group", F.pmod(deal, F.lit(groups)).cast("int"))
    candidates = candidates.select(F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("part"), "group", F.lit(False).alias("asks"), "vec_id", "v")
    asking = rows.where("asks").withColumn("part", F.pmod(deal, F.lit(asked)).cast("int"))
    asking = asking.select("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("asks"), "vec_id", "v")

    def meet(batch: pd.DataFrame) -> pd.DataFrame:
        ask = batch["asks"].to_numpy(dtype=bool)
        found = _answers(batch[~ask], batch[ask], k, width, block_rows) if ask.any() and not ask.all() else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    met = candidates.union(asking).groupBy("part", "group").applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
