"""Distributed row numbering, NTILE and rank within skewed partitions.

Spark plans ``row_number()`` / ``ntile()`` over a window without PARTITION BY
as a single-partition sort: one task would sort the whole table. Here the
global position is computed the way a distributed sort numbers its output:

1. range-partition the rows on the full sort key and sort inside partitions;
2. tag rows with ``monotonically_increasing_id`` (partition index in the high
   bits, position inside the partition in the low 33 bits);
3. checkpoint (reliable, into ``spark.checkpoint.dir``) so the counting pass
   and the numbering pass see the same partitions even if executors are lost
   or the range sampler would pick other bounds on re-execution;
4. count rows per partition on the checkpoint (one number per partition,
   bounded by the partition count) and turn the counts into offsets;
5. global number = offset of the partition (an array literal indexed by the
   partition index) + position inside it + 1 — a narrow projection.

Rank within a few very large partitions (W22) uses a histogram of
(partition, score) instead of sorting raw rows: rank = 1 + rows with a better
score in the same partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import join_group_stats

_LOW_BITS = (1 << 33) - 1


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_number",
                      *, num_partitions: int | None = None, total_name: str | None = None) -> DataFrame:
    """1-based position of every row in ``order`` (give a unique tie-break last).

    Adds ``name`` (BIGINT) and, if ``total_name`` is set, the total row count.
    The per-partition row counts (one number per range partition, bounded by
    ``num_partitions``) are computed once on the checkpoint and applied as a
    literal offset table, so the numbering itself is a narrow projection.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # Without an explicit count the range exchange uses the session's shuffle
    # partitions and AQE may merge adjacent ranges of a small input; merged
    # partitions stay in range order with contiguous task indices.
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    tagged = (ranged.sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    pid = F.shiftright("_mid", 33)
    counts = {r[0]: r[1] for r in tagged.groupBy(pid).agg(F.count(F.lit(1))).collect()}
    width = max(counts, default=-1) + 1
    offsets, running = [], 0
    for p in range(width):
        offsets.append(running)
        running += counts.get(p, 0)
    table = F.array(*[F.lit(o).cast("bigint") for o in offsets]) if offsets else F.array().cast("array<bigint>")
    position = F.element_at(table, (pid + 1).cast("int")) + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)) + 1
    out = tagged.withColumn(name, position.cast("bigint"))
    if total_name:
        out = out.withColumn(total_name, F.lit(running).cast("bigint"))
    return out.drop("_mid")


def with_surrogate_key(df: DataFrame, order: Sequence[Column | str], key_name: str,
                       *, num_partitions: int | None = None) -> DataFrame:
    """Dense, deterministic 1..n key following ``order`` (a unique key)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    out = global_row_number(df, cols, key_name, num_partitions=num_partitions)
    return out.select(key_name, *[c for c in df.columns])


def global_ntile(df: DataFrame, order: Sequence[Column], k: int, name: str = "ntile",
                 *, num_partitions: int | None = None) -> DataFrame:
    """NTILE(k) over all rows in ``order``, without a single-partition sort.

    With n rows, q = n div k and m = n mod k: the first m tiles hold q + 1
    rows, the rest q rows (SQL NTILE).
    """
    if k <= 0:
        raise ValueError("k must be positive")
    out = global_row_number(df, order, "_r", num_partitions=num_partitions, total_name="_n")
    r, n = F.col("_r"), F.col("_n")
    q, m = F.floor(n / k), n % k
    big = m * (q + 1)
    tile = (F.when(r <= big, F.floor((r - 1) / (q + 1)) + 1)
            .otherwise(m + F.floor((r - big - 1) / F.greatest(q, F.lit(1))) + 1))
    return out.withColumn(name, tile.cast("int")).drop("_r", "_n")


def rank_within(df: DataFrame, part: str, score: str, *, rank_name: str = "rank",
                mean_name: str = "part_mean", salt_from: Sequence[str] | None = None) -> DataFrame:
    """RANK() by ``score`` descending (NULLs first) within ``part``, and the
    partition mean of ``score`` (unrounded), for every row.

    A (part, score) histogram is aggregated with partial aggregation; the rank
    of a score is 1 + the number of rows with a better score in its partition
    (a window over the histogram, whose size is the number of distinct scores
    per partition, not the rows). Rows get their rank and mean by an equi-join
    with the histogram (NULL-safe on both keys); with ``salt_from`` (row id
    columns) the histogram is stored, counted and broadcast while small, else
    joined with a salt, so a (part, score) pair holding a third of the rows is
    never one task.
    """
    hist = df.groupBy(part, score).agg(F.count(F.lit(1)).alias("_cnt"))
    better = (Window.partitionBy(part).orderBy(F.col(score).desc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(part)
    scored = F.when(F.col(score).isNotNull(), F.col("_cnt"))
    hist = hist.select(
        F.col(part).alias("_h_part"), F.col(score).alias("_h_score"),
        (F.coalesce(F.sum("_cnt").over(better), F.lit(0)) + 1).cast("int").alias(rank_name),
        (F.sum(F.col(score).cast("double") * F.col("_cnt")).over(whole)
         / F.sum(scored).over(whole)).alias(mean_name),
    )
    if salt_from:
        out = join_group_stats(df, hist, [(F.col(part), "_h_part"), (F.col(score), "_h_score")],
                          salt_from=salt_from, null_safe=True)
        return out.drop("_h_part", "_h_score")
    cond = F.col(part).eqNullSafe(F.col("_h_part")) & F.col(score).eqNullSafe(F.col("_h_score"))
    return df.join(hist, cond, "inner").drop("_h_part", "_h_score")
