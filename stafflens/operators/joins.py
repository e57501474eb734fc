"""Join helpers: broadcast only behind a size check.

``bounded_broadcast`` counts a side (one number per task) and hints a broadcast
only when it is proven small; beyond the bound Spark keeps a shuffle join, which
AQE may still convert from measured stage sizes.

``join_group_stats`` joins rows to statistics of their groups. The statistics
are computed once, stored and counted in the same job; a small table (the rule:
one row per group) is broadcast, so no row is shuffled and a hot group is no
hot task. Beyond the bound the join is salted, with as many salts as the session
has shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

DEFAULT_MAX_BROADCAST_ROWS = 100_000


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows."""
    return df.count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when its row count is proven <= max_rows, else ``df``."""
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df


def salted_join(rows: DataFrame, stats: DataFrame, cond_cols: Sequence[tuple[Column, str]], *,
                salt_from: Sequence[str], buckets: int, how: str = "inner",
                null_safe: bool = False) -> DataFrame:
    """Join many ``rows`` to a small per-group ``stats`` table when one group may
    hold a large share of the rows.

    Each row gets a deterministic salt (hash of ``salt_from`` columns modulo
    ``buckets``); every ``stats`` row is repeated once per bucket with
    ``explode`` (``buckets`` × group count rows). The join key becomes
    (group, salt), so a group holding a third of the rows is spread over
    ``buckets`` partitions whether or not AQE broadcasts or splits it.

    cond_cols: (row-side column, stats-side column name) pairs.
    """
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(buckets)))
    salted_stats = stats.withColumn("_salt_s", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)).cast(
        "array<bigint>")))
    cond = salted_rows["_salt"] == salted_stats["_salt_s"]
    for row_col, stat_col in cond_cols:
        right = salted_stats[stat_col]
        cond = cond & (row_col.eqNullSafe(right) if null_safe else row_col == right)
    return salted_rows.join(salted_stats, cond, how).drop("_salt", "_salt_s")


def join_group_stats(rows: DataFrame, stats: DataFrame, cond_cols: Sequence[tuple[Column, str]], *,
                     salt_from: Sequence[str], max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                     null_safe: bool = False) -> DataFrame:
    """Inner join of ``rows`` to one row of ``stats`` per group, without shuffling ``rows``
    while the statistics have at most ``max_rows`` rows (counted as they are stored)."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    obs = Observation()
    stats = stats.observe(obs, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    if obs.get["n"] > max_rows:
        buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return salted_join(rows, stats, cond_cols, salt_from=salt_from, buckets=buckets, null_safe=null_safe)
    side = F.broadcast(stats)
    cond = F.lit(True)
    for row_col, stat_col in cond_cols:
        cond = cond & (row_col.eqNullSafe(side[stat_col]) if null_safe else row_col == side[stat_col])
    return rows.join(side, cond)
