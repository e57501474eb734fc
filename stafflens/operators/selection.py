"""Exact percentiles of many groups without a map of their values.

``percentile`` keeps every distinct value of a group in one state, which for a
continuous measure is every row. Selection keeps a bounded histogram instead.
Each wanted rank of a group has an interval of values that holds it, at first
the group's minimum and maximum. A round deals the rows inside an interval to
at most ``BINS`` bins and takes each bin's count, minimum and maximum (one
partial aggregation); the bin that the rank falls into gives the next interval.
A rank is found when its interval is one value.

The bin of a value is a function that never falls as the value grows, and the
next interval is the bin's own minimum and maximum, so rounding cannot move a
rank. Intervals that span signs or magnitudes are cut by logarithm, others
evenly: at most two rounds bring an interval within a factor of four, and every
further one divides it by ``BINS``, so six more end any (52 bits); values spread
evenly take log(rows) / log(BINS) rounds. Shuffled per round: at most one row
per task, interval and bin.

Rows meet their group's intervals by ``join_group_stats``: a broadcast while
few, salted beyond, so a group that holds a third of the rows is no hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_double
from ..session import ensure_checkpoint_dir
from .joins import DEFAULT_MAX_BROADCAST_ROWS, join_group_stats

BINS = 1024


def _magnitude(x: Column) -> Column:
    """Grows with ``x`` over all doubles; NaN is the largest, as in Spark's order."""
    log = F.least(F.log2(F.abs(x)), F.lit(1100.0)) + F.lit(1076.0)
    return (F.when(F.isnan(x), F.lit(2300.0)).when(x == 0, F.lit(0.0)).when(x > 0, log).otherwise(-log))


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0 to bins - 1: where ``x`` lies between ``low`` and ``high``."""
    near = ((low > 0) & (high <= low * 4)) | ((high < 0) & (low >= high * 4))
    even = (x - low) / F.nullif(high - low, F.lit(0.0))
    by_log = (_magnitude(x) - _magnitude(low)) / F.nullif(_magnitude(high) - _magnitude(low), F.lit(0.0))
    share = F.when(near, even).otherwise(by_log)
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")


def select_percentiles(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    ps: Sequence[float],
    names: Sequence[str],
    *,
    extra: Sequence[Column] = (),
    bins: int = BINS,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """One row per group: ``by``, the interpolated percentiles ``names`` (PERCENTILE_CONT of
    ``x`` as double, unrounded) and the aggregates ``extra``.

    NULLs of ``x`` take no part; a group of NULLs has NULL percentiles; a NULL
    key is a group of its own. NaN counts as the largest value.
    """
    if bins < 2:
        raise ValueError("bins must be 2 or more")
    if not all(0 <= p <= 1 for p in ps) or len(ps) != len(names):
        raise ValueError("every percentile lies in 0..1 and has a name")
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], as_double(x).alias("_x"))
    groups = (df.withColumn("_x", as_double(x)).groupBy(*by)
              .agg(F.count("_x").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), *extra)
              .withColumnsRenamed(dict(zip(by, keys))).checkpoint(eager=True))

    # Two ranks per percentile: the rows below and above its position.
    position = [F.lit(float(p)) * (F.col("_n") - 1) for p in ps]
    ranks = F.array_distinct(F.array(*[f(pos).cast("bigint") for pos in position for f in (F.floor, F.ceil)]))
    wanted = groups.where("_n > 0").select(*keys, F.explode(ranks).alias("_rank"), F.col("_min").alias("_low"),
                                           F.col("_max").alias("_high"), F.lit(0).cast("bigint").alias("_below"))
    wanted, left = _counted(wanted)
    while left:
        wanted, left = _counted(_round(rows, wanted, keys, bins, max_broadcast_rows))

    values = wanted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_low"))).alias("_at"))
    out = groups.join(values.withColumnsRenamed({k: f"{k}_v" for k in keys}), _same(keys), "left") if keys else \
        groups.join(values, F.lit(True), "left")
    for pos, name in zip(position, names):
        under, over = (F.col("_at")[f(pos).cast("bigint")] for f in (F.floor, F.ceil))
        share = pos - F.floor(pos)
        between = (F.lit(1.0) - share) * under + share * over
        out = out.withColumn(name, F.when(under == over, under).otherwise(between))
    kept = [c for c in groups.columns if c not in (*keys, "_n", "_min", "_max")]
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *names, *kept)


def _same(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}_v"))
    return out


def _counted(wanted: DataFrame) -> tuple[DataFrame, int]:
    """The ranks' table checkpointed, and how many ranks are not yet one value."""
    obs = Observation()
    out = wanted.observe(obs, F.count_if(F.col("_low") < F.col("_high")).alias("left")).checkpoint(eager=True)
    return out, obs.get["left"]


def _round(rows: DataFrame, wanted: DataFrame, keys: list[str], bins: int, max_rows: int) -> DataFrame:
    """``wanted`` with every open interval replaced by the bin that holds its rank."""
    unfinished = F.col("_low") < F.col("_high")
    # At most two intervals per percentile and group; they do not overlap.
    spans = wanted.where(unfinished).groupBy(*[F.col(k).alias(f"{k}_v") for k in keys]).agg(
        F.collect_set(F.struct("_low", "_high")).alias("_spans"))
    if keys:
        met = join_group_stats(rows.where("_x IS NOT NULL"), spans, [(F.col(k), f"{k}_v") for k in keys],
                               salt_from=["_x"], max_rows=max_rows, null_safe=True)
    else:
        met = rows.where("_x IS NOT NULL").join(F.broadcast(spans), F.lit(True))
    span = F.filter("_spans", lambda s: (F.col("_x") >= s["_low"]) & (F.col("_x") <= s["_high"]))
    met = met.select(*keys, "_x", F.get(span, F.lit(0)).alias("_s")).where("_s IS NOT NULL")
    low, high = F.col("_s._low"), F.col("_s._high")
    found = met.groupBy(*keys, low.alias("_from"), _bin(F.col("_x"), low, high, bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_b_low"), F.max("_x").alias("_b_high"))
    # Rows of the interval in lower bins: a window over at most ``bins`` rows.
    before = Window.partitionBy(*keys, "_from").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumnsRenamed(
        {k: f"{k}_v" for k in keys})
    inside = F.col("_rank") - F.col("_below")
    hit = (wanted.where(unfinished).join(found, _same(keys) & (F.col("_low") == F.col("_from"))
                                         & (inside >= F.col("_before")) & (inside < F.col("_before") + F.col("_c")))
           .select(*keys, "_rank", F.col("_b_low").alias("_low"), F.col("_b_high").alias("_high"),
                   (F.col("_below") + F.col("_before")).alias("_below")))
    return wanted.where(~unfinished).unionByName(hit)
