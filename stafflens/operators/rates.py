"""Group-and-rate operators.

All are one ``groupBy().agg()`` (partial aggregation before the shuffle, so a
hot group costs one partial row per task) followed, where a statistic over
the groups is needed, by a window over the aggregated rows. Windows never run
over raw rows here; the group count is the key cardinality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_double, count_rows, count_where, fround, pct, safe_div

Cols = Sequence[str | Column]


def group_rate(
    df: DataFrame,
    by: Cols,
    hit: Column,
    *,
    n_name: str = "total_employees",
    hits_name: str = "attritions",
    rate_name: str = "attrition_rate_pct",
    digits: int = 2,
    extra: Sequence[Column] = (),
    keep_ratio: str | None = None,
) -> DataFrame:
    """Rows per group, rows where ``hit`` holds, and 100·hits/rows rounded.

    ``extra`` adds more aggregates to the same pass. ``keep_ratio`` names an
    unrounded hits/rows double column to keep for ranking or baselines.
    """
    out = df.groupBy(*by).agg(count_rows().alias(n_name), count_where(hit).alias(hits_name), *extra)
    out = out.withColumn(rate_name, fround(pct(hits_name, n_name), digits))
    if keep_ratio:
        out = out.withColumn(keep_ratio, safe_div(hits_name, n_name))
    return out


def rank_desc(ratio: str, name: str) -> Column:
    """RANK by ``ratio`` descending, NULLs first (the PostgreSQL default for DESC)."""
    return F.rank().over(Window.orderBy(F.col(ratio).desc_nulls_first())).alias(name)


def ranked_group_rate(df: DataFrame, by: Cols, hit: Column, *, rank_name: str = "risk_rank", **kw) -> DataFrame:
    """W09 plus RANK of the unrounded rate (window over group rows)."""
    out = group_rate(df, by, hit, keep_ratio="_ratio", **kw)
    return out.withColumn(rank_name, rank_desc("_ratio", rank_name)).drop("_ratio")


def relative_rate(
    df: DataFrame,
    by: Cols,
    hit: Column,
    *,
    baseline: str,
    out_name: str,
    out_digits: int,
    order_by: str | None = None,
    fix_units: bool = False,
    **kw,
) -> DataFrame:
    """Each group's rate against a baseline over all groups.

    * ``min``:  100·rate / min(rate) − 100 (percent above the lowest group)
    * ``mean``: 100·rate − mean(rate) (the source subtracts a fraction from a
      percent; ``fix_units=True`` subtracts 100·mean instead)
    * ``first``: rate of the first group in ``order_by`` / own rate
    Rates are unrounded doubles; a zero divisor gives NULL.
    """
    out = group_rate(df, by, hit, keep_ratio="_ratio", **kw)
    ratio = F.col("_ratio")
    pct_rate = pct(kw.get("hits_name", "attritions"), kw.get("n_name", "total_employees"))
    all_groups = Window.partitionBy()
    if baseline == "min":
        value = pct_rate / F.nullif(F.min(ratio).over(all_groups), F.lit(0.0)) - F.lit(100.0)
    elif baseline == "mean":
        mean = F.avg(ratio).over(all_groups)
        value = pct_rate - (F.lit(100.0) * mean if fix_units else mean)
    elif baseline == "first":
        if order_by is None:
            raise ValueError("baseline='first' needs order_by")
        first = F.first(ratio).over(
            Window.orderBy(F.col(order_by).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        value = first / F.nullif(ratio, F.lit(0.0))
    else:
        raise ValueError(f"unknown baseline {baseline!r}")
    return out.withColumn(out_name, fround(value, out_digits)).drop("_ratio")


def overall_rate(df: DataFrame, hit: Column, *, n_name="total_employees", hits_name="employees_left",
                 rate_name="attrition_rate_pct", digits: int = 2) -> DataFrame:
    """One row: rows, hits, rate."""
    out = df.agg(count_rows().alias(n_name), count_where(hit).alias(hits_name))
    return out.withColumn(rate_name, fround(pct(hits_name, n_name), digits))


def share(
    df: DataFrame,
    by: Cols,
    *,
    count_name: str = "employee_count",
    shares: Sequence[tuple[str, Sequence[str] | None]] = (("pct_of_total", None),),
    digits: int = 2,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Count per group and its percent of the total or of a parent group.

    ``shares`` lists (output name, parent columns or None for the grand total).
    The sum of counts is a window over the group rows.
    """
    out = counts if counts is not None else df.groupBy(*by).agg(count_rows().alias(count_name))
    for name, parent in shares:
        w = Window.partitionBy(*parent) if parent else Window.partitionBy()
        out = out.withColumn(name, fround(pct(count_name, F.sum(count_name).over(w)), digits))
    return out


def two_group_gap(
    df: DataFrame,
    by: Cols,
    split: str,
    a: str,
    b: str,
    x: str | None = None,
    *,
    names: dict[str, str],
) -> DataFrame:
    """Counts (and means of ``x``) of two categories of ``split`` per group.

    Returns the columns named in ``names`` for keys n, n_a, n_b and, with ``x``,
    mean_a, mean_b (unrounded doubles). A category missing from a group gives
    count 0 and a NULL mean.
    """
    s = F.col(split)
    aggs = [count_rows().alias(names["n"]), count_where(s == a).alias(names["n_a"]),
            count_where(s == b).alias(names["n_b"])]
    if x is not None:
        aggs += [F.avg(F.when(s == a, as_double(x))).alias(names["mean_a"]),
                 F.avg(F.when(s == b, as_double(x))).alias(names["mean_b"])]
    return df.groupBy(*by).agg(*aggs)


def event_rate(
    members: DataFrame,
    events: DataFrame,
    by: Cols,
    *,
    key: str = "employee_id",
    n_name: str = "total_employees",
    hits_name: str = "total_exits",
    rate_name: str = "attrition_rate_pct",
    digits: int = 2,
) -> DataFrame:
    """W09 over a member ⟕ event join: rows and matched events per group, and the rate.

    Same figures as ``COUNT(*)`` / ``COUNT(event.key)`` over the fanned-out left
    join (a member with k events is k rows, one without is one row), computed
    without the fan-out: events are counted per key first (partial aggregation
    absorbs a key holding a third of all events), then joined 1:1, and
    Σ max(k, 1) / Σ k replace the two counts.
    """
    per_key = events.groupBy(key).agg(F.count(F.lit(1)).alias("_k"))
    k = F.coalesce(F.col("_k"), F.lit(0))
    out = members.join(per_key, key, "left").groupBy(*by).agg(
        F.sum(F.greatest(k, F.lit(1))).alias(n_name), F.sum(k).alias(hits_name))
    return out.withColumn(rate_name, fround(pct(hits_name, n_name), digits))
