"""Group statistics.

``group_profile`` is a single ``groupBy().agg()`` whose metrics are arbitrary
expressions over aggregate functions; Catalyst computes each distinct
aggregate once (mean and sd of one column share one buffer) and merges them
in a partial + final HashAggregate. Statistics over the groups (W17) are
windows over the aggregated rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ColumnLike, as_double, col, count_rows, count_where, fround, pct, safe_div
from .joins import join_group_stats
from .selection import select_percentiles

Cols = Sequence[str | Column]
#: Distinct values that one group's value map may hold; beyond, percentiles are selected by histograms.
MAX_VALUES = 1_000_000


# --- metric expressions for group_profile ----------------------------------------------------------
def m_count() -> Column:
    return count_rows()


def m_count_distinct(x: ColumnLike) -> Column:
    return F.count_distinct(col(x))


def m_count_where(cond: Column) -> Column:
    return count_where(cond)


def m_sum(x: ColumnLike) -> Column:
    return F.sum(col(x))


def m_mean(x: ColumnLike, digits: int | None = None) -> Column:
    m = F.avg(as_double(x))
    return m if digits is None else fround(m, digits)


def m_min(x: ColumnLike) -> Column:
    return F.min(col(x))


def m_max(x: ColumnLike) -> Column:
    return F.max(col(x))


def m_range(x: ColumnLike) -> Column:
    return F.max(col(x)) - F.min(col(x))


def m_sd(x: ColumnLike, digits: int | None = None) -> Column:
    """Sample standard deviation (n − 1); NULL for a one-row group."""
    s = F.stddev_samp(as_double(x))
    return s if digits is None else fround(s, digits)


def m_cv_pct(x: ColumnLike, digits: int) -> Column:
    """Coefficient of variation: 100 · sd / mean, NULL on a zero mean."""
    return fround(F.stddev_samp(as_double(x)) / F.nullif(F.avg(as_double(x)), F.lit(0.0)) * F.lit(100.0), digits)


def m_share_pct(cond: Column, digits: int) -> Column:
    """Percent of rows where ``cond`` holds."""
    return fround(pct(count_where(cond), count_rows()), digits)


def m_ratio_of_means(a: ColumnLike, b: ColumnLike, digits: int | None = None) -> Column:
    r = safe_div(F.avg(as_double(a)), F.avg(as_double(b)))
    return r if digits is None else fround(r, digits)


def m_mean_of_means(cols: Sequence[ColumnLike], digits: int) -> Column:
    total = None
    for c in cols:
        m = F.avg(as_double(c))
        total = m if total is None else total + m
    return fround(total / F.lit(float(len(cols))), digits)


def group_profile(df: DataFrame, by: Cols, metrics: Sequence[tuple[str, Column]]) -> DataFrame:
    """One pass computing the named metrics per group."""
    return df.groupBy(*by).agg(*[expr.alias(name) for name, expr in metrics])


# --- two-level aggregation: per-key moments before a join ----------------------------------------
def key_moments(df: DataFrame, key: str, x: str, *, extra: Sequence[Column] = ()) -> DataFrame:
    """Per ``key``: rows (``_rows``), non-NULL count (``_n``), Σx (``_s``), Σx² (``_ss``).

    Reducing a long history to one row per key before joining it to a
    per-key table keeps the join input at the key count and lets partial
    aggregation absorb a key that holds a third of all rows. Exact for
    integer measures (sums are BIGINT).
    """
    v = F.col(x).cast("bigint")
    return df.groupBy(key).agg(count_rows().alias("_rows"), F.count(v).alias("_n"), F.sum(v).alias("_s"),
                               F.sum(v * v).alias("_ss"), *extra)


def mm_rows() -> Column:
    """COUNT(*) of the original rows, from ``key_moments`` rows."""
    return F.sum("_rows")


def mm_mean(digits: int | None = None) -> Column:
    """AVG(x) of the original rows (Σx / count, one double division)."""
    m = F.sum("_s").cast("double") / F.nullif(F.sum("_n"), F.lit(0)).cast("double")
    return m if digits is None else fround(m, digits)


def mm_sd(digits: int | None = None) -> Column:
    """STDDEV_SAMP(x) of the original rows: (nΣx² − (Σx)²) / (n(n − 1)) in exact
    integers (DECIMAL(38,0)), one division, square root; NULL below two values."""
    n = F.sum("_n").cast("decimal(38,0)")
    s = F.sum("_s").cast("decimal(38,0)")
    ss = F.sum("_ss").cast("decimal(38,0)")
    var = (n * ss - s * s).cast("double") / (n * (n - F.lit(1))).cast("double")
    sd = F.when(F.sum("_n") >= 2, F.sqrt(var))
    return sd if digits is None else fround(sd, digits)


# --- W17 -----------------------------------------------------------------------------------------
def vs_parent_mean(agg: DataFrame, mean_col: str, parent: Sequence[str] = (), *,
                   weight_col: str | None = None) -> Column:
    """Group mean minus the mean of the group means of its parent.

    ``agg`` holds one row per group with an unrounded ``mean_col``; ``parent``
    empty means all groups. By default the parent mean is the *unweighted*
    mean of the group means (the analyses' definition); with ``weight_col``
    (the group row counts) it is the weighted mean, i.e. the parent's own row
    mean. Returns the unrounded difference (a window over the group rows).
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy()
    if weight_col is None:
        return F.col(mean_col) - F.avg(F.col(mean_col)).over(w)
    weighted = F.sum(F.col(mean_col) * F.col(weight_col)).over(w) / F.sum(F.col(weight_col)).over(w)
    return F.col(mean_col) - weighted


# --- W19 / W20 -----------------------------------------------------------------------------------
def percentile_bands(
    df: DataFrame,
    by: Cols,
    x: str,
    ps: Sequence[float],
    names: Sequence[str],
    *,
    exact: bool = True,
    accuracy: int = 10_000,
    extra: Sequence[Column] = (),
    select: bool = False,
) -> DataFrame:
    """Interpolated percentiles (PERCENTILE_CONT) of ``x`` per group, unrounded.

    ``exact`` uses ``percentile`` (value → count map per group, partially
    aggregated, so its state grows with the distinct values of ``x``, not the
    rows); with ``select`` it narrows each rank's interval by rounds of bounded
    histograms instead (``selection``), which callers choose where ``x`` may have
    more than ``MAX_VALUES`` distinct values; ``exact=False`` uses the
    bounded-memory ``percentile_approx``.
    """
    if exact and select:
        return select_percentiles(df, by, x, ps, names, extra=extra)
    arr = (F.percentile(as_double(x), list(ps)) if exact
           else F.percentile_approx(as_double(x), list(ps), accuracy))
    out = df.groupBy(*by).agg(arr.alias("_ps"), *extra)
    for i, name in enumerate(names):
        out = out.withColumn(name, F.col("_ps")[i])
    return out.drop("_ps")


def group_median(df: DataFrame, by: Cols, x: str, name: str = "median", exact: bool = True,
                 select: bool = False) -> DataFrame:
    return percentile_bands(df, by, x, [0.5], [name], exact=exact, select=select)


def vs_group_median(df: DataFrame, by: Sequence[str], x: str, *, median_name: str = "_median",
                    exact: bool = True, salt_from: Sequence[str] | None = None, select: bool = False) -> DataFrame:
    """Every row with its group's median joined back (``median_name``, unrounded).

    The medians are one row per group. With ``salt_from`` (row id columns) they
    are stored, counted and broadcast while few, else joined with a salt, so a
    group holding a third of the rows is never one task. Rows with a NULL key have no group and are dropped, as an
    inner join does.
    """
    med = group_median(df, by, x, median_name, exact, select)
    if salt_from:
        med = med.select(*[F.col(c).alias(f"_m_{c}") for c in by], median_name)
        out = join_group_stats(df, med, [(F.col(c), f"_m_{c}") for c in by], salt_from=salt_from)
        # Same column order as the plain ``join(on=by)``: keys first.
        return out.select(*by, *[c for c in df.columns if c not in by], median_name)
    return df.join(med, list(by), "inner")


# --- W26 -----------------------------------------------------------------------------------------
def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows by ``order`` (give a unique tie-break as the last key).

    Planned as TakeOrderedAndProject: each task keeps its own top k, the
    driver merges k × tasks rows.
    """
    return df.orderBy(*order).limit(k)


# --- W27 -----------------------------------------------------------------------------------------
def correlation(df: DataFrame, x: ColumnLike, y: Column, *, by: Cols = (), name: str = "corr",
                digits: int | None = 4, own_rows: bool = False) -> DataFrame:
    """Population Pearson r of ``x`` and ``y``, one pass, optionally per group.

    Rows where either side is NULL are dropped first; with ``own_rows`` each
    mean and deviation is taken over all rows where its own variable is not
    NULL, as the formula written out in SQL does. r = covar_pop /
    (stddev_pop(x) · stddev_pop(y)), NULL when either variance is zero (the
    built-in ``corr`` would raise under ANSI mode).
    """
    xx, yy = as_double(x), as_double(y)
    pairs = df.select(*by, xx.alias("_x"), yy.alias("_y"))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    covariance = F.covar_pop("_x", "_y")
    if own_rows:
        # Mean of (x - mean x)(y - mean y) over the pairs, the means over each variable's own rows.
        covariance = covariance + ((F.avg(F.when(both, F.col("_x"))) - F.avg("_x"))
                                   * (F.avg(F.when(both, F.col("_y"))) - F.avg("_y")))
    else:
        pairs = pairs.where(both)
    r = covariance / F.nullif(F.stddev_pop("_x") * F.stddev_pop("_y"), F.lit(0.0))
    r = r if digits is None else fround(r, digits)
    return pairs.groupBy(*by).agg(r.alias(name)) if by else pairs.agg(r.alias(name))
