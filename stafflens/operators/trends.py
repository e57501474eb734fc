"""Time-based operators.

Raw events and scores are aggregated first (partial aggregation before the
shuffle); windows then run over the aggregated series — months or years, whose
count is bounded by the calendar span, not by the row count. Per-employee
windows (W24) run over a filtered span of dates, so each window partition is
bounded by the number of dates in the span.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_rows, fround


def monthly_counts(events: DataFrame, *, event_type: str, date_col: str = "event_date",
                   type_col: str = "event_type", month: str = "month", count_name: str = "n") -> DataFrame:
    """Events of one type counted per calendar month (month as the first DATE)."""
    m = F.trunc(F.col(date_col), "month")
    return (events.where(F.col(type_col) == event_type)
            .groupBy(m.alias(month)).agg(count_rows().alias(count_name)))


def rolling_event_trend(
    events: DataFrame | None,
    *,
    event_type: str,
    count_name: str,
    rolling_sums: Sequence[tuple[str, int]] = (),
    rolling_means: Sequence[tuple[str, int, int]] = (),
    change_name: str | None = None,
    month: str = "month",
    gap_fill: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Monthly counts with trailing sums / means over the last k **rows**.

    rolling_sums: (name, k); rolling_means: (name, k, digits); change_name: the
    difference to the previous row (NULL for the first). Months without
    events are absent unless ``gap_fill`` inserts them with count 0 (then k
    rows are k calendar months). ``counts`` (month, count) may come in place of
    the events, for instance kept per source file; they are added up by month.
    """
    if counts is None:
        counts = monthly_counts(events, event_type=event_type, month=month, count_name=count_name)
    else:
        counts = counts.groupBy(month).agg(F.sum(count_name).cast("bigint").alias(count_name))
    if gap_fill:
        span = counts.agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
        months = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias(month))
        counts = months.join(counts, month, "left").fillna({count_name: 0})
    order = Window.orderBy(F.col(month).asc())
    out = counts
    for name, k in rolling_sums:
        out = out.withColumn(name, F.sum(count_name).over(order.rowsBetween(-(k - 1), Window.currentRow)))
    for name, k, digits in rolling_means:
        out = out.withColumn(
            name, fround(F.avg(F.col(count_name).cast("double")).over(order.rowsBetween(-(k - 1), Window.currentRow)),
                         digits))
    if change_name:
        out = out.withColumn(change_name, F.col(count_name) - F.lag(count_name).over(order))
    return out


def cohort_retention(members: DataFrame, events: DataFrame, *, as_of: date, event_type: str) -> DataFrame:
    """Per hire year: hired, left in the hire year, retained, retention %.

    Missing hire dates count in the as-of year. Exits are reduced to distinct
    (employee, year) pairs before the join, so an employee with many exit
    events adds one row, not a fan-out; the join is then at most one match per
    member and the distinct counts become plain counts.
    """
    hires = (members.select(
        "employee_id",
        F.year(F.coalesce(F.col("hire_date"), F.lit(as_of))).cast("int").alias("hire_year"))
        .distinct())
    exits = (events.where(F.col("event_type") == event_type)
             .select("employee_id", F.year("event_date").cast("int").alias("exit_year"))
             .distinct())
    joined = hires.join(
        exits, (hires.employee_id == exits.employee_id) & (hires.hire_year == exits.exit_year), "left")
    out = joined.groupBy("hire_year").agg(
        count_rows().alias("total_hired"),
        F.count(exits.employee_id).alias("exited_same_year"),
    )
    retained = F.col("total_hired") - F.col("exited_same_year")
    return out.select(
        "hire_year", "total_hired", "exited_same_year", retained.alias("retained"),
        fround(F.lit(100.0) * retained.cast("double") / F.nullif(F.col("total_hired").cast("double"), F.lit(0.0)), 2)
        .alias("retention_rate_pct"),
    )


def cohort_retention_bitmaps(members: DataFrame, events: DataFrame, *, as_of: date, event_type: str) -> DataFrame:
    """W15 by bitmaps: the result of ``cohort_retention`` from one shuffle and no join.

    Employees of a year and a range of 32,768 numbers are the bits of 4 KB: one map for
    those hired, one for those who left, one for either. What both hold is counted from
    the three. A task merges all its rows of a year and range before the shuffle, so a
    year or an employee with a third of the rows costs no more than another. For dense
    employee numbers; where a task would see few rows of each range, the pairs of
    ``cohort_retention`` are smaller. Rows without an employee count once a year.
    """
    hired = members.select(F.year(F.coalesce(F.col("hire_date"), F.lit(as_of))).cast("int").alias("hire_year"),
                           F.col("employee_id").cast("bigint").alias("id"), F.lit(True).alias("hired"))
    gone = (events.where(F.col("event_type") == event_type)
            .select(F.year("event_date").cast("int").alias("hire_year"), F.col("employee_id").cast("bigint").alias("id"),
                    F.lit(False).alias("hired")))
    rows = hired.unionByName(gone).select(
        "hire_year", "hired", F.col("id").isNull().alias("nobody"), F.bitmap_bucket_number("id").alias("bucket"),
        F.bitmap_bit_position("id").alias("bit"))
    maps = rows.groupBy("hire_year", "bucket").agg(
        *(F.bitmap_count(F.bitmap_construct_agg(bit)).alias(name) for name, bit in (
            ("n_hired", F.when(F.col("hired"), F.col("bit"))), ("n_gone", F.when(~F.col("hired"), F.col("bit"))), ("n_any", F.col("bit")))),
        F.max((F.col("nobody") & F.col("hired")).cast("int")).alias("n_nobody"))
    out = maps.groupBy("hire_year").agg(
        F.sum(F.col("n_hired") + F.col("n_nobody")).alias("total_hired"),
        F.sum(F.col("n_hired") + F.col("n_gone") - F.col("n_any")).alias("exited_same_year")).where("total_hired > 0")
    retained = F.col("total_hired") - F.col("exited_same_year")
    return out.select(
        "hire_year", "total_hired", "exited_same_year", retained.alias("retained"),
        fround(F.lit(100.0) * retained.cast("double") / F.nullif(F.col("total_hired").cast("double"), F.lit(0.0)), 2)
        .alias("retention_rate_pct"),
    )


def lag_trend(
    scores: DataFrame,
    *,
    key: str = "employee_id",
    t: str = "date_key",
    x: str = "performance_score",
    since: date | None = None,
    labels: tuple[str, str, str],
) -> DataFrame:
    """Previous value per key, delta, and Declining / Improving / Stable.

    The date filter is applied before LAG, so the first row in the span has
    no previous value and is labelled with the third (stable) label.
    """
    declining, improving, stable = labels
    s = scores.where(F.col(t) >= F.lit(since)) if since is not None else scores
    w = Window.partitionBy(key).orderBy(F.col(t).asc())
    prev = F.lag(x).over(w)
    out = s.select(key, t, x, prev.alias("prev_score"))
    delta = F.col(x) - F.col("prev_score")
    return out.select(
        key, t, x, "prev_score", delta.alias("delta"),
        F.when(delta < 0, declining).when(delta > 0, improving).otherwise(stable).alias("trend"),
    )


def first_last_change(scores: DataFrame, *, key: str = "employee_id", t: str = "date_key",
                      x: str = "performance_score") -> DataFrame:
    """First and latest value per key (by ``t``) in one grouped aggregate.

    ``min_by`` / ``max_by`` replace two full-frame windows + DISTINCT: one
    partial + final aggregate, no per-key sort, no hot-key task.
    """
    return scores.groupBy(key).agg(
        F.min_by(x, t).alias("first_score"),
        F.max_by(x, t).alias("latest_score"),
    )


def timeline_from_tenure(df: DataFrame, *, years: str, as_of: date, year_name: str = "hire_year",
                         count_name: str = "new_hires", running_name: str = "cumulative_headcount") -> DataFrame:
    """Estimated hire year (Jan 1 of as_of − years), hires per year, running total."""
    est = F.trunc(F.add_months(F.lit(as_of), F.col(years) * F.lit(-12)), "year")
    per_year = (df.where(F.col(years).isNotNull())
                .groupBy(est.alias(year_name)).agg(count_rows().alias(count_name)))
    w = Window.orderBy(F.col(year_name).asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return per_year.withColumn(running_name, F.sum(count_name).over(w))
