"""Snapshots, scorecards, ratio rules and confusion matrices.

Everything here is per-row expression work plus, for the snapshot, one
equi-join; no Python runs in the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import compare, count_rows, count_where, fround, indicator, safe_div
from .rates import share


def asof_snapshot(
    left: DataFrame,
    hist: DataFrame,
    *,
    left_key: str,
    hist_key: str = "employee_id",
    date_col: str = "date_key",
    as_of: date,
    how: str = "left",
) -> DataFrame:
    """``left`` joined with the history rows dated exactly ``as_of``.

    The date condition is applied to the history *before* the join (it is a
    right-side-only ON condition); applied after a left join it would turn
    the join inner. The filter reaches the scan as a pushed predicate when the
    history is a table partitioned or sorted by date.
    """
    day = hist.where(F.col(date_col) == F.lit(as_of)).drop(date_col)
    if left_key == hist_key:
        return left.join(day, left_key, how)
    return left.join(day, F.col(left_key) == day[hist_key], how).drop(day[hist_key])


def points(rules: Sequence[tuple[str, str, object, int]]) -> Column:
    """W31 integer scorecard: sum of points of the rules that hold (NULL → 0).

    rules: (column, operator, value, points).
    """
    total = None
    for c, op, value, pts in rules:
        term = F.when(compare(c, op, value), F.lit(pts)).otherwise(F.lit(0))
        total = term if total is None else total + term
    return total


def weighted(features: Sequence[tuple[object, str, str, object]]) -> Column:
    """W31 weighted scorecard: Σ weight · [rule holds] in exact decimals.

    features: (Decimal weight, column, operator, value). Weights stay decimal
    so that a sum of 0.60 is exactly 0.60 when compared with a cut-off.
    """
    total = None
    for w, c, op, value in features:
        term = F.lit(w) * indicator(compare(c, op, value))
        total = term if total is None else total + term
    return total


def ratio_status(num: str, den: str, digits: int) -> Column:
    """Per-row num / NULLIF(den, 0) rounded (double)."""
    return fround(safe_div(num, den), digits)


def confusion_cell(predicted_pos: Column, actual: Column, positive: str, negative: str,
                   labels: tuple[str, str, str, str]) -> Column:
    """W33 per row: TP / FP / FN / TN label; anything else falls to the last label.

    labels: (true positive, false positive, false negative, true negative).
    """
    tp, fp, fn, tn = labels
    return (F.when(predicted_pos & (actual == positive), tp)
            .when(predicted_pos & (actual == negative), fp)
            .when(~predicted_pos & (actual == positive), fn)
            .otherwise(tn))


def confusion_matrix(df: DataFrame, predicted: str, actual: str, *, count_name: str = "count",
                     pct_name: str = "pct_of_total", digits: int = 2) -> DataFrame:
    """W33 summary: rows per (predicted, actual) and percent of all rows."""
    counts = df.groupBy(predicted, actual).agg(count_rows().alias(count_name))
    return share(df, [predicted, actual], count_name=count_name, shares=((pct_name, None),),
                 digits=digits, counts=counts)


def confusion_metrics(df: DataFrame, predicted_pos: Column, actual_pos: Column, *, digits: int = 4) -> DataFrame:
    """W33 summary figures in one pass: tp, fp, fn, tn, precision, recall, accuracy.

    NULL predictions or actuals count as negative, as the CASE labels do.
    """
    p = F.coalesce(predicted_pos, F.lit(False))
    a = F.coalesce(actual_pos, F.lit(False))
    out = df.agg(count_where(p & a).alias("tp"), count_where(p & ~a).alias("fp"),
                 count_where(~p & a).alias("fn"), count_where(~p & ~a).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select("tp", "fp", "fn", "tn",
                      fround(safe_div(tp, tp + fp), digits).alias("precision"),
                      fround(safe_div(tp, tp + fn), digits).alias("recall"),
                      fround(safe_div(tp + tn, tp + fp + fn + tn), digits).alias("accuracy"))
