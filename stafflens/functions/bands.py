"""Banding and code labels (W12) as CASE expressions.

``band`` is a searched CASE: rules are tried in order and the first match wins,
so rules must be listed from the lowest edge up. A NULL input matches no rule
and falls to the default, as in SQL. ``label`` is a simple CASE without ELSE:
unknown codes give NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ColumnLike, col, compare


def band(x: ColumnLike, rules: Sequence[tuple[str, object, str]], default: str | None) -> Column:
    """First-match banding: rules are (operator, edge, label)."""
    x = col(x)
    expr = None
    for op, edge, text in rules:
        cond = compare(x, op, edge)
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def label(code: ColumnLike, mapping: Mapping[object, str]) -> Column:
    """Code → text; codes not in ``mapping`` give NULL."""
    code = col(code)
    expr = None
    for key, text in mapping.items():
        cond = code == F.lit(key)
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr if expr is not None else F.lit(None).cast("string")


def tier(x: ColumnLike, cuts: Sequence[tuple[object, str]], default: str) -> Column:
    """Descending tiers: the first cut with x >= cut gives its label."""
    return band(x, [(">=", cut, text) for cut, text in cuts], default)
