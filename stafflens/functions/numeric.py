"""Column expressions for rates, guarded ratios and rounding.

All are built-in Spark expressions, so they stay inside whole-stage codegen.

Rounding rule: a double is first cast to DECIMAL(28,10) and then rounded half
away from zero, so binary noise in the 17th digit cannot move a tie (1.005 is
stored as 1.00499999...). The SQL oracles use the same rule.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dround(x: ColumnLike, digits: int) -> Column:
    """Round to ``digits`` through DECIMAL(28,10); result stays decimal."""
    return F.round(col(x).cast("decimal(28,10)"), digits)


def fround(x: ColumnLike, digits: int) -> Column:
    """Round to ``digits`` through DECIMAL(28,10); result is a double."""
    return dround(x, digits).cast("double")


def as_double(x: ColumnLike) -> Column:
    return col(x).cast("double")


def safe_div(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den as double; NULL when den is 0 or NULL (SQL ``NULLIF(den, 0)``)."""
    return as_double(num) / F.nullif(as_double(den), F.lit(0.0))


def pct(num: ColumnLike, den: ColumnLike) -> Column:
    """100 * num / den as double, NULL on a zero denominator."""
    return F.lit(100.0) * as_double(num) / F.nullif(as_double(den), F.lit(0.0))


def count_rows() -> Column:
    return F.count(F.lit(1))


def count_where(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)``: rows where cond is true (BIGINT)."""
    return F.count_if(cond)


def indicator(cond: Column) -> Column:
    """1.0 when cond is true, else 0.0 (NULL counts as false), as DECIMAL(2,1)."""
    return F.when(cond, F.lit(Decimal("1.0"))).otherwise(F.lit(Decimal("0.0")))


def compare(c: ColumnLike, op: str, value) -> Column:
    """Comparison by operator text, for rule tables."""
    c = col(c)
    if op == "<":
        return c < value
    if op == "<=":
        return c <= value
    if op == "=":
        return c == value
    if op == ">=":
        return c >= value
    if op == ">":
        return c > value
    raise ValueError(f"unknown operator {op!r}")
