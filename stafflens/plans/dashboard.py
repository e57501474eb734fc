"""Executive attrition dashboard (W34): rate, context means and rank in one scan.

One grouped aggregate computes every per-department figure; the rank is a
window over the department rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_rows, count_where, fround, pct, safe_div
from ..operators.rates import rank_desc
from ..operators.stats import m_mean
from . import fixed_values as V


def exec_dashboard(staging: DataFrame, by: str = "Department") -> DataFrame:
    base = staging.groupBy(by).agg(
        count_rows().alias("total"),
        count_where(F.col("Attrition") == V.YES).alias("exits"),
        m_mean("MonthlyIncome", 0).alias("avg_income"),
        m_mean("JobSatisfaction", 2).alias("avg_satisfaction"),
        m_mean("YearsAtCompany", 1).alias("avg_tenure"),
        m_mean("WorkLifeBalance", 2).alias("avg_wlb"),
        m_mean("EnvironmentSatisfaction", 2).alias("avg_env_satisfaction"),
        count_where(F.col("OverTime") == V.YES).alias("_overtime"),
        m_mean("StockOptionLevel", 2).alias("avg_stock_level"),
    )
    ranked = base.withColumn("_ratio", safe_div("exits", "total"))
    return ranked.select(
        rank_desc("_ratio", "attrition_rank"),
        by, "total", "exits",
        fround(pct("exits", "total"), 2).alias("attrition_rate_pct"),
        "avg_income", "avg_satisfaction", "avg_tenure", "avg_wlb", "avg_env_satisfaction",
        fround(pct("_overtime", "total"), 1).alias("overtime_rate_pct"),
        "avg_stock_level",
    )
