"""The analyses as named DataFrame builders: key → f(spark, sf_dir) → DataFrame.

Each builder reads the driver tables through the HR projection and calls the
operators. Output column names and types are fixed per key (counts BIGINT,
rates and means DOUBLE, ranks and tiles INT, dates DATE). Every result carries
its presentation order, in row-level results with the employee as the last key,
so that ties have one order; a sort of many rows is range-partitioned.
"""

from __future__ import annotations

import calendar
import functools
from collections.abc import Callable
from contextvars import ContextVar
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import band, label, tier
from ..functions.numeric import count_where, fround, pct, safe_div
from ..operators import hierarchy, ranking, rates, scoring, stats, trends
from ..sources.fixtures import HrTables, tables_for
from . import fixed_values as V
from .dashboard import exec_dashboard

Builder = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Builder] = {}

_AS_OF: ContextVar[date] = ContextVar("as_of", default=V.AS_OF)


def as_of() -> date:
    """The date the analysis being built looks back from (the source's ``CURRENT_DATE``)."""
    return _AS_OF.get()


def register(key: str) -> Callable[[Builder], Builder]:
    """Add a builder; every key takes ``as_of`` (default: the fixture data's date)."""
    def deco(fn: Builder) -> Builder:
        @functools.wraps(fn)
        def build(spark: SparkSession, sf_dir: str, as_of: date | None = None) -> DataFrame:
            if as_of is None:
                return fn(spark, sf_dir)
            token = _AS_OF.set(as_of)
            try:
                return fn(spark, sf_dir)
            finally:
                _AS_OF.reset(token)
        CATALOG[key] = build
        return build
    return deco


def _t(spark: SparkSession, sf_dir: str) -> HrTables:
    """The HR tables behind ``sf_dir``: a registered source (e.g. a CSV snapshot)
    or the projection of the driver tables in that directory."""
    return tables_for(spark, sf_dir)


def left() -> Column:
    """Attrition = 'Yes'."""
    return F.col("Attrition") == V.YES


def _add_months(d: date, months: int) -> date:
    """Calendar month arithmetic, clamped to the month's last day (as ``add_months``)."""
    y, m = divmod(d.year * 12 + (d.month - 1) + months, 12)
    return date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


# =============================================================== A: attrition & retention
@register("q01_monthly_exits_rolling")
def q01(spark, sf_dir):
    out = trends.rolling_event_trend(
        _t(spark, sf_dir).retention_fact(), event_type=V.EXIT_EVENT, count_name="attrition_count",
        rolling_sums=[("rolling_12m_attrition", 12)], rolling_means=[("rolling_12m_avg", 12, 1)])
    return out.select("month", "attrition_count", "rolling_12m_attrition", "rolling_12m_avg").orderBy("month")


@register("q02_cohort_retention")
def q02(spark, sf_dir):
    t = _t(spark, sf_dir)
    return trends.cohort_retention(t.dim_employee_wide(), t.retention_fact(), as_of=as_of(),
                                   event_type=V.EXIT_EVENT).orderBy("hire_year")


@register("q03_rate_dept_gender")
def q03(spark, sf_dir):
    """Employees ⟕ exit events per (department, gender), fan-out counts without the fan-out."""
    t = _t(spark, sf_dir)
    exits = t.retention_fact().where(F.col("event_type") == V.EXIT_EVENT).select("employee_id")
    out = rates.event_rate(t.dim_employee_wide(), exits, ["department", "gender"])
    return out.orderBy(F.col("department").asc_nulls_last(), F.col("attrition_rate_pct").desc_nulls_first())


@register("q04_rate_marital")
def q04(spark, sf_dir):
    out = rates.ranked_group_rate(_t(spark, sf_dir).staging(), ["MaritalStatus"], left(),
                                  hits_name="attritions", rank_name="risk_rank")
    return out.orderBy(F.col("attrition_rate_pct").desc_nulls_first())


@register("q05_rate_overtime")
def q05(spark, sf_dir):
    out = rates.relative_rate(_t(spark, sf_dir).staging(), ["OverTime"], left(), baseline="min",
                              out_name="relative_risk_pct", out_digits=1, hits_name="attrition_count")
    return out.orderBy(F.col("attrition_rate_pct").desc_nulls_first())


@register("q06_rate_role_tenure")
def q06(spark, sf_dir):
    stg = _t(spark, sf_dir).staging().withColumn(
        "role_tenure_bucket", band("YearsInCurrentRole", V.ROLE_TENURE_BANDS, V.ROLE_TENURE_ELSE))
    return rates.group_rate(stg, ["role_tenure_bucket"], left(), hits_name="total_exits").orderBy("role_tenure_bucket")


@register("q07_rate_education_field")
def q07(spark, sf_dir):
    out = rates.relative_rate(_t(spark, sf_dir).staging(), ["EducationField"], left(), baseline="mean",
                              out_name="vs_org_avg_pct", out_digits=2, hits_name="attrited")
    return out.orderBy(F.col("attrition_rate_pct").desc_nulls_first())


@register("q08_rate_travel")
def q08(spark, sf_dir):
    out = rates.group_rate(_t(spark, sf_dir).staging(), ["BusinessTravel"], left(), hits_name="exits",
                           extra=[count_where(F.col("Attrition") == V.NO).alias("retained")])
    return (out.select("BusinessTravel", "total_employees", "exits", "retained", "attrition_rate_pct")
            .orderBy(F.col("attrition_rate_pct").desc_nulls_first()))


@register("q09_rate_stock_level")
def q09(spark, sf_dir):
    out = rates.relative_rate(_t(spark, sf_dir).staging(), ["StockOptionLevel"], left(), baseline="first",
                              order_by="StockOptionLevel", out_name="vs_level0_multiplier", out_digits=2)
    return out.orderBy(F.col("StockOptionLevel").asc_nulls_last())


@register("q10_rate_education")
def q10(spark, sf_dir):
    out = rates.group_rate(_t(spark, sf_dir).staging(), ["Education"], left(), hits_name="exits")
    out = out.withColumn("education_label", label("Education", V.EDUCATION_LABELS))
    return (out.select("Education", "education_label", "total_employees", "exits", "attrition_rate_pct")
            .orderBy(F.col("Education").asc_nulls_last()))


@register("q11_rolling_3m")
def q11(spark, sf_dir):
    out = trends.rolling_event_trend(
        _t(spark, sf_dir).retention_fact(), event_type=V.EXIT_EVENT, count_name="exits",
        rolling_means=[("rolling_3m_avg", 3, 2), ("rolling_12m_avg", 12, 2)], change_name="mom_change")
    return out.orderBy("month")


def _flight_risk_base(t: HrTables) -> DataFrame:
    stg = t.staging().select("EmployeeNumber", "YearsAtCompany", "OverTime", "JobSatisfaction", "MonthlyIncome")
    de = t.dim_employee_wide().select("employee_id", "department", "role")
    base = de.join(stg, de.employee_id == stg.EmployeeNumber, "inner").drop("EmployeeNumber")
    snap = scoring.asof_snapshot(base, t.performance_fact(), left_key="employee_id", as_of=as_of())
    return snap


@register("q12_flight_risk")
def q12(spark, sf_dir):
    snap = _flight_risk_base(_t(spark, sf_dir))
    risk = scoring.points([
        ("performance_score", "<", 3, V.RISK_POINTS_LOW_SCORE),
        ("YearsAtCompany", "<", 2, V.RISK_POINTS_SHORT_TENURE),
        ("OverTime", "=", V.YES, V.RISK_POINTS_OVERTIME),
        ("JobSatisfaction", "<=", 2, V.RISK_POINTS_LOW_SATISFACTION),
    ])
    out = snap.select("employee_id", "department", "role", "YearsAtCompany", "performance_score", "OverTime",
                      "JobSatisfaction", "MonthlyIncome", risk.alias("risk_score"))
    out = out.withColumn("risk_segment", tier("risk_score", V.RISK_TIERS, V.RISK_TIER_ELSE))
    return out.orderBy(F.col("risk_score").desc_nulls_first(), F.col("employee_id").asc())


# =============================================================== B: performance
def _snapshot_scores(t: HrTables) -> DataFrame:
    return t.performance_fact().where(F.col("date_key") == F.lit(as_of()))


@register("q13_rank_in_role")
def q13(spark, sf_dir):
    t = _t(spark, sf_dir)
    rows = _snapshot_scores(t).join(t.dim_employee_wide(), "employee_id", "inner").select(
        "employee_id", "department", "role", "performance_score")
    out = ranking.rank_within(rows, "role", "performance_score", rank_name="role_rank", mean_name="_mean",
                              salt_from=["employee_id"])
    rounded = F.round(F.col("_mean").cast("decimal(28,10)"), 2)
    return out.select(
        "employee_id", "department", "role", "performance_score", "role_rank",
        rounded.cast("double").alias("role_avg_score"),
        (F.col("performance_score").cast("decimal(28,10)") - rounded).cast("double").alias("vs_role_avg"),
    ).orderBy(F.col("role").asc_nulls_last(), F.col("role_rank").asc(), F.col("employee_id").asc())


@register("q14_score_distribution")
def q14(spark, sf_dir):
    snap = _snapshot_scores(_t(spark, sf_dir))
    out = rates.share(snap, ["performance_score"], count_name="employee_count", shares=(("pct_of_total", None),))
    bar = F.repeat(F.lit(V.BAR_BLOCK), F.floor(F.col("employee_count") / V.BAR_UNIT).cast("int"))
    return out.withColumn("bar_chart", bar).orderBy(F.col("performance_score").desc_nulls_first())


def _score_moments(t: HrTables) -> DataFrame:
    """Score history reduced to one row per employee (rows, count, Σ, Σ²) before any join."""
    return stats.key_moments(t.performance_fact(), "employee_id", "performance_score")


@register("q15_role_vs_dept")
def q15(spark, sf_dir):
    t = _t(spark, sf_dir)
    rows = _score_moments(t).join(t.dim_employee_wide().select("employee_id", "department", "role"),
                                  "employee_id", "inner")
    agg = stats.group_profile(rows, ["department", "role"], [
        ("_mean", stats.mm_mean()),
        ("employee_count", stats.m_count()),
    ])
    gap = stats.vs_parent_mean(agg, "_mean", ["department"])
    out = agg.select(
        "department", "role", fround("_mean", 2).alias("avg_score"), "employee_count",
        fround(gap, 2).alias("diff_from_dept_avg"),
        F.when(gap < V.ROLE_GAP_CUTOFF, V.ROLE_GAP_FLAG).otherwise(V.ROLE_GAP_OK).alias("flag"),
    )
    return out.orderBy(F.col("department").asc_nulls_last(), F.col("avg_score").desc_nulls_first())


@register("q16_score_delta")
def q16(spark, sf_dir):
    return trends.lag_trend(_t(spark, sf_dir).performance_fact(), since=_add_months(as_of(), -24),
                            labels=(V.TREND_DECLINING, V.TREND_IMPROVING, V.TREND_STABLE)
                            ).orderBy(F.col("employee_id").asc_nulls_last(), F.col("date_key").asc_nulls_last())


@register("q17_decile_extremes")
def q17(spark, sf_dir):
    t = _t(spark, sf_dir)
    stg = t.staging().select(F.col("EmployeeNumber").alias("employee_id"), "YearsAtCompany")
    rows = (_snapshot_scores(t).join(t.dim_employee_wide().select("employee_id", "department", "role"),
                                     "employee_id", "inner")
            .join(stg, "employee_id", "inner")
            .select("employee_id", "department", "role", "performance_score", "YearsAtCompany"))
    order = [F.col("performance_score").desc_nulls_first(), F.col("employee_id").asc()]
    tiles = ranking.global_ntile(rows, order, V.DECILES, "decile")
    band_ = (F.when(F.col("decile") == 1, V.DECILE_TOP).when(F.col("decile") == V.DECILES, V.DECILE_BOTTOM)
             .otherwise(V.DECILE_MID))
    out = tiles.where(F.col("decile").isin(1, V.DECILES)).withColumn("performance_band", band_)
    return out.orderBy(F.col("decile").asc(), F.col("performance_score").desc_nulls_first(), F.col("employee_id").asc())


@register("q18_score_by_tenure")
def q18(spark, sf_dir):
    rows = _moments_with_staging(_t(spark, sf_dir), "YearsAtCompany").withColumn(
        "tenure_bucket", band("YearsAtCompany", V.TENURE_BANDS, V.TENURE_ELSE))
    out = stats.group_profile(rows, ["tenure_bucket"], [
        ("avg_performance_score", stats.mm_mean(2)),
        ("employee_count", stats.m_count()),
        ("score_stddev", stats.mm_sd(3)),
    ])
    return out.orderBy("tenure_bucket")


def _moments_with_staging(t: HrTables, *cols: str) -> DataFrame:
    """Per-employee score moments joined 1:1 to the staging columns."""
    stg = t.staging().select(F.col("EmployeeNumber").alias("employee_id"), *cols)
    return _score_moments(t).join(stg, "employee_id", "inner")


@register("q19_score_by_training")
def q19(spark, sf_dir):
    rows = _moments_with_staging(_t(spark, sf_dir), "TrainingTimesLastYear")
    agg = stats.group_profile(rows, ["TrainingTimesLastYear"], [
        ("_mean", stats.mm_mean()), ("employee_count", stats.mm_rows())])
    out = agg.select("TrainingTimesLastYear", fround("_mean", 2).alias("avg_performance"), "employee_count",
                     fround(stats.vs_parent_mean(agg, "_mean"), 3).alias("vs_overall_avg"))
    return out.orderBy(F.col("TrainingTimesLastYear").asc_nulls_last())


@register("q20_score_by_satisfaction")
def q20(spark, sf_dir):
    rows = _moments_with_staging(_t(spark, sf_dir), "JobSatisfaction", "Attrition")
    rows_left = F.sum(F.when(left(), F.col("_rows")).otherwise(F.lit(0)))
    out = stats.group_profile(rows, ["JobSatisfaction"], [
        ("avg_performance", stats.mm_mean(2)), ("employee_count", stats.mm_rows()),
        ("attrited_count", rows_left)])
    out = out.withColumn("attrition_rate_pct", fround(pct("attrited_count", "employee_count"), 2))
    return out.orderBy(F.col("JobSatisfaction").desc_nulls_first())


@register("q21_rating_by_dept")
def q21(spark, sf_dir):
    out = stats.group_profile(_t(spark, sf_dir).staging(), ["Department"], [
        ("avg_performance_rating", stats.m_mean("PerformanceRating", 2)),
        ("employee_count", stats.m_count()),
        ("min_rating", stats.m_min("PerformanceRating")),
        ("max_rating", stats.m_max("PerformanceRating")),
        ("rating_stddev", stats.m_sd("PerformanceRating", 3)),
    ])
    return out.orderBy(F.col("avg_performance_rating").desc_nulls_first())


@register("q22_declining")
def q22(spark, sf_dir):
    t = _t(spark, sf_dir)
    fl = trends.first_last_change(t.performance_fact()).where(F.col("latest_score") < F.col("first_score"))
    change = F.col("latest_score") - F.col("first_score")
    out = fl.join(t.dim_employee_wide().select("employee_id", "department", "role"), "employee_id", "inner").select(
        "employee_id", "department", "role", "first_score", "latest_score", change.alias("score_change"),
        F.when(change <= -2, V.DECLINE_SIGNIFICANT).when(change == -1, V.DECLINE_MILD)
        .otherwise(V.DECLINE_OTHER).alias("decline_severity"),
    )
    return out.orderBy(F.col("score_change").asc_nulls_last(), F.col("employee_id").asc())


# =============================================================== C: compensation & equity
@register("q23_salary_by_dept_role")
def q23(spark, sf_dir):
    x = "MonthlyIncome"
    prof = stats.group_profile(_t(spark, sf_dir).staging(), ["Department", "JobRole"], [
        ("avg_monthly_income", stats.m_mean(x, 0)), ("min_income", stats.m_min(x)), ("max_income", stats.m_max(x)),
        ("income_range", stats.m_range(x)), ("employee_count", stats.m_count()), ("cv_pct", stats.m_cv_pct(x, 1)),
    ])
    return stats.top_k(prof, [F.col("avg_monthly_income").desc_nulls_first(), F.col("Department").asc_nulls_last(),
                              F.col("JobRole").asc_nulls_last()], 15)


@register("q24_salary_percentiles")
def q24(spark, sf_dir):
    t, names = _t(spark, sf_dir), ["_p10", "_p25", "_p50", "_p75", "_p90"]
    pb = stats.percentile_bands(t.staging(), ["Department"], "MonthlyIncome",
                                [0.10, 0.25, 0.50, 0.75, 0.90], names,
                                extra=[stats.m_mean("MonthlyIncome", 0).alias("avg_salary")],
                                select=t.n_staging() > stats.MAX_VALUES)
    out = pb.select(
        "Department", fround("_p10", 0).alias("p10_salary"), fround("_p25", 0).alias("p25_salary"),
        fround("_p50", 0).alias("median_salary"), fround("_p75", 0).alias("p75_salary"),
        fround("_p90", 0).alias("p90_salary"), "avg_salary", fround(F.col("_p75") - F.col("_p25"), 0).alias("iqr"))
    return out.orderBy(F.col("median_salary").desc_nulls_first())


@register("q25_pay_gap")
def q25(spark, sf_dir):
    g = rates.two_group_gap(_t(spark, sf_dir).staging(), ["JobRole"], "Gender", V.MALE, V.FEMALE, "MonthlyIncome",
                            names={"n": "total_employees", "n_a": "male_count", "n_b": "female_count",
                                   "mean_a": "_m", "mean_b": "_f"})
    gap = F.col("_m") - F.col("_f")
    out = g.select(
        "JobRole", "total_employees", "male_count", "female_count",
        fround("_m", 0).alias("avg_male_income"), fround("_f", 0).alias("avg_female_income"),
        fround(gap, 0).alias("pay_gap_amount"),
        fround(F.lit(100.0) * gap / F.nullif(F.col("_m"), F.lit(0.0)), 2).alias("gap_pct"),
        F.when(F.abs(gap) > V.PAY_GAP_TOLERANCE, V.PAY_GAP_REVIEW).otherwise(V.PAY_GAP_OK).alias("equity_flag"),
    )
    return out.orderBy(F.abs(F.col("pay_gap_amount")).desc_nulls_last())


@register("q26_hike_by_dept")
def q26(spark, sf_dir):
    x = "PercentSalaryHike"
    agg = stats.group_profile(_t(spark, sf_dir).staging(), ["Department"], [
        ("_mean", stats.m_mean(x)), ("min_hike", stats.m_min(x)), ("max_hike", stats.m_max(x))])
    out = agg.select("Department", fround("_mean", 2).alias("avg_hike_pct"), "min_hike", "max_hike",
                     fround(stats.vs_parent_mean(agg, "_mean"), 2).alias("vs_org_avg"))
    return out.orderBy(F.col("avg_hike_pct").desc_nulls_first())


@register("q27_hike_by_field")
def q27(spark, sf_dir):
    out = stats.group_profile(_t(spark, sf_dir).staging(), ["EducationField"], [
        ("avg_hike_pct", stats.m_mean("PercentSalaryHike", 2)), ("employee_count", stats.m_count()),
        ("avg_income", stats.m_mean("MonthlyIncome", 0))])
    return out.orderBy(F.col("avg_hike_pct").desc_nulls_first())


@register("q28_below_median")
def q28(spark, sf_dir):
    t = _t(spark, sf_dir)
    stg = t.staging().select("EmployeeNumber", "Department", "JobRole", "MonthlyIncome", "Attrition")
    rows = stats.vs_group_median(stg, ["Department"], "MonthlyIncome", median_name="_median",
                                 salt_from=["EmployeeNumber"], select=t.n_staging() > stats.MAX_VALUES)
    x, med = F.col("MonthlyIncome"), F.col("_median")
    return rows.select(
        "EmployeeNumber", "Department", "JobRole", "MonthlyIncome",
        fround(med, 0).alias("dept_median"), fround(x - med, 0).alias("diff_from_median"),
        F.when(x < med, V.BELOW_MEDIAN).otherwise(V.AT_OR_ABOVE).alias("pay_status"),
        F.col("Attrition").alias("already_left"),
    ).orderBy(F.col("diff_from_median").asc_nulls_last(), F.col("EmployeeNumber").asc())


@register("q29_stock_by_dept")
def q29(spark, sf_dir):
    x = "StockOptionLevel"
    out = rates.group_rate(_t(spark, sf_dir).staging(), ["Department"], left(), n_name="employee_count",
                           hits_name="_hits",
                           extra=[stats.m_sum(x).alias("total_stock_options"),
                                  stats.m_mean(x, 2).alias("avg_stock_level")])
    return (out.select("Department", "total_stock_options", "avg_stock_level", "employee_count",
                       "attrition_rate_pct").orderBy(F.col("avg_stock_level").desc_nulls_first()))


@register("q30_rates_by_dept")
def q30(spark, sf_dir):
    out = stats.group_profile(_t(spark, sf_dir).staging(), ["Department"], [
        ("avg_daily_rate", stats.m_mean("DailyRate", 0)), ("avg_hourly_rate", stats.m_mean("HourlyRate", 0)),
        ("implied_hours_per_day", stats.m_ratio_of_means("DailyRate", "HourlyRate", 1))])
    return out.orderBy(F.col("avg_daily_rate").desc_nulls_first())


@register("q31_income_brackets")
def q31(spark, sf_dir):
    stg = _t(spark, sf_dir).staging().withColumn(
        "income_bracket", band("MonthlyIncome", V.INCOME_BANDS, V.INCOME_ELSE))
    out = rates.group_rate(stg, ["income_bracket"], left(), hits_name="attritions",
                           extra=[stats.m_mean("MonthlyIncome", 0).alias("avg_income_in_bracket")])
    return (out.select("income_bracket", "total_employees", "attritions", "attrition_rate_pct",
                       "avg_income_in_bracket").orderBy("income_bracket"))


# =============================================================== D: demographics
@register("q32_level_share")
def q32(spark, sf_dir):
    out = rates.share(_t(spark, sf_dir).staging(), ["Department", "JobLevel"], count_name="employee_count",
                      shares=(("pct_of_dept", ["Department"]),))
    out = out.withColumn("level_label", label("JobLevel", V.JOB_LEVEL_LABELS))
    return (out.select("Department", "JobLevel", "level_label", "employee_count", "pct_of_dept")
            .orderBy(F.col("Department").asc_nulls_last(), F.col("JobLevel").asc_nulls_last()))


@register("q33_gender_balance")
def q33(spark, sf_dir):
    g = rates.two_group_gap(_t(spark, sf_dir).staging(), ["JobRole"], "Gender", V.MALE, V.FEMALE,
                            names={"n": "total", "n_a": "male_count", "n_b": "female_count"})
    share_ = pct("female_count", "total")
    out = g.select(
        "JobRole", "total", "male_count", "female_count", fround(share_, 2).alias("female_pct"),
        F.when(share_ < V.FEMALE_SHARE_LOW, V.MALE_SKEWED).when(share_ > V.FEMALE_SHARE_HIGH, V.FEMALE_SKEWED)
        .otherwise(V.BALANCED).alias("gender_balance_flag"))
    return out.orderBy(F.col("female_pct").asc_nulls_last())


@register("q34_marital_crosstab")
def q34(spark, sf_dir):
    out = rates.share(_t(spark, sf_dir).staging(), ["MaritalStatus", "Attrition"], count_name="employee_count",
                      shares=(("pct_within_marital_status", ["MaritalStatus"]), ("pct_of_total", None)))
    return out.orderBy(F.col("MaritalStatus").asc_nulls_last(), F.col("Attrition").asc_nulls_last())


@register("q35_most_tenured")
def q35(spark, sf_dir):
    stg = _t(spark, sf_dir).staging()
    top = stats.top_k(stg, [F.col("YearsAtCompany").desc_nulls_first(), F.col("EmployeeNumber").asc()], 10)
    return top.select(
        F.col("EmployeeNumber").alias("employee_id"), "Department", "JobRole", "YearsAtCompany",
        "YearsInCurrentRole", "YearsSinceLastPromotion", "PerformanceRating",
        fround(pct("YearsInCurrentRole", "YearsAtCompany"), 1).alias("pct_time_in_current_role"))


@register("q36_commute")
def q36(spark, sf_dir):
    x = "DistanceFromHome"
    out = stats.group_profile(_t(spark, sf_dir).staging(), ["Department"], [
        ("avg_distance", stats.m_mean(x, 1)), ("max_distance", stats.m_max(x)), ("min_distance", stats.m_min(x)),
        ("distance_stddev", stats.m_sd(x, 1)), ("pct_long_commute", stats.m_share_pct(F.col(x) > V.LONG_COMMUTE, 1))])
    return out.orderBy(F.col("avg_distance").desc_nulls_first())


@register("q37_wlb_overtime")
def q37(spark, sf_dir):
    out = rates.group_rate(_t(spark, sf_dir).staging(), ["Department", "OverTime"], left(), n_name="employee_count",
                           hits_name="_hits", digits=1,
                           extra=[stats.m_mean("WorkLifeBalance", 2).alias("avg_wlb_score")])
    return (out.select("Department", "OverTime", "avg_wlb_score", "employee_count", "attrition_rate_pct")
            .orderBy(F.col("Department").asc_nulls_last(), F.col("avg_wlb_score").asc_nulls_last()))


@register("q38_manager_tenure")
def q38(spark, sf_dir):
    agg = stats.group_profile(_t(spark, sf_dir).staging(), ["Department"], [
        ("_mgr", stats.m_mean("YearsWithCurrManager")), ("_ten", stats.m_mean("YearsAtCompany"))])
    ratio = safe_div("_mgr", "_ten")
    out = agg.select(
        "Department", fround("_mgr", 2).alias("avg_years_with_manager"), fround("_ten", 2).alias("avg_tenure"),
        fround(ratio, 2).alias("manager_tenure_ratio"),
        F.when(ratio < float(V.STABILITY_CUTOFF), V.STABILITY_RISK).otherwise(V.STABILITY_OK).alias("stability_flag"))
    return out.orderBy(F.col("avg_years_with_manager").desc_nulls_first())


# =============================================================== E: advanced analytics
def _attrition_indicator() -> Column:
    return F.when(left(), F.lit(1.0)).otherwise(F.lit(0.0))


@register("q39_corr_distance")
def q39(spark, sf_dir):
    r = stats.correlation(_t(spark, sf_dir).staging(), "DistanceFromHome", _attrition_indicator(),
                          name="corr_distance_vs_attrition", own_rows=True)
    return r.withColumn("interpretation", F.lit(V.CORR_DISTANCE_TEXT))


@register("q40_corr_income")
def q40(spark, sf_dir):
    r = stats.correlation(_t(spark, sf_dir).staging(), "MonthlyIncome", _attrition_indicator(),
                          name="corr_income_vs_attrition", own_rows=True)
    return r.withColumn("interpretation", F.lit(V.CORR_INCOME_TEXT))


@register("q41_org_depth")
def q41(spark, sf_dir):
    t = _t(spark, sf_dir)
    nodes = t.dim_employee_wide().select("employee_id", "manager_id", "role", "department")
    out = hierarchy.hierarchy_depth(nodes, materialize_input=not t.materialize)
    return out.select("employee_id", "role", "department", F.col("depth").cast("int").alias("depth")).orderBy(
        F.col("depth").asc(), F.col("employee_id").asc_nulls_last())


@register("q42_promotion_lag")
def q42(spark, sf_dir):
    stg = _t(spark, sf_dir).staging()
    ysl, rating = F.col("YearsSinceLastPromotion"), F.col("PerformanceRating")
    lo, hi = V.PROMOTION_WATCH
    status = (F.when((ysl >= V.PROMOTION_OVERDUE_YEARS) & (rating >= V.PROMOTION_RATING_CUT), V.PROMOTION_OVERDUE)
              .when((ysl >= V.PROMOTION_OVERDUE_YEARS) & (rating < V.PROMOTION_RATING_CUT), V.PROMOTION_STAGNANT)
              .when(ysl.between(lo, hi), V.PROMOTION_WATCH_LIST).otherwise(V.PROMOTION_ON_TRACK))
    return stg.select(
        "EmployeeNumber", "Department", "JobRole", "JobLevel", "YearsAtCompany", "YearsSinceLastPromotion",
        "PerformanceRating",
        scoring.ratio_status("YearsSinceLastPromotion", "YearsAtCompany", 2).alias("promotion_lag_ratio"),
        status.alias("promotion_status")).orderBy(
            F.col("YearsSinceLastPromotion").desc_nulls_first(), F.col("PerformanceRating").desc_nulls_first(),
            F.col("EmployeeNumber").asc())


@register("q43_rate_environment")
def q43(spark, sf_dir):
    out = rates.group_rate(_t(spark, sf_dir).staging(), ["EnvironmentSatisfaction"], left(),
                           n_name="employee_count", hits_name="attritions")
    out = out.withColumn("satisfaction_label", label("EnvironmentSatisfaction", V.ENVIRONMENT_LABELS))
    return (out.select("EnvironmentSatisfaction", "satisfaction_label", "employee_count", "attritions",
                       "attrition_rate_pct").orderBy(F.col("EnvironmentSatisfaction").desc_nulls_first()))


_ENGAGEMENT = ["JobSatisfaction", "EnvironmentSatisfaction", "RelationshipSatisfaction", "WorkLifeBalance"]


def _engagement_index() -> Column:
    c = [F.col(x) for x in _ENGAGEMENT]
    return c[0] + c[1] + c[2] + c[3]


@register("q44_team_health")
def q44(spark, sf_dir):
    cols = ["RelationshipSatisfaction", "JobInvolvement", "JobSatisfaction", "WorkLifeBalance"]
    out = stats.group_profile(_t(spark, sf_dir).staging(), ["Department"], [
        ("avg_rel_satisfaction", stats.m_mean(cols[0], 2)), ("avg_job_involvement", stats.m_mean(cols[1], 2)),
        ("avg_job_satisfaction", stats.m_mean(cols[2], 2)), ("avg_wlb", stats.m_mean(cols[3], 2)),
        ("team_health_score", stats.m_mean_of_means(cols, 2))])
    return out.orderBy(F.col("team_health_score").asc_nulls_last())


@register("q45_engagement")
def q45(spark, sf_dir):
    idx = _engagement_index()
    engagement = F.col("engagement_index")
    return _t(spark, sf_dir).staging().select(
        "EmployeeNumber", "Department", "JobRole", "Attrition", *_ENGAGEMENT, idx.alias("engagement_index")
    ).select(
        "*",
        fround(engagement.cast("double") / float(V.ENGAGEMENT_MAX) * 100.0, 1).alias("engagement_pct"),
        tier(engagement, V.ENGAGEMENT_BANDS, V.ENGAGEMENT_ELSE).alias("engagement_band")).orderBy(
            F.col("engagement_index").asc_nulls_last(), F.col("EmployeeNumber").asc())


@register("q46_engagement_by_dept")
def q46(spark, sf_dir):
    agg = stats.group_profile(_t(spark, sf_dir).staging(), ["Department", "Attrition"], [
        ("_mean", stats.m_mean(_engagement_index())), ("employee_count", stats.m_count())])
    out = agg.select("Department", "Attrition", fround("_mean", 2).alias("avg_engagement_index"), "employee_count",
                     fround(stats.vs_parent_mean(agg, "_mean", ["Department"]), 2).alias("vs_dept_avg"))
    return out.orderBy(F.col("Department").asc_nulls_last(), F.col("Attrition").asc_nulls_last())


@register("q47_hire_timeline")
def q47(spark, sf_dir):
    return trends.timeline_from_tenure(_t(spark, sf_dir).staging(), years="YearsAtCompany",
                                       as_of=as_of()).orderBy("hire_year")


@register("q48_job_hopping")
def q48(spark, sf_dir):
    stg = _t(spark, sf_dir).staging().withColumn(
        "job_hopping_band", band("NumCompaniesWorked", V.JOB_HOP_BANDS, V.JOB_HOP_ELSE))
    out = rates.group_rate(stg, ["job_hopping_band"], left(), hits_name="attritions",
                           extra=[stats.m_mean("YearsAtCompany", 1).alias("avg_tenure_here")])
    return (out.select("job_hopping_band", "total_employees", "attritions", "attrition_rate_pct",
                       "avg_tenure_here").orderBy("job_hopping_band"))


@register("q49_dashboard")
def q49(spark, sf_dir):
    return exec_dashboard(_t(spark, sf_dir).staging()).orderBy("attrition_rank", "Department")


@register("q50_risk_proxy")
def q50(spark, sf_dir):
    t = _t(spark, sf_dir)
    stg = t.staging().select("EmployeeNumber", "Department", "JobRole", "Attrition", "MonthlyIncome",
                             "YearsAtCompany", "OverTime", "JobSatisfaction", "StockOptionLevel", "WorkLifeBalance",
                             "EnvironmentSatisfaction", "NumCompaniesWorked")
    snap = scoring.asof_snapshot(stg, t.performance_fact(), left_key="EmployeeNumber", as_of=as_of())
    proxy = F.round(scoring.weighted(V.PROXY_FEATURES), 3)
    scored = snap.select("EmployeeNumber", "Department", "JobRole", F.col("Attrition").alias("actual_attrition"),
                         "MonthlyIncome", "YearsAtCompany", proxy.alias("_p"))
    p = F.col("_p")
    positive = p >= F.lit(V.PROXY_MEDIUM)
    return scored.select(
        "EmployeeNumber", "Department", "JobRole", "actual_attrition", "MonthlyIncome", "YearsAtCompany",
        p.cast("double").alias("attrition_prob_proxy"),
        F.when(p >= F.lit(V.PROXY_HIGH), V.PROXY_HIGH_LABEL).when(positive, V.PROXY_MEDIUM_LABEL)
        .otherwise(V.PROXY_LOW_LABEL).alias("predicted_risk_level"),
        scoring.confusion_cell(positive, F.col("actual_attrition"), V.YES, V.NO,
                               (V.TRUE_POSITIVE, V.FALSE_POSITIVE, V.FALSE_NEGATIVE, V.TRUE_NEGATIVE))
        .alias("model_accuracy_check")).orderBy(
            F.col("attrition_prob_proxy").desc_nulls_first(), F.col("EmployeeNumber").asc())


@register("qb_confusion")
def qb(spark, sf_dir):
    stg = _t(spark, sf_dir).staging()
    score = scoring.weighted(V.PROXY_FEATURES[:7])
    rows = stg.select(
        F.when(score >= F.lit(V.PROXY_MEDIUM), V.PREDICTED_YES).otherwise(V.PREDICTED_NO).alias("predicted"),
        F.col("Attrition").alias("actual"))
    out = scoring.confusion_matrix(rows, "predicted", "actual", count_name="count", pct_name="pct_of_total")
    return out.orderBy(F.col("predicted").asc_nulls_last(), F.col("actual").asc_nulls_last())


# =============================================================== the operators' further forms
@register("pay_ratio_percentiles")
def pay_ratio_percentiles(spark, sf_dir):
    """W19 on a continuous measure (days of pay in a month's income), by selection."""
    names = ["p10", "p25", "p50", "p75", "p90"]
    stg = _t(spark, sf_dir).staging().select("Department", safe_div(F.col("MonthlyIncome").cast("double"), F.col("DailyRate").cast("double")).alias("_ratio"))
    out = stats.percentile_bands(stg, ["Department"], "_ratio", [0.10, 0.25, 0.50, 0.75, 0.90], names,
                                 extra=[F.count("_ratio").alias("employees")], select=True)
    return out.select("Department", "employees", *[fround(n, 4).alias(n) for n in names]).orderBy(F.col("Department").asc_nulls_last())


@register("hierarchy_problems")
def hierarchy_problems(spark, sf_dir):
    """W28 on a manager column with cycles and missing managers, derived from staging."""
    n = F.col("EmployeeNumber")
    boss = F.when(n % 97 != 0, (n * 31 + F.col("MonthlyIncome")) % 2003)
    nodes = _t(spark, sf_dir).staging().select(n.alias("employee_id"), boss.cast("bigint").alias("manager_id"))
    return hierarchy.hierarchy_problems(nodes).orderBy("node")


@register("load_changes")
def load_changes(spark, sf_dir):
    """W04/W08 loaded twice: employees per kind of change between the two stored versions."""
    from ..sources.versions import compare_rows
    from .incremental import changed_twice
    table = changed_twice(_t(spark, sf_dir))
    kinds = compare_rows(table.read(1), table.read(2), "EmployeeNumber")
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("employees")).orderBy("kind")


@register("load_key_registry")
def load_key_registry(spark, sf_dir):
    """W05 over two loads: keys of the first load stay, the second one's new employees follow on."""
    from .incremental import keys_twice
    return keys_twice(_t(spark, sf_dir)).read().orderBy("employee_key")


@register("exits_trend_by_file")
def exits_trend_by_file(spark, sf_dir):
    """W14 from month counts kept per file of orders; a new file is counted, the others are not read."""
    from .incremental import exits_by_file
    out = trends.rolling_event_trend(
        None, event_type=V.EXIT_EVENT, count_name="attrition_count", counts=exits_by_file(_t(spark, sf_dir)),
        rolling_sums=[("rolling_12m_attrition", 12)], rolling_means=[("rolling_12m_avg", 12, 1)])
    return out.select("month", "attrition_count", "rolling_12m_attrition", "rolling_12m_avg").orderBy("month")


@register("cohort_retention_bitmaps")
def cohort_retention_bitmaps(spark, sf_dir):
    """W15 with the distinct employees of each year as bitmaps."""
    t = _t(spark, sf_dir)
    out = trends.cohort_retention_bitmaps(t.dim_employee_wide(), t.retention_fact(), as_of=as_of(), event_type=V.EXIT_EVENT)
    return out.orderBy("hire_year")


@register("score_review")
def score_review(spark, sf_dir):
    """W30 and W16 per employee, joined as the bucketed tables lie: no exchange below the final order."""
    from ..sources.bucketed import BucketedTables
    t = _t(spark, sf_dir)
    t = BucketedTables(spark, sf_dir) if type(t) is HrTables else t
    history = t.performance_fact().groupBy("employee_id").agg(
        F.count(F.lit(1)).alias("n_scores"), fround(F.avg("performance_score"), 4).alias("mean_score"),
        F.max("performance_score").alias("best_score"))
    base = t.staging().select(F.col("EmployeeNumber").alias("employee_id"), F.col("JobRole").alias("role"), F.col("YearsAtCompany").alias("years"))
    out = scoring.asof_snapshot(base.join(history, "employee_id", "left"), t.performance_fact(), left_key="employee_id", as_of=as_of())
    return out.select("employee_id", "role", "years", F.coalesce("n_scores", F.lit(0)).cast("bigint").alias("n_scores"), "mean_score", "best_score",
                      F.col("performance_score").alias("score_now")).orderBy("employee_id")


@register("load_csv_folder")
def load_csv_folder(spark, sf_dir):
    """W01 over a folder whose files have different headers; every row is bound by its own file's names."""
    from ..sources.fixtures import stored_path
    from ..sources.ingest import ingest_csv
    from ..sources.schemas import STAGING
    t = _t(spark, sf_dir)

    def write(path: str) -> None:
        odd = F.col("EmployeeNumber") % 2 == 1
        for name, part, columns in (("odd", t.staging().where(odd), STAGING.fieldNames()),
                                    ("even", t.staging().where(~odd), STAGING.fieldNames()[::-1])):
            part.select(*columns).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    return ingest_csv(spark, stored_path(t, "staging_csv_folder", write), STAGING).rows


# =============================================================== headline
@register("overall_rate")
def overall(spark, sf_dir):
    return rates.overall_rate(_t(spark, sf_dir).staging(), left())


# =============================================================== load: CSV → staging → star
def _star(spark, sf_dir):
    from .star import Star
    return Star(_t(spark, sf_dir))


@register("load_staging")
def load_staging(spark, sf_dir):
    """W02 + W01: the staging table written as CSV (declared schema) and read back typed.

    The copy is written once per state of the source and read by later calls.
    """
    from ..sources.fixtures import stored_path
    from ..sources.ingest import ingest_csv
    from ..sources.schemas import STAGING
    from ..sources.sinks import write_table
    t = _t(spark, sf_dir)
    path = stored_path(t, "staging_csv", lambda p: write_table(t.staging(), p, schema=STAGING, fmt="csv"))
    return ingest_csv(spark, path, STAGING, mode="FAILFAST").rows


@register("profile")
def profile_key(spark, sf_dir):
    from ..sources.ingest import profile
    return profile(_t(spark, sf_dir).staging())


@register("load_dim_department")
def load_dim_department(spark, sf_dir):
    return _star(spark, sf_dir).dim_department()


@register("load_dim_job_role")
def load_dim_job_role(spark, sf_dir):
    return _star(spark, sf_dir).dim_job_role()


@register("load_dim_employee")
def load_dim_employee(spark, sf_dir):
    return _star(spark, sf_dir).dim_employee()


@register("load_fact_attrition")
def load_fact_attrition(spark, sf_dir):
    return _star(spark, sf_dir).fact_attrition()


@register("load_fact_performance")
def load_fact_performance(spark, sf_dir):
    return _star(spark, sf_dir).fact_performance()


@register("dim_time")
def dim_time(spark, sf_dir):
    return _star(spark, sf_dir).dim_time()


@register("constraint_report")
def constraint_report(spark, sf_dir):
    return _star(spark, sf_dir).constraint_report()
