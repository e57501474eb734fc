"""Presentation order of all statements, the as-of parameter, replaced files, and employees without orders."""

from datetime import date

import pytest
from conftest import SF_SMALL

from stafflens.plans import fixed_values as V
from stafflens.plans.catalog import CATALOG
from stafflens.plans.check import compare, duck_connection
from stafflens.plans.oracle import oracle_as_of
from stafflens.sources import fixtures

# Sort keys of each statement: column, descending, NULLs first. Text, numbers and dates sort as they are.
ORDER = {
    "q01_monthly_exits_rolling": [("month", 0, 0)],
    "q02_cohort_retention": [("hire_year", 0, 1)],
    "q03_rate_dept_gender": [("department", 0, 0), ("attrition_rate_pct", 1, 1)],
    "q04_rate_marital": [("attrition_rate_pct", 1, 1)],
    "q05_rate_overtime": [("attrition_rate_pct", 1, 1)],
    "q06_rate_role_tenure": [("role_tenure_bucket", 0, 1)],
    "q07_rate_education_field": [("attrition_rate_pct", 1, 1)],
    "q08_rate_travel": [("attrition_rate_pct", 1, 1)],
    "q09_rate_stock_level": [("StockOptionLevel", 0, 0)],
    "q10_rate_education": [("Education", 0, 0)],
    "q11_rolling_3m": [("month", 0, 0)],
    "q12_flight_risk": [("risk_score", 1, 1), ("employee_id", 0, 0)],
    "q13_rank_in_role": [("role", 0, 0), ("role_rank", 0, 0), ("employee_id", 0, 0)],
    "q14_score_distribution": [("performance_score", 1, 1)],
    "q15_role_vs_dept": [("department", 0, 0), ("avg_score", 1, 1)],
    "q16_score_delta": [("employee_id", 0, 0), ("date_key", 0, 0)],
    "q17_decile_extremes": [("decile", 0, 0), ("performance_score", 1, 1), ("employee_id", 0, 0)],
    "q18_score_by_tenure": [("tenure_bucket", 0, 1)],
    "q19_score_by_training": [("TrainingTimesLastYear", 0, 0)],
    "q20_score_by_satisfaction": [("JobSatisfaction", 1, 1)],
    "q21_rating_by_dept": [("avg_performance_rating", 1, 1)],
    "q22_declining": [("score_change", 0, 0), ("employee_id", 0, 0)],
    "q23_salary_by_dept_role": [("avg_monthly_income", 1, 1), ("Department", 0, 0), ("JobRole", 0, 0)],
    "q24_salary_percentiles": [("median_salary", 1, 1)],
    "q25_pay_gap": [("|pay_gap_amount|", 1, 0)],
    "q26_hike_by_dept": [("avg_hike_pct", 1, 1)],
    "q27_hike_by_field": [("avg_hike_pct", 1, 1)],
    "q28_below_median": [("diff_from_median", 0, 0), ("EmployeeNumber", 0, 0)],
    "q29_stock_by_dept": [("avg_stock_level", 1, 1)],
    "q30_rates_by_dept": [("avg_daily_rate", 1, 1)],
    "q31_income_brackets": [("income_bracket", 0, 1)],
    "q32_level_share": [("Department", 0, 0), ("JobLevel", 0, 0)],
    "q33_gender_balance": [("female_pct", 0, 0)],
    "q34_marital_crosstab": [("MaritalStatus", 0, 0), ("Attrition", 0, 0)],
    "q35_most_tenured": [("YearsAtCompany", 1, 1), ("employee_id", 0, 0)],
    "q36_commute": [("avg_distance", 1, 1)],
    "q37_wlb_overtime": [("Department", 0, 0), ("avg_wlb_score", 0, 0)],
    "q38_manager_tenure": [("avg_years_with_manager", 1, 1)],
    "q39_corr_distance": [],
    "q40_corr_income": [],
    "q41_org_depth": [("depth", 0, 0), ("employee_id", 0, 0)],
    "q42_promotion_lag": [("YearsSinceLastPromotion", 1, 1), ("PerformanceRating", 1, 1), ("EmployeeNumber", 0, 0)],
    "q43_rate_environment": [("EnvironmentSatisfaction", 1, 1)],
    "q44_team_health": [("team_health_score", 0, 0)],
    "q45_engagement": [("engagement_index", 0, 0), ("EmployeeNumber", 0, 0)],
    "q46_engagement_by_dept": [("Department", 0, 0), ("Attrition", 0, 0)],
    "q47_hire_timeline": [("hire_year", 0, 1)],
    "q48_job_hopping": [("job_hopping_band", 0, 1)],
    "q49_dashboard": [("attrition_rank", 0, 1), ("Department", 0, 1)],
    "q50_risk_proxy": [("attrition_prob_proxy", 1, 1), ("EmployeeNumber", 0, 0)],
    "qb_confusion": [("predicted", 0, 0), ("actual", 0, 0)],
}


class _Desc:
    def __init__(self, v):
        self.v = v

    def __lt__(self, other):
        return other.v < self.v

    def __eq__(self, other):
        return self.v == other.v


def _sort_key(row, keys):
    out = []
    for name, desc, nulls_first in keys:
        v = abs(row[name.strip("|")]) if name[0] == "|" and row[name.strip("|")] is not None else row[name.strip("|")]
        if v is None:
            out.append((0 if nulls_first else 2, 0))
        else:
            out.append((1, _Desc(v) if desc else v))
    return out


def test_every_statement_has_an_order():
    assert set(ORDER) == {k for k in CATALOG if k[0] == "q"} and len(ORDER) == 51


@pytest.mark.parametrize("key", sorted(ORDER))
def test_rows_come_in_order(spark, key):
    keys = [_sort_key(r, ORDER[key]) for r in CATALOG[key](spark, SF_SMALL).collect()]
    assert all(not b < a for a, b in zip(keys, keys[1:]))


AS_OF_KEYS = ["q02_cohort_retention", "q12_flight_risk", "q13_rank_in_role", "q14_score_distribution", "q16_score_delta",
              "q17_decile_extremes", "q47_hire_timeline", "q50_risk_proxy"]


@pytest.mark.parametrize("key", AS_OF_KEYS)
def test_as_of_is_a_parameter(spark, key):
    duck = duck_connection(SF_SMALL)
    results = []
    for day in (date(1999, 1, 1), date(1997, 1, 1)):
        df = CATALOG[key](spark, SF_SMALL, as_of=day)
        r = compare(key, df, oracle_as_of(key, day), duck)
        assert r.ok, "\n".join(r.notes)
        results.append(sorted(map(str, df.collect())))
    assert key == "q02_cohort_retention" or results[0] != results[1]
    assert sorted(map(str, CATALOG[key](spark, SF_SMALL).collect())) == sorted(
        map(str, CATALOG[key](spark, SF_SMALL, as_of=V.AS_OF).collect()))


def _copy(spark, target, customers, no_orders_for=()):
    for name in ("region", "nation", "customer", "orders"):
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        if name == "customer":
            df = df.where(f"c_custkey <= {customers}")
        if name == "orders" and no_orders_for:
            df = df.where(~df.o_custkey.isin(*no_orders_for))
        df.write.mode("overwrite").parquet(f"{target}/{name}.parquet")


def test_replaced_files_are_read_again(spark, tmp_path):
    sf = str(tmp_path)
    for n in (60, 90):
        _copy(spark, sf, n)
        want = spark.read.parquet(f"{sf}/customer.parquet").count()
        assert CATALOG["overall_rate"](spark, sf).first().total_employees == want
        assert CATALOG["load_staging"](spark, sf).count() == want
        assert CATALOG["load_dim_employee"](spark, sf).count() == want


def test_employees_without_orders_stay(spark, tmp_path):
    sf = str(tmp_path)
    _copy(spark, sf, 80, no_orders_for=(5, 6))
    rows = {r.EmployeeNumber: r for r in CATALOG["load_staging"](spark, sf).collect()}
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    assert len(rows) == n == CATALOG["overall_rate"](spark, sf).first().total_employees
    r = rows[5]
    assert (r.Age, r.YearsAtCompany, r.NumCompaniesWorked, r.Attrition, r.MonthlyIncome, r.hire_date) == (20, 0, 0, "No", None, None)
    assert 5 in {x.employee_id for x in CATALOG["q12_flight_risk"](spark, sf).collect()}


def test_planted_violations_show_in_the_star_report(spark):
    base = fixtures.HrTables(spark, SF_SMALL).staging()
    from pyspark.sql import functions as F
    from stafflens.plans.star import Star
    n = F.col("EmployeeNumber")
    planted = (base.withColumn("Department", F.when(n == 1, None).when(n == 2, "d" * 101).otherwise(F.col("Department")))
               .withColumn("JobRole", F.when(n == 3, None).otherwise(F.col("JobRole")))
               .withColumn("Gender", F.when(n == 4, "g" * 21).otherwise(F.col("Gender"))))
    star = Star(fixtures.HrFrames(spark, planted))
    got = {(r.table_name, r.rule, r.column_name): r.violations for r in star.constraint_report().collect()}
    want = {("dim_department", "not_null", "department_name"): 1, ("dim_department", "max_length", "department_name"): 1,
            ("dim_job_role", "not_null", "job_role_name"): 1, ("dim_employee", "max_length", "gender"): 1,
            ("staging", "lookup_miss", "Department"): 1, ("staging", "lookup_miss", "JobRole"): 1}
    assert {k: v for k, v in got.items() if v} == want


def test_attrition_fact_literal_and_filled(spark):
    from stafflens.plans.star import ATTRITION_OMITTED, Star
    t = fixtures.HrTables(spark, SF_SMALL)
    names = [c for _, c, _ in ATTRITION_OMITTED]
    literal, filled = Star(t).fact_attrition(), Star(t, fill_omitted=True).fact_attrition()
    assert literal.dtypes == filled.dtypes and literal.count() == filled.count()
    assert all(v is None for r in literal.select(*names).collect() for v in r)
    assert filled.where(" OR ".join(f"{c} IS NULL" for c in names)).count() == 0


def test_correlation_over_pairs_and_over_own_rows(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from stafflens.operators import stats
    rows = [(1.0, 2.0), (2.0, None), (None, 5.0), (4.0, 3.0), (7.0, 9.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    pairs = np.array([r for r in rows if None not in r])
    x, y = (np.array([r[i] for r in rows if r[i] is not None]) for i in (0, 1))
    literal = np.mean((pairs[:, 0] - x.mean()) * (pairs[:, 1] - y.mean())) / (x.std() * y.std())
    own = stats.correlation(df, "x", F.col("y"), digits=None, own_rows=True).first()[0]
    both = stats.correlation(df, "x", F.col("y"), digits=None).first()[0]
    assert own == pytest.approx(literal, rel=1e-12)
    assert both == pytest.approx(np.corrcoef(pairs.T)[0, 1], rel=1e-12)


def test_fixed_values_have_not_drifted():
    """Both sides of the oracle check read these values; a change must show here."""
    import hashlib
    values = {k: v for k, v in sorted(vars(V).items()) if k.isupper()}
    assert hashlib.sha256(repr(values).encode()).hexdigest() == EXPECTED_VALUES


EXPECTED_VALUES = "2abaee69b8e002e3b1f8c9f238091291e2d21f3f4265caafef084fbc366074bb"
