"""Independent SQL for every catalog key, run by DuckDB on the driver's views.

Each text starts with the same HR projection (FIXTURES.md §3, written here as
SQL over the views ``orders customer nation region``) and then states the
analysis in plain SQL. Where the Spark side uses a rewrite (histogram rank,
min_by/max_by, pre-aggregated exits, distributed NTILE), the SQL keeps the
textbook form, so the two sides check each other.

Shared conventions with the Spark side: rounded values go through
DECIMAL(28,10) and come out DOUBLE; counts BIGINT; ranks and tiles INTEGER.
"""

from __future__ import annotations

from . import fixed_values as V

AS_OF_SQL = f"DATE '{V.AS_OF.isoformat()}'"


def R(expr: str, digits: int) -> str:
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def PCT(num: str, den: str) -> str:
    return f"(100.0 * CAST(({num}) AS DOUBLE) / NULLIF(CAST(({den}) AS DOUBLE), 0))"


def DIV(num: str, den: str) -> str:
    return f"(CAST(({num}) AS DOUBLE) / NULLIF(CAST(({den}) AS DOUBLE), 0))"


def q(s: str) -> str:
    """SQL text literal."""
    return "'" + s.replace("'", "''") + "'"


def case_band(x: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN {x} {op} {edge} THEN {q(text)}" for op, edge, text in rules)
    return f"CASE {whens} ELSE {q(default)} END"


def case_label(x: str, mapping) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in mapping.items()) + " END"


def weighted_sql(features) -> str:
    terms = []
    for w, c, op, value in features:
        v = q(value) if isinstance(value, str) else str(value)
        terms.append(f"{w} * (CASE WHEN {c} {op} {v} THEN 1.0 ELSE 0.0 END)")
    return " + ".join(terms)


_HR = """
o AS (
  SELECT o_custkey, COUNT(*) AS n_all,
    COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
    COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS n_p,
    COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
    COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
    MIN(o_totalprice) AS min_price, MIN(o_orderdate) AS first_dt, MAX(o_orderkey) AS last_key
  FROM orders GROUP BY o_custkey),
l AS (
  SELECT orders.o_custkey, o_orderstatus AS last_status, o_orderpriority AS last_priority
  FROM orders JOIN o ON orders.o_orderkey = o.last_key),
c AS (
  SELECT customer.*, COALESCE(n_all, 0) AS n_all, COALESCE(n_o, 0) AS n_o, COALESCE(n_p, 0) AS n_p,
    COALESCE(n_f, 0) AS n_f, COALESCE(n_urgent, 0) AS n_urgent, min_price, first_dt
  FROM customer LEFT JOIN o ON o.o_custkey = c_custkey),
staging AS (
  SELECT
    CAST(c.c_custkey AS BIGINT) AS EmployeeNumber,
    CAST(20 + c.n_all AS INT) AS Age,
    CASE WHEN c.c_nationkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender,
    CASE WHEN c.c_acctbal < 0 THEN 'Divorced' WHEN c.c_acctbal < 5000 THEN 'Single' ELSE 'Married' END AS MaritalStatus,
    c.c_mktsegment AS Department,
    r.r_name AS JobRole,
    CAST(6 - CAST(SUBSTR(l.last_priority, 1, 1) AS INT) AS INT) AS Education,
    l.last_priority AS EducationField,
    CASE WHEN l.last_status = 'F' THEN 'Yes' ELSE 'No' END AS Attrition,
    CASE WHEN c.n_urgent >= 3 THEN 'Yes' ELSE 'No' END AS OverTime,
    CASE WHEN c.n_p = 0 THEN 'Non-Travel' WHEN c.n_p <= 3 THEN 'Travel_Rarely' ELSE 'Travel_Frequently' END AS BusinessTravel,
    CAST(FLOOR(c.min_price / 10) AS INT) AS MonthlyIncome,
    CAST(100 + c.c_custkey % 1400 AS INT) AS DailyRate,
    CAST(30 + c.c_custkey % 71 AS INT) AS HourlyRate,
    CAST(11 + c.n_all % 15 AS INT) AS PercentSalaryHike,
    CAST(c.n_f % 4 AS INT) AS StockOptionLevel,
    CAST(1 + c.c_custkey % 5 AS INT) AS JobLevel,
    CAST(1 + c.c_nationkey % 4 AS INT) AS JobSatisfaction,
    CAST(1 + c.n_p % 4 AS INT) AS EnvironmentSatisfaction,
    CAST(1 + c.n_o % 4 AS INT) AS RelationshipSatisfaction,
    CAST(1 + c.n_all % 4 AS INT) AS WorkLifeBalance,
    CAST(1 + c.n_f % 4 AS INT) AS JobInvolvement,
    CAST(CASE WHEN c.n_urgent >= 3 THEN 4 WHEN c.n_urgent = 0 THEN 2 ELSE 3 END AS INT) AS PerformanceRating,
    CAST(1 + c.c_custkey % 29 AS INT) AS DistanceFromHome,
    CAST(c.n_urgent AS INT) AS NumCompaniesWorked,
    CAST(c.n_o % 7 AS INT) AS TrainingTimesLastYear,
    CAST(GREATEST(c.n_all - 1, 0) AS INT) AS YearsAtCompany,
    CAST(c.n_o AS INT) AS YearsInCurrentRole,
    CAST(c.n_p AS INT) AS YearsSinceLastPromotion,
    CAST(c.n_f AS INT) AS YearsWithCurrManager,
    CAST(CASE WHEN c.c_custkey = 0 THEN NULL ELSE FLOOR((c.c_custkey - 1) / 4) END AS BIGINT) AS ManagerId,
    CAST(c.first_dt AS DATE) AS hire_date
  FROM c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN l ON l.o_custkey = c.c_custkey),
performance_fact AS (
  SELECT o_custkey AS employee_id,
    CAST(DATE_TRUNC('year', o_orderdate) AS DATE) AS date_key,
    CAST(FLOOR(AVG(6 - CAST(SUBSTR(o_orderpriority, 1, 1) AS INT))) AS INT) AS performance_score
  FROM orders
  GROUP BY o_custkey, CAST(DATE_TRUNC('year', o_orderdate) AS DATE)),
retention_fact AS (
  SELECT o_custkey AS employee_id, CAST(o_orderdate AS DATE) AS event_date,
    CASE WHEN o_orderstatus = 'F' THEN 'exit' ELSE 'other' END AS event_type
  FROM orders),
dim_employee_wide AS (
  SELECT EmployeeNumber AS employee_id, Department AS department, JobRole AS role, Gender AS gender,
    hire_date, ManagerId AS manager_id
  FROM staging)"""


def with_hr(body: str, ctes: str = "", recursive: bool = False) -> str:
    head = "WITH RECURSIVE" if recursive else "WITH"
    extra = f",\n{ctes}" if ctes else ""
    return f"{head}{_HR}{extra}\n{body}"


def oracle_as_of(key: str, as_of) -> str:
    """The SQL of ``key`` looking back from another date than the fixture data's."""
    return ORACLE[key].replace(AS_OF_SQL, f"DATE '{as_of.isoformat()}'")


N = "COUNT(*)"
YES_N = "COUNT(*) FILTER (WHERE Attrition = 'Yes')"
RATE2 = R(PCT(YES_N, N), 2)
SNAP = f"pf.date_key = {AS_OF_SQL}"

ORACLE: dict[str, str] = {}

# ------------------------------------------------------------------ A
ORACLE["q01_monthly_exits_rolling"] = with_hr(
    f"""SELECT month, attrition_count,
  CAST(SUM(attrition_count) OVER w AS BIGINT) AS rolling_12m_attrition,
  {R('AVG(attrition_count) OVER w', 1)} AS rolling_12m_avg
FROM me WINDOW w AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    """me AS (SELECT CAST(DATE_TRUNC('month', event_date) AS DATE) AS month, COUNT(*) AS attrition_count
  FROM retention_fact WHERE event_type = 'exit' GROUP BY 1)""")

ORACLE["q02_cohort_retention"] = with_hr(
    f"""SELECT hire_year, total_hired, exited_same_year, total_hired - exited_same_year AS retained,
  {R(PCT('total_hired - exited_same_year', 'total_hired'), 2)} AS retention_rate_pct
FROM (
  SELECT h.hire_year, COUNT(DISTINCT h.employee_id) AS total_hired,
    COUNT(DISTINCT x.employee_id) FILTER (WHERE x.exit_year = h.hire_year) AS exited_same_year
  FROM hired h LEFT JOIN gone x ON h.employee_id = x.employee_id
  GROUP BY h.hire_year) g""",
    f"""hired AS (SELECT employee_id, CAST(YEAR(COALESCE(hire_date, {AS_OF_SQL})) AS INT) AS hire_year
  FROM dim_employee_wide),
gone AS (SELECT employee_id, CAST(YEAR(event_date) AS INT) AS exit_year FROM retention_fact
  WHERE event_type = 'exit')""")

ORACLE["q03_rate_dept_gender"] = with_hr(
    f"""SELECT de.department, de.gender, COUNT(*) AS total_employees, COUNT(x.employee_id) AS total_exits,
  {R(PCT('COUNT(x.employee_id)', 'COUNT(*)'), 2)} AS attrition_rate_pct
FROM dim_employee_wide de
LEFT JOIN (SELECT employee_id FROM retention_fact WHERE event_type = 'exit') x ON de.employee_id = x.employee_id
GROUP BY de.department, de.gender""")

ORACLE["q04_rate_marital"] = with_hr(
    f"""SELECT MaritalStatus, {N} AS total_employees, {YES_N} AS attritions, {RATE2} AS attrition_rate_pct,
  CAST(RANK() OVER (ORDER BY CAST({YES_N} AS DOUBLE) / {N} DESC NULLS FIRST) AS INTEGER) AS risk_rank
FROM staging GROUP BY MaritalStatus""")

ORACLE["q05_rate_overtime"] = with_hr(
    f"""SELECT OverTime, {N} AS total_employees, {YES_N} AS attrition_count, {RATE2} AS attrition_rate_pct,
  {R(PCT(YES_N, N) + f" / NULLIF(MIN(CAST({YES_N} AS DOUBLE) / {N}) OVER (), 0) - 100", 1)} AS relative_risk_pct
FROM staging GROUP BY OverTime""")

ORACLE["q06_rate_role_tenure"] = with_hr(
    f"""SELECT {case_band('YearsInCurrentRole', V.ROLE_TENURE_BANDS, V.ROLE_TENURE_ELSE)} AS role_tenure_bucket,
  {N} AS total_employees, {YES_N} AS total_exits, {RATE2} AS attrition_rate_pct
FROM staging GROUP BY 1""")

ORACLE["q07_rate_education_field"] = with_hr(
    f"""SELECT EducationField, {N} AS total_employees, {YES_N} AS attrited, {RATE2} AS attrition_rate_pct,
  {R(PCT(YES_N, N) + f" - AVG(CAST({YES_N} AS DOUBLE) / {N}) OVER ()", 2)} AS vs_org_avg_pct
FROM staging GROUP BY EducationField""")

ORACLE["q08_rate_travel"] = with_hr(
    f"""SELECT BusinessTravel, {N} AS total_employees, {YES_N} AS exits,
  COUNT(*) FILTER (WHERE Attrition = 'No') AS retained, {RATE2} AS attrition_rate_pct
FROM staging GROUP BY BusinessTravel""")

ORACLE["q09_rate_stock_level"] = with_hr(
    f"""SELECT StockOptionLevel, {N} AS total_employees, {YES_N} AS attritions, {RATE2} AS attrition_rate_pct,
  {R(f"FIRST_VALUE(CAST({YES_N} AS DOUBLE) / {N}) OVER (ORDER BY StockOptionLevel ASC NULLS LAST) / NULLIF(CAST({YES_N} AS DOUBLE) / {N}, 0)", 2)} AS vs_level0_multiplier
FROM staging GROUP BY StockOptionLevel""")

ORACLE["q10_rate_education"] = with_hr(
    f"""SELECT Education, {case_label('Education', V.EDUCATION_LABELS)} AS education_label,
  {N} AS total_employees, {YES_N} AS exits, {RATE2} AS attrition_rate_pct
FROM staging GROUP BY Education""")

ORACLE["q11_rolling_3m"] = with_hr(
    f"""SELECT month, exits,
  {R('AVG(exits) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 2)} AS rolling_3m_avg,
  {R('AVG(exits) OVER (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)', 2)} AS rolling_12m_avg,
  exits - LAG(exits) OVER (ORDER BY month) AS mom_change
FROM me""",
    """me AS (SELECT CAST(DATE_TRUNC('month', event_date) AS DATE) AS month, COUNT(*) AS exits
  FROM retention_fact WHERE event_type = 'exit' GROUP BY 1)""")

ORACLE["q12_flight_risk"] = with_hr(
    f"""SELECT *, CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 50 THEN 'High'
    WHEN risk_score >= 25 THEN 'Medium' ELSE 'Low' END AS risk_segment
FROM (
  SELECT de.employee_id, de.department, de.role, s.YearsAtCompany, pf.performance_score, s.OverTime,
    s.JobSatisfaction, s.MonthlyIncome,
    (CASE WHEN pf.performance_score < 3 THEN 40 ELSE 0 END
     + CASE WHEN s.YearsAtCompany < 2 THEN 25 ELSE 0 END
     + CASE WHEN s.OverTime = 'Yes' THEN 20 ELSE 0 END
     + CASE WHEN s.JobSatisfaction <= 2 THEN 15 ELSE 0 END) AS risk_score
  FROM dim_employee_wide de
  JOIN staging s ON de.employee_id = s.EmployeeNumber
  LEFT JOIN performance_fact pf ON de.employee_id = pf.employee_id AND {SNAP}) sc""")

# ------------------------------------------------------------------ B
_ROLE_AVG = "AVG(pf.performance_score) OVER (PARTITION BY de.role)"
ORACLE["q13_rank_in_role"] = with_hr(
    f"""SELECT de.employee_id, de.department, de.role, pf.performance_score,
  CAST(RANK() OVER (PARTITION BY de.role ORDER BY pf.performance_score DESC NULLS FIRST) AS INTEGER) AS role_rank,
  {R(_ROLE_AVG, 2)} AS role_avg_score,
  CAST(pf.performance_score - ROUND(CAST({_ROLE_AVG} AS DECIMAL(28,10)), 2) AS DOUBLE) AS vs_role_avg
FROM performance_fact pf JOIN dim_employee_wide de ON pf.employee_id = de.employee_id
WHERE {SNAP}""")

ORACLE["q14_score_distribution"] = with_hr(
    f"""SELECT performance_score, {N} AS employee_count,
  {R(PCT(N, 'SUM(COUNT(*)) OVER ()'), 2)} AS pct_of_total,
  REPEAT({q(V.BAR_BLOCK)}, CAST(COUNT(*) // {V.BAR_UNIT} AS INTEGER)) AS bar_chart
FROM performance_fact pf WHERE {SNAP} GROUP BY performance_score""")

_GAP15 = "AVG(pf.performance_score) - AVG(AVG(pf.performance_score)) OVER (PARTITION BY de.department)"
ORACLE["q15_role_vs_dept"] = with_hr(
    f"""SELECT de.department, de.role, {R('AVG(pf.performance_score)', 2)} AS avg_score,
  COUNT(DISTINCT pf.employee_id) AS employee_count,
  {R(_GAP15, 2)} AS diff_from_dept_avg,
  CASE WHEN {_GAP15} < {V.ROLE_GAP_CUTOFF} THEN {q(V.ROLE_GAP_FLAG)} ELSE {q(V.ROLE_GAP_OK)} END AS flag
FROM performance_fact pf JOIN dim_employee_wide de ON pf.employee_id = de.employee_id
GROUP BY de.department, de.role""")

_D16 = "performance_score - LAG(performance_score) OVER w"
ORACLE["q16_score_delta"] = with_hr(
    f"""SELECT employee_id, date_key, performance_score, LAG(performance_score) OVER w AS prev_score,
  {_D16} AS delta,
  CASE WHEN {_D16} < 0 THEN {q(V.TREND_DECLINING)} WHEN {_D16} > 0 THEN {q(V.TREND_IMPROVING)}
       ELSE {q(V.TREND_STABLE)} END AS trend
FROM performance_fact
WHERE date_key >= {AS_OF_SQL} - INTERVAL 24 MONTH
WINDOW w AS (PARTITION BY employee_id ORDER BY date_key)""")

ORACLE["q17_decile_extremes"] = with_hr(
    f"""SELECT *, CASE WHEN decile = 1 THEN {q(V.DECILE_TOP)} WHEN decile = 10 THEN {q(V.DECILE_BOTTOM)}
    ELSE {q(V.DECILE_MID)} END AS performance_band
FROM (
  SELECT pf.employee_id, de.department, de.role, pf.performance_score, s.YearsAtCompany,
    CAST(NTILE(10) OVER (ORDER BY pf.performance_score DESC NULLS FIRST, pf.employee_id ASC) AS INTEGER) AS decile
  FROM performance_fact pf
  JOIN dim_employee_wide de ON pf.employee_id = de.employee_id
  JOIN staging s ON pf.employee_id = s.EmployeeNumber
  WHERE {SNAP}) ranked
WHERE decile IN (1, 10)""")

ORACLE["q18_score_by_tenure"] = with_hr(
    f"""SELECT {case_band('s.YearsAtCompany', V.TENURE_BANDS, V.TENURE_ELSE)} AS tenure_bucket,
  {R('AVG(pf.performance_score)', 2)} AS avg_performance_score,
  COUNT(DISTINCT pf.employee_id) AS employee_count,
  {R('STDDEV_SAMP(pf.performance_score)', 3)} AS score_stddev
FROM performance_fact pf JOIN staging s ON pf.employee_id = s.EmployeeNumber
GROUP BY 1""")

ORACLE["q19_score_by_training"] = with_hr(
    f"""SELECT s.TrainingTimesLastYear, {R('AVG(pf.performance_score)', 2)} AS avg_performance,
  {N} AS employee_count,
  {R('AVG(pf.performance_score) - AVG(AVG(pf.performance_score)) OVER ()', 3)} AS vs_overall_avg
FROM performance_fact pf JOIN staging s ON pf.employee_id = s.EmployeeNumber
GROUP BY s.TrainingTimesLastYear""")

ORACLE["q20_score_by_satisfaction"] = with_hr(
    f"""SELECT s.JobSatisfaction, {R('AVG(pf.performance_score)', 2)} AS avg_performance, {N} AS employee_count,
  {YES_N} AS attrited_count, {RATE2} AS attrition_rate_pct
FROM performance_fact pf JOIN staging s ON pf.employee_id = s.EmployeeNumber
GROUP BY s.JobSatisfaction""")

ORACLE["q21_rating_by_dept"] = with_hr(
    f"""SELECT Department, {R('AVG(PerformanceRating)', 2)} AS avg_performance_rating, {N} AS employee_count,
  MIN(PerformanceRating) AS min_rating, MAX(PerformanceRating) AS max_rating,
  {R('STDDEV_SAMP(PerformanceRating)', 3)} AS rating_stddev
FROM staging GROUP BY Department""")

ORACLE["q22_declining"] = with_hr(
    f"""SELECT DISTINCT ends.employee_id, de.department, de.role, ends.first_score, ends.latest_score,
  ends.latest_score - ends.first_score AS score_change,
  CASE WHEN ends.latest_score - ends.first_score <= -2 THEN {q(V.DECLINE_SIGNIFICANT)}
       WHEN ends.latest_score - ends.first_score = -1 THEN {q(V.DECLINE_MILD)}
       ELSE {q(V.DECLINE_OTHER)} END AS decline_severity
FROM ends JOIN dim_employee_wide de ON ends.employee_id = de.employee_id
WHERE ends.latest_score < ends.first_score""",
    """ends AS (
  SELECT employee_id, date_key, performance_score,
    FIRST_VALUE(performance_score) OVER w AS first_score,
    LAST_VALUE(performance_score) OVER w AS latest_score
  FROM performance_fact
  WINDOW w AS (PARTITION BY employee_id ORDER BY date_key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""")

# ------------------------------------------------------------------ C
ORACLE["q23_salary_by_dept_role"] = with_hr(
    f"""SELECT Department, JobRole, {R('AVG(MonthlyIncome)', 0)} AS avg_monthly_income,
  MIN(MonthlyIncome) AS min_income, MAX(MonthlyIncome) AS max_income,
  MAX(MonthlyIncome) - MIN(MonthlyIncome) AS income_range, {N} AS employee_count,
  {R('STDDEV_SAMP(MonthlyIncome) / NULLIF(AVG(MonthlyIncome), 0) * 100', 1)} AS cv_pct
FROM staging GROUP BY Department, JobRole
ORDER BY avg_monthly_income DESC NULLS FIRST, Department ASC NULLS LAST, JobRole ASC NULLS LAST
LIMIT 15""")


def _pc(p: str) -> str:
    return f"PERCENTILE_CONT({p}) WITHIN GROUP (ORDER BY MonthlyIncome)"


ORACLE["q24_salary_percentiles"] = with_hr(
    f"""SELECT Department, {R(_pc('0.10'), 0)} AS p10_salary, {R(_pc('0.25'), 0)} AS p25_salary,
  {R(_pc('0.50'), 0)} AS median_salary, {R(_pc('0.75'), 0)} AS p75_salary, {R(_pc('0.90'), 0)} AS p90_salary,
  {R('AVG(MonthlyIncome)', 0)} AS avg_salary, {R(_pc('0.75') + ' - ' + _pc('0.25'), 0)} AS iqr
FROM staging GROUP BY Department""")

ORACLE["q25_pay_gap"] = with_hr(
    f"""SELECT JobRole, total_employees, male_count, female_count, {R('m', 0)} AS avg_male_income,
  {R('f', 0)} AS avg_female_income, {R('m - f', 0)} AS pay_gap_amount,
  {R('100.0 * (m - f) / NULLIF(m, 0)', 2)} AS gap_pct,
  CASE WHEN ABS(m - f) > {V.PAY_GAP_TOLERANCE} THEN {q(V.PAY_GAP_REVIEW)} ELSE {q(V.PAY_GAP_OK)} END AS equity_flag
FROM (
  SELECT JobRole, {N} AS total_employees,
    COUNT(*) FILTER (WHERE Gender = 'Male') AS male_count, COUNT(*) FILTER (WHERE Gender = 'Female') AS female_count,
    AVG(MonthlyIncome) FILTER (WHERE Gender = 'Male') AS m, AVG(MonthlyIncome) FILTER (WHERE Gender = 'Female') AS f
  FROM staging GROUP BY JobRole) g""")

ORACLE["q26_hike_by_dept"] = with_hr(
    f"""SELECT Department, {R('AVG(PercentSalaryHike)', 2)} AS avg_hike_pct, MIN(PercentSalaryHike) AS min_hike,
  MAX(PercentSalaryHike) AS max_hike,
  {R('AVG(PercentSalaryHike) - AVG(AVG(PercentSalaryHike)) OVER ()', 2)} AS vs_org_avg
FROM staging GROUP BY Department""")

ORACLE["q27_hike_by_field"] = with_hr(
    f"""SELECT EducationField, {R('AVG(PercentSalaryHike)', 2)} AS avg_hike_pct, {N} AS employee_count,
  {R('AVG(MonthlyIncome)', 0)} AS avg_income
FROM staging GROUP BY EducationField""")

ORACLE["q28_below_median"] = with_hr(
    f"""SELECT s.EmployeeNumber, s.Department, s.JobRole, s.MonthlyIncome, {R('med.m', 0)} AS dept_median,
  {R('s.MonthlyIncome - med.m', 0)} AS diff_from_median,
  CASE WHEN s.MonthlyIncome < med.m THEN {q(V.BELOW_MEDIAN)} ELSE {q(V.AT_OR_ABOVE)} END AS pay_status,
  s.Attrition AS already_left
FROM staging s JOIN med ON s.Department = med.Department""",
    f"""med AS (SELECT Department, {_pc('0.5')} AS m FROM staging GROUP BY Department)""")

ORACLE["q29_stock_by_dept"] = with_hr(
    f"""SELECT Department, CAST(SUM(StockOptionLevel) AS BIGINT) AS total_stock_options,
  {R('AVG(StockOptionLevel)', 2)} AS avg_stock_level, {N} AS employee_count, {RATE2} AS attrition_rate_pct
FROM staging GROUP BY Department""")

ORACLE["q30_rates_by_dept"] = with_hr(
    f"""SELECT Department, {R('AVG(DailyRate)', 0)} AS avg_daily_rate, {R('AVG(HourlyRate)', 0)} AS avg_hourly_rate,
  {R(DIV('AVG(DailyRate)', 'AVG(HourlyRate)'), 1)} AS implied_hours_per_day
FROM staging GROUP BY Department""")

ORACLE["q31_income_brackets"] = with_hr(
    f"""SELECT {case_band('MonthlyIncome', V.INCOME_BANDS, V.INCOME_ELSE)} AS income_bracket,
  {N} AS total_employees, {YES_N} AS attritions, {RATE2} AS attrition_rate_pct,
  {R('AVG(MonthlyIncome)', 0)} AS avg_income_in_bracket
FROM staging GROUP BY 1""")

# ------------------------------------------------------------------ D
ORACLE["q32_level_share"] = with_hr(
    f"""SELECT Department, JobLevel, {case_label('JobLevel', V.JOB_LEVEL_LABELS)} AS level_label,
  {N} AS employee_count, {R(PCT(N, 'SUM(COUNT(*)) OVER (PARTITION BY Department)'), 2)} AS pct_of_dept
FROM staging GROUP BY Department, JobLevel""")

_FEM = PCT("COUNT(*) FILTER (WHERE Gender = 'Female')", N)
ORACLE["q33_gender_balance"] = with_hr(
    f"""SELECT JobRole, {N} AS total, COUNT(*) FILTER (WHERE Gender = 'Male') AS male_count,
  COUNT(*) FILTER (WHERE Gender = 'Female') AS female_count, {R(_FEM, 2)} AS female_pct,
  CASE WHEN {_FEM} < {V.FEMALE_SHARE_LOW} THEN {q(V.MALE_SKEWED)}
       WHEN {_FEM} > {V.FEMALE_SHARE_HIGH} THEN {q(V.FEMALE_SKEWED)} ELSE {q(V.BALANCED)} END AS gender_balance_flag
FROM staging GROUP BY JobRole""")

ORACLE["q34_marital_crosstab"] = with_hr(
    f"""SELECT MaritalStatus, Attrition, {N} AS employee_count,
  {R(PCT(N, 'SUM(COUNT(*)) OVER (PARTITION BY MaritalStatus)'), 2)} AS pct_within_marital_status,
  {R(PCT(N, 'SUM(COUNT(*)) OVER ()'), 2)} AS pct_of_total
FROM staging GROUP BY MaritalStatus, Attrition""")

ORACLE["q35_most_tenured"] = with_hr(
    f"""SELECT EmployeeNumber AS employee_id, Department, JobRole, YearsAtCompany, YearsInCurrentRole,
  YearsSinceLastPromotion, PerformanceRating,
  {R(PCT('YearsInCurrentRole', 'YearsAtCompany'), 1)} AS pct_time_in_current_role
FROM staging ORDER BY YearsAtCompany DESC NULLS FIRST, EmployeeNumber ASC LIMIT 10""")

ORACLE["q36_commute"] = with_hr(
    f"""SELECT Department, {R('AVG(DistanceFromHome)', 1)} AS avg_distance, MAX(DistanceFromHome) AS max_distance,
  MIN(DistanceFromHome) AS min_distance, {R('STDDEV_SAMP(DistanceFromHome)', 1)} AS distance_stddev,
  {R(PCT(f'COUNT(*) FILTER (WHERE DistanceFromHome > {V.LONG_COMMUTE})', N), 1)} AS pct_long_commute
FROM staging GROUP BY Department""")

ORACLE["q37_wlb_overtime"] = with_hr(
    f"""SELECT Department, OverTime, {R('AVG(WorkLifeBalance)', 2)} AS avg_wlb_score, {N} AS employee_count,
  {R(PCT(YES_N, N), 1)} AS attrition_rate_pct
FROM staging GROUP BY Department, OverTime""")

_RATIO38 = DIV("AVG(YearsWithCurrManager)", "AVG(YearsAtCompany)")
ORACLE["q38_manager_tenure"] = with_hr(
    f"""SELECT Department, {R('AVG(YearsWithCurrManager)', 2)} AS avg_years_with_manager,
  {R('AVG(YearsAtCompany)', 2)} AS avg_tenure, {R(_RATIO38, 2)} AS manager_tenure_ratio,
  CASE WHEN {_RATIO38} < {V.STABILITY_CUTOFF} THEN {q(V.STABILITY_RISK)} ELSE {q(V.STABILITY_OK)} END AS stability_flag
FROM staging GROUP BY Department""")

# ------------------------------------------------------------------ E
_Y = "(CASE WHEN Attrition = 'Yes' THEN 1.0 ELSE 0.0 END)"


def _corr(x: str, name: str, text: str) -> str:
    return with_hr(
        f"""SELECT {R(f"AVG((CAST({x} AS DOUBLE) - st.ax) * ({_Y} - st.ay)) / NULLIF(STDDEV_POP({x}) * STDDEV_POP({_Y}), 0)", 4)} AS {name},
  {q(text)} AS interpretation
FROM staging CROSS JOIN st""",
        f"""st AS (SELECT AVG(CAST({x} AS DOUBLE)) AS ax, AVG({_Y}) AS ay FROM staging)""")


ORACLE["q39_corr_distance"] = _corr("DistanceFromHome", "corr_distance_vs_attrition", V.CORR_DISTANCE_TEXT)
ORACLE["q40_corr_income"] = _corr("MonthlyIncome", "corr_income_vs_attrition", V.CORR_INCOME_TEXT)

ORACLE["q41_org_depth"] = with_hr(
    """SELECT employee_id, role, department, CAST(depth AS INTEGER) AS depth FROM reach""",
    """reach AS (
  SELECT employee_id, role, department, 1 AS depth FROM dim_employee_wide WHERE manager_id IS NULL
  UNION ALL
  SELECT child.employee_id, child.role, child.department, up.depth + 1
  FROM reach up JOIN dim_employee_wide child ON child.manager_id = up.employee_id)""",
    recursive=True)

ORACLE["q42_promotion_lag"] = with_hr(
    f"""SELECT EmployeeNumber, Department, JobRole, JobLevel, YearsAtCompany, YearsSinceLastPromotion, PerformanceRating,
  {R(DIV('YearsSinceLastPromotion', 'YearsAtCompany'), 2)} AS promotion_lag_ratio,
  CASE WHEN YearsSinceLastPromotion >= {V.PROMOTION_OVERDUE_YEARS} AND PerformanceRating >= {V.PROMOTION_RATING_CUT}
         THEN {q(V.PROMOTION_OVERDUE)}
       WHEN YearsSinceLastPromotion >= {V.PROMOTION_OVERDUE_YEARS} AND PerformanceRating < {V.PROMOTION_RATING_CUT}
         THEN {q(V.PROMOTION_STAGNANT)}
       WHEN YearsSinceLastPromotion BETWEEN {V.PROMOTION_WATCH[0]} AND {V.PROMOTION_WATCH[1]}
         THEN {q(V.PROMOTION_WATCH_LIST)}
       ELSE {q(V.PROMOTION_ON_TRACK)} END AS promotion_status
FROM staging""")

ORACLE["q43_rate_environment"] = with_hr(
    f"""SELECT EnvironmentSatisfaction, {case_label('EnvironmentSatisfaction', V.ENVIRONMENT_LABELS)} AS satisfaction_label,
  {N} AS employee_count, {YES_N} AS attritions, {RATE2} AS attrition_rate_pct
FROM staging GROUP BY EnvironmentSatisfaction""")

ORACLE["q44_team_health"] = with_hr(
    f"""SELECT Department, {R('AVG(RelationshipSatisfaction)', 2)} AS avg_rel_satisfaction,
  {R('AVG(JobInvolvement)', 2)} AS avg_job_involvement, {R('AVG(JobSatisfaction)', 2)} AS avg_job_satisfaction,
  {R('AVG(WorkLifeBalance)', 2)} AS avg_wlb,
  {R('(AVG(RelationshipSatisfaction) + AVG(JobInvolvement) + AVG(JobSatisfaction) + AVG(WorkLifeBalance)) / 4.0', 2)} AS team_health_score
FROM staging GROUP BY Department""")

_IDX = "(JobSatisfaction + EnvironmentSatisfaction + RelationshipSatisfaction + WorkLifeBalance)"
ORACLE["q45_engagement"] = with_hr(
    f"""SELECT EmployeeNumber, Department, JobRole, Attrition, JobSatisfaction, EnvironmentSatisfaction,
  RelationshipSatisfaction, WorkLifeBalance, {_IDX} AS engagement_index,
  {R(f'CAST({_IDX} AS DOUBLE) / {V.ENGAGEMENT_MAX}.0 * 100', 1)} AS engagement_pct,
  CASE WHEN {_IDX} >= {V.ENGAGEMENT_BANDS[0][0]} THEN {q(V.ENGAGEMENT_BANDS[0][1])}
       WHEN {_IDX} >= {V.ENGAGEMENT_BANDS[1][0]} THEN {q(V.ENGAGEMENT_BANDS[1][1])}
       ELSE {q(V.ENGAGEMENT_ELSE)} END AS engagement_band
FROM staging""")

ORACLE["q46_engagement_by_dept"] = with_hr(
    f"""SELECT Department, Attrition, {R(f'AVG({_IDX})', 2)} AS avg_engagement_index, {N} AS employee_count,
  {R(f'AVG({_IDX}) - AVG(AVG({_IDX})) OVER (PARTITION BY Department)', 2)} AS vs_dept_avg
FROM staging GROUP BY Department, Attrition""")

ORACLE["q47_hire_timeline"] = with_hr(
    """SELECT hire_year, COUNT(*) AS new_hires,
  CAST(SUM(COUNT(*)) OVER (ORDER BY hire_year) AS BIGINT) AS cumulative_headcount
FROM eh GROUP BY hire_year""",
    f"""eh AS (SELECT CAST(DATE_TRUNC('year', {AS_OF_SQL} - TO_YEARS(YearsAtCompany)) AS DATE) AS hire_year
  FROM staging WHERE YearsAtCompany IS NOT NULL)""")

ORACLE["q48_job_hopping"] = with_hr(
    f"""SELECT {case_band('NumCompaniesWorked', V.JOB_HOP_BANDS, V.JOB_HOP_ELSE)} AS job_hopping_band,
  {N} AS total_employees, {YES_N} AS attritions, {RATE2} AS attrition_rate_pct,
  {R('AVG(YearsAtCompany)', 1)} AS avg_tenure_here
FROM staging GROUP BY 1""")

ORACLE["q49_dashboard"] = with_hr(
    f"""SELECT CAST(RANK() OVER (ORDER BY CAST(exits AS DOUBLE) / NULLIF(total, 0) DESC NULLS FIRST) AS INTEGER) AS attrition_rank,
  Department, total, exits, {R(PCT('exits', 'total'), 2)} AS attrition_rate_pct, avg_income, avg_satisfaction,
  avg_tenure, avg_wlb, avg_env_satisfaction, {R(PCT('overtime_count', 'total'), 1)} AS overtime_rate_pct,
  avg_stock_level
FROM per_dept""",
    f"""per_dept AS (
  SELECT Department, {N} AS total, {YES_N} AS exits, {R('AVG(MonthlyIncome)', 0)} AS avg_income,
    {R('AVG(JobSatisfaction)', 2)} AS avg_satisfaction, {R('AVG(YearsAtCompany)', 1)} AS avg_tenure,
    {R('AVG(WorkLifeBalance)', 2)} AS avg_wlb, {R('AVG(EnvironmentSatisfaction)', 2)} AS avg_env_satisfaction,
    COUNT(*) FILTER (WHERE OverTime = 'Yes') AS overtime_count, {R('AVG(StockOptionLevel)', 2)} AS avg_stock_level
  FROM staging GROUP BY Department)""")

ORACLE["q50_risk_proxy"] = with_hr(
    f"""SELECT EmployeeNumber, Department, JobRole, actual_attrition, MonthlyIncome, YearsAtCompany,
  CAST(p AS DOUBLE) AS attrition_prob_proxy,
  CASE WHEN p >= {V.PROXY_HIGH} THEN {q(V.PROXY_HIGH_LABEL)} WHEN p >= {V.PROXY_MEDIUM} THEN {q(V.PROXY_MEDIUM_LABEL)}
       ELSE {q(V.PROXY_LOW_LABEL)} END AS predicted_risk_level,
  CASE WHEN p >= {V.PROXY_MEDIUM} AND actual_attrition = 'Yes' THEN {q(V.TRUE_POSITIVE)}
       WHEN p >= {V.PROXY_MEDIUM} AND actual_attrition = 'No' THEN {q(V.FALSE_POSITIVE)}
       WHEN p < {V.PROXY_MEDIUM} AND actual_attrition = 'Yes' THEN {q(V.FALSE_NEGATIVE)}
       ELSE {q(V.TRUE_NEGATIVE)} END AS model_accuracy_check
FROM sc""",
    f"""sc AS (
  SELECT s.EmployeeNumber, s.Department, s.JobRole, s.Attrition AS actual_attrition, s.MonthlyIncome, s.YearsAtCompany,
    ROUND({weighted_sql(V.PROXY_FEATURES)}, 3) AS p
  FROM staging s LEFT JOIN performance_fact pf ON s.EmployeeNumber = pf.employee_id AND {SNAP})""")

ORACLE["qb_confusion"] = with_hr(
    f"""SELECT predicted, actual, {N} AS count, {R(PCT(N, 'SUM(COUNT(*)) OVER ()'), 2)} AS pct_of_total
FROM sc GROUP BY predicted, actual""",
    f"""sc AS (
  SELECT CASE WHEN ({weighted_sql(V.PROXY_FEATURES[:7])}) >= {V.PROXY_MEDIUM} THEN {q(V.PREDICTED_YES)}
              ELSE {q(V.PREDICTED_NO)} END AS predicted,
         Attrition AS actual
  FROM staging)""")

ORACLE["overall_rate"] = with_hr(
    f"""SELECT {N} AS total_employees, {YES_N} AS employees_left, {RATE2} AS attrition_rate_pct FROM staging""")

# ------------------------------------------------------------------ load: staging → star
_STAR = """dim_department AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY department_name) AS BIGINT) AS department_id, department_name
  FROM (SELECT DISTINCT Department AS department_name FROM staging) d),
dim_job_role AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY job_role_name) AS BIGINT) AS job_role_id, job_role_name
  FROM (SELECT DISTINCT JobRole AS job_role_name FROM staging) j),
dim_employee AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY EmployeeNumber, Age, Gender, MaritalStatus, Education, EducationField)
              AS BIGINT) AS employee_key,
    EmployeeNumber AS employee_id, Age AS age, Gender AS gender, MaritalStatus AS marital_status,
    Education AS education, EducationField AS education_field
  FROM staging),
fact_attrition AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY e.employee_key) AS BIGINT) AS attrition_id, e.employee_key,
    d.department_id, s.Attrition AS attrition, s.YearsAtCompany AS years_at_company,
    s.YearsInCurrentRole AS years_in_current_role, s.YearsSinceLastPromotion AS years_since_last_promotion,
    s.YearsWithCurrManager AS years_with_current_manager, CAST(s.MonthlyIncome AS DECIMAL(12,2)) AS monthly_income,
    CAST(NULL AS INT) AS percent_salary_hike, CAST(NULL AS INT) AS stock_option_level, CAST(NULL AS VARCHAR) AS overtime,
    CAST(NULL AS VARCHAR) AS business_travel, CAST(NULL AS INT) AS distance_from_home
  FROM staging s JOIN dim_employee e ON s.EmployeeNumber = e.employee_id
  JOIN dim_department d ON s.Department = d.department_name),
fact_performance AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY e.employee_key) AS BIGINT) AS performance_id, e.employee_key,
    j.job_role_id, d.department_id, s.PerformanceRating AS performance_rating, s.JobSatisfaction AS job_satisfaction,
    s.EnvironmentSatisfaction AS environment_satisfaction, s.RelationshipSatisfaction AS relationship_satisfaction,
    s.WorkLifeBalance AS work_life_balance
  FROM staging s JOIN dim_employee e ON s.EmployeeNumber = e.employee_id
  JOIN dim_job_role j ON s.JobRole = j.job_role_name
  JOIN dim_department d ON s.Department = d.department_name)"""

for _name in ("dim_department", "dim_job_role", "dim_employee", "fact_attrition", "fact_performance"):
    ORACLE[f"load_{_name}"] = with_hr(f"SELECT * FROM {_name}", _STAR)

ORACLE["load_staging"] = with_hr("SELECT * FROM staging")

ORACLE["dim_time"] = with_hr(
    """SELECT CAST(ROW_NUMBER() OVER (ORDER BY m) AS BIGINT) AS time_key, CAST(YEAR(m) AS INT) AS year,
  CAST(QUARTER(m) AS INT) AS quarter, CAST(MONTH(m) AS INT) AS month, MONTHNAME(m) AS month_name
FROM (SELECT CAST(UNNEST(GENERATE_SERIES(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS m FROM span) g""",
    """span AS (SELECT CAST(DATE_TRUNC('month', MIN(event_date)) AS TIMESTAMP) AS lo,
  CAST(DATE_TRUNC('month', MAX(event_date)) AS TIMESTAMP) AS hi FROM retention_fact)""")


# The rules of the warehouse, written out here once more so that a rule missing on the Spark side shows.
_UNIQUE = (("dim_department", "department_id"), ("dim_department", "department_name"), ("dim_job_role", "job_role_id"),
           ("dim_job_role", "job_role_name"), ("dim_employee", "employee_key"), ("dim_employee", "employee_id"),
           ("fact_attrition", "attrition_id"), ("fact_performance", "performance_id"))
_NOT_NULL = (("dim_department", "department_name"), ("dim_job_role", "job_role_name"), ("dim_employee", "employee_id"))
_MAX_LENGTH = (("dim_department", "department_name", 100), ("dim_job_role", "job_role_name", 100),
               ("dim_employee", "gender", 20), ("dim_employee", "marital_status", 30),
               ("dim_employee", "education_field", 100), ("fact_attrition", "attrition", 10),
               ("fact_attrition", "overtime", 10), ("fact_attrition", "business_travel", 50))
_FOREIGN_KEY = (("fact_attrition", "employee_key", "dim_employee"), ("fact_attrition", "department_id", "dim_department"),
                ("fact_performance", "employee_key", "dim_employee"), ("fact_performance", "job_role_id", "dim_job_role"),
                ("fact_performance", "department_id", "dim_department"))
_LOOKUP_MISS = (("Department", "dim_department", "department_name"), ("JobRole", "dim_job_role", "job_role_name"),
                ("EmployeeNumber", "dim_employee", "employee_id"))


def _constraint_sql() -> str:
    def head(table: str, rule: str, column: str) -> str:
        return f"SELECT {q(table)} AS table_name, {q(rule)} AS rule, {q(column)} AS column_name, "

    parts = [head(t, "unique", c) + "CAST(COALESCE(SUM(n), 0) AS BIGINT) AS violations FROM (SELECT COUNT(*) AS n FROM "
             f"{t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) > 1) u" for t, c in _UNIQUE]
    parts += [head(t, "not_null", c) + f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS violations FROM {t}"
              for t, c in _NOT_NULL]
    parts += [head(t, "max_length", c) + f"CAST(COUNT(*) FILTER (WHERE LENGTH({c}) > {n}) AS BIGINT) AS violations FROM {t}"
              for t, c, n in _MAX_LENGTH]
    parts += [head(t, "foreign_key", c) + f"CAST(COUNT(*) AS BIGINT) AS violations FROM {t} t WHERE t.{c} IS NOT NULL "
              f"AND NOT EXISTS (SELECT 1 FROM {ref} x WHERE x.{c} = t.{c})" for t, c, ref in _FOREIGN_KEY]
    parts += [head("staging", "lookup_miss", c) + "CAST(COUNT(*) AS BIGINT) AS violations FROM staging t WHERE "
              f"NOT EXISTS (SELECT 1 FROM {ref} x WHERE x.{k} = t.{c})" for c, ref, k in _LOOKUP_MISS]
    return with_hr("\nUNION ALL\n".join(parts), _STAR)


ORACLE["constraint_report"] = _constraint_sql()

_RATIO = "CAST(MonthlyIncome AS DOUBLE) / NULLIF(CAST(DailyRate AS DOUBLE), 0)"
ORACLE["pay_ratio_percentiles"] = with_hr(
    f"""SELECT Department, COUNT({_RATIO}) AS employees,
""" + ",\n".join(f"  {R(f'PERCENTILE_CONT(0.{p}) WITHIN GROUP (ORDER BY {_RATIO})', 4)} AS p{p}" for p in (10, 25, 50, 75, 90))
    + "\nFROM staging GROUP BY Department")

ORACLE["hierarchy_problems"] = with_hr(
    """SELECT n AS node, CASE WHEN loops THEN 'cycle' WHEN around IS NOT NULL THEN 'under_cycle' ELSE 'under_missing' END AS problem,
  COALESCE(around, missing) AS cause
FROM (
  SELECT e.n, MAX(CASE WHEN r.a = e.n THEN 1 ELSE 0 END) = 1 AS loops, MIN(c.low) AS around,
    MIN(CASE WHEN k.n IS NULL THEN r.a END) AS missing
  FROM edge e JOIN reach r ON r.n = e.n LEFT JOIN edge k ON k.n = r.a LEFT JOIN ring c ON c.n = r.a GROUP BY e.n) x
WHERE around IS NOT NULL OR missing IS NOT NULL""",
    """edge AS (
  SELECT EmployeeNumber AS n, CASE WHEN EmployeeNumber % 97 <> 0 THEN (EmployeeNumber * 31 + MonthlyIncome) % 2003 END AS up FROM staging),
reach AS (
  SELECT n, CAST(up AS BIGINT) AS a FROM edge WHERE up IS NOT NULL
  UNION
  SELECT reach.n, CAST(edge.up AS BIGINT) FROM reach JOIN edge ON edge.n = reach.a WHERE edge.up IS NOT NULL),
ring AS (
  SELECT x.n, MIN(y.a) AS low FROM reach x JOIN reach y ON y.n = x.n WHERE x.a = x.n GROUP BY x.n)""",
    recursive=True)

ORACLE["load_changes"] = with_hr(
    """SELECT kind, COUNT(*) AS employees FROM (
  SELECT CASE EmployeeNumber % 100 WHEN 3 THEN 'new' WHEN 2 THEN 'gone' ELSE
    CASE WHEN EmployeeNumber % 100 = 1 AND MonthlyIncome IS NOT NULL THEN 'changed' ELSE 'same' END END AS kind
  FROM staging) c GROUP BY kind""")

ORACLE["load_key_registry"] = with_hr(
    """SELECT EmployeeNumber AS employee_id,
  ROW_NUMBER() OVER (ORDER BY CASE WHEN EmployeeNumber % 3 = 0 THEN 1 ELSE 0 END, EmployeeNumber) AS employee_key
FROM staging""")

ORACLE["load_csv_folder"] = ORACLE["load_staging"]
ORACLE["cohort_retention_bitmaps"] = ORACLE["q02_cohort_retention"]

ORACLE["score_review"] = with_hr(
    f"""SELECT s.EmployeeNumber AS employee_id, s.JobRole AS role, s.YearsAtCompany AS years,
  COALESCE(h.n_scores, 0) AS n_scores, h.mean_score, h.best_score, p.performance_score AS score_now
FROM staging s
LEFT JOIN (SELECT employee_id, COUNT(*) AS n_scores, {R('AVG(performance_score)', 4)} AS mean_score,
    MAX(performance_score) AS best_score FROM performance_fact GROUP BY employee_id) h ON h.employee_id = s.EmployeeNumber
LEFT JOIN performance_fact p ON p.employee_id = s.EmployeeNumber AND p.date_key = {AS_OF_SQL}""")


def _profile_sql() -> str:
    from ..sources.schemas import STAGING
    parts = [f"SELECT {q(f.name)} AS column_name, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE {f.name} IS NULL) "
             f"AS n_nulls, COUNT(DISTINCT {f.name}) AS n_distinct FROM staging" for f in STAGING.fields]
    return with_hr("\nUNION ALL\n".join(parts))


ORACLE["profile"] = _profile_sql()
ORACLE["exits_trend_by_file"] = ORACLE["q01_monthly_exits_rolling"]
