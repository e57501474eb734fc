"""Declared schemas of the staging table, the implied tables and the star.

Names follow the analyses: staging keeps the mixed-case CSV header names, the
warehouse uses snake_case. Employee ids are BIGINT throughout (the DDL's INT
would overflow at scale).
"""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _D = T.LongType(), T.IntegerType(), T.StringType(), T.DateType()


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# Staging: one row per employee. 30 columns used by the analyses, plus the
# manager edge and the hire date that the hierarchy and cohort analyses need.
STAGING = _struct(
    ("EmployeeNumber", _L, False),
    ("Age", _I, True),
    ("Gender", _S, True),
    ("MaritalStatus", _S, True),
    ("Department", _S, True),
    ("JobRole", _S, True),
    ("Education", _I, True),
    ("EducationField", _S, True),
    ("Attrition", _S, True),
    ("OverTime", _S, True),
    ("BusinessTravel", _S, True),
    ("MonthlyIncome", _I, True),
    ("DailyRate", _I, True),
    ("HourlyRate", _I, True),
    ("PercentSalaryHike", _I, True),
    ("StockOptionLevel", _I, True),
    ("JobLevel", _I, True),
    ("JobSatisfaction", _I, True),
    ("EnvironmentSatisfaction", _I, True),
    ("RelationshipSatisfaction", _I, True),
    ("WorkLifeBalance", _I, True),
    ("JobInvolvement", _I, True),
    ("PerformanceRating", _I, True),
    ("DistanceFromHome", _I, True),
    ("NumCompaniesWorked", _I, True),
    ("TrainingTimesLastYear", _I, True),
    ("YearsAtCompany", _I, True),
    ("YearsInCurrentRole", _I, True),
    ("YearsSinceLastPromotion", _I, True),
    ("YearsWithCurrManager", _I, True),
    ("ManagerId", _L, True),
    ("hire_date", _D, True),
)

RETENTION_FACT = _struct(("employee_id", _L, False), ("event_date", _D, True), ("event_type", _S, True))

PERFORMANCE_FACT = _struct(("employee_id", _L, False), ("date_key", _D, False), ("performance_score", _I, True))

DIM_EMPLOYEE_WIDE = _struct(
    ("employee_id", _L, False), ("department", _S, True), ("role", _S, True),
    ("gender", _S, True), ("hire_date", _D, True), ("manager_id", _L, True),
)

DIM_DEPARTMENT = _struct(("department_id", _L, False), ("department_name", _S, False))

DIM_JOB_ROLE = _struct(("job_role_id", _L, False), ("job_role_name", _S, False))

DIM_EMPLOYEE = _struct(
    ("employee_key", _L, False), ("employee_id", _L, False), ("age", _I, True), ("gender", _S, True),
    ("marital_status", _S, True), ("education", _I, True), ("education_field", _S, True),
)

DIM_TIME = _struct(
    ("time_key", _L, False), ("year", _I, True), ("quarter", _I, True), ("month", _I, True),
    ("month_name", _S, True),
)

FACT_PERFORMANCE = _struct(
    ("performance_id", _L, False), ("employee_key", _L, True), ("job_role_id", _L, True),
    ("department_id", _L, True), ("performance_rating", _I, True), ("job_satisfaction", _I, True),
    ("environment_satisfaction", _I, True), ("relationship_satisfaction", _I, True),
    ("work_life_balance", _I, True),
)

FACT_ATTRITION = _struct(
    ("attrition_id", _L, False), ("employee_key", _L, True), ("department_id", _L, True),
    ("attrition", _S, True), ("years_at_company", _I, True), ("years_in_current_role", _I, True),
    ("years_since_last_promotion", _I, True), ("years_with_current_manager", _I, True),
    ("monthly_income", T.DecimalType(12, 2), True), ("percent_salary_hike", _I, True),
    ("stock_option_level", _I, True), ("overtime", _S, True), ("business_travel", _S, True),
    ("distance_from_home", _I, True),
)

# Declared text lengths (VARCHAR(n)) checked by the constraint report.
VARCHAR_LIMITS = {
    "dim_department": {"department_name": 100},
    "dim_job_role": {"job_role_name": 100},
    "dim_employee": {"gender": 20, "marital_status": 30, "education_field": 100},
    "dim_time": {"month_name": 20},
    "fact_attrition": {"attrition": 10, "overtime": 10, "business_travel": 50},
}
