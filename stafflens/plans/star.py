"""Staging → star schema: the load steps as one plan (dims first, then facts).

Each table is built once for a state of its source and stored as Parquet in the
shared checkpoint folder; the facts read the stored dimensions, the constraint
report reads all of them, and every later call reads what is there. For a
source given as frames, staging is checkpointed once and the tables are built
per ``Star``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.warehouse import Lookup, build_dim, build_dim_time, build_fact, check_constraints, star_rules
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import HrTables, stored
from ..sources import schemas
from ..sources.schemas import VARCHAR_LIMITS
from ..sources.sinks import conform, write_table

# Declared schema of every star table (DDL), used when the tables are written.
TABLE_SCHEMAS = {
    "dim_department": schemas.DIM_DEPARTMENT, "dim_job_role": schemas.DIM_JOB_ROLE,
    "dim_employee": schemas.DIM_EMPLOYEE, "dim_time": schemas.DIM_TIME,
    "fact_attrition": schemas.FACT_ATTRITION, "fact_performance": schemas.FACT_PERFORMANCE,
}

DEPT = {"Department": "department_name"}
ROLE = {"JobRole": "job_role_name"}
EMPLOYEE = {"EmployeeNumber": "employee_id", "Age": "age", "Gender": "gender", "MaritalStatus": "marital_status",
            "Education": "education", "EducationField": "education_field"}
ATTRITION_MEASURES = [
    ("Attrition", "attrition", None), ("YearsAtCompany", "years_at_company", None),
    ("YearsInCurrentRole", "years_in_current_role", None),
    ("YearsSinceLastPromotion", "years_since_last_promotion", None),
    ("YearsWithCurrManager", "years_with_current_manager", None),
    ("MonthlyIncome", "monthly_income", "decimal(12,2)"),
]
# Columns of the fact that the source's load leaves NULL, though staging has them.
ATTRITION_OMITTED = [
    ("PercentSalaryHike", "percent_salary_hike", None), ("StockOptionLevel", "stock_option_level", None),
    ("OverTime", "overtime", None), ("BusinessTravel", "business_travel", None),
    ("DistanceFromHome", "distance_from_home", None),
]
PERFORMANCE_MEASURES = [
    ("PerformanceRating", "performance_rating", None), ("JobSatisfaction", "job_satisfaction", None),
    ("EnvironmentSatisfaction", "environment_satisfaction", None),
    ("RelationshipSatisfaction", "relationship_satisfaction", None), ("WorkLifeBalance", "work_life_balance", None),
]


class Star:
    """Lazily built star tables of one data directory (each built once).

    ``fill_omitted`` also loads the five attrition columns that the source's
    INSERT does not list and so leaves NULL.
    """

    def __init__(self, t: HrTables, materialize: bool = True, fill_omitted: bool = False):
        self.t = t
        self.materialize = materialize
        self.fill_omitted = fill_omitted
        self._cache: dict[str, DataFrame] = {}

    def _once(self, name, build):
        if name not in self._cache:
            keep = self.materialize and self.t.materialize and name != "staging"
            self._cache[name] = stored(self.t, f"star_{name}", build) if keep else build()
        return self._cache[name]

    def staging(self) -> DataFrame:
        def build():
            stg = self.t.staging()
            if self.materialize and not self.t.materialize:
                ensure_checkpoint_dir(stg.sparkSession)
                stg = stg.checkpoint(eager=True)
            return stg
        return self._once("staging", build)

    def dim_department(self) -> DataFrame:
        return self._once("dim_department", lambda: build_dim(
            self.staging(), DEPT, "department_id",
            natural_key="department_name"))

    def dim_job_role(self) -> DataFrame:
        return self._once("dim_job_role", lambda: build_dim(
            self.staging(), ROLE, "job_role_id",
            natural_key="job_role_name"))

    def dim_employee(self) -> DataFrame:
        return self._once("dim_employee", lambda: build_dim(
            self.staging(), EMPLOYEE, "employee_key",
            distinct=False, order=["employee_id"], natural_key="employee_id"))

    def _emp_lookup(self) -> Lookup:
        return Lookup(self.dim_employee(), "EmployeeNumber", "employee_id", "employee_key")

    def _dept_lookup(self) -> Lookup:
        return Lookup(self.dim_department(), "Department", "department_name", "department_id", small=True)

    def fact_attrition(self) -> DataFrame:
        measures = ATTRITION_MEASURES + (ATTRITION_OMITTED if self.fill_omitted else [])
        name = "fact_attrition_filled" if self.fill_omitted else "fact_attrition"
        return self._once(name, lambda: conform(build_fact(
            self.staging(), [self._emp_lookup(), self._dept_lookup()], measures,
            "attrition_id", "employee_key"), schemas.FACT_ATTRITION))

    def fact_performance(self) -> DataFrame:
        role = Lookup(self.dim_job_role(), "JobRole", "job_role_name", "job_role_id", small=True)
        return self._once("fact_performance", lambda: build_fact(
            self.staging(), [self._emp_lookup(), role, self._dept_lookup()], PERFORMANCE_MEASURES,
            "performance_id", "employee_key"))

    def dim_time(self) -> DataFrame:
        return self._once("dim_time", lambda: build_dim_time(self.t.retention_fact(), "event_date"))

    def constraint_report(self) -> DataFrame:
        tables = {
            "staging": self.staging(), "dim_department": self.dim_department(), "dim_job_role": self.dim_job_role(),
            "dim_employee": self.dim_employee(), "fact_attrition": self.fact_attrition(),
            "fact_performance": self.fact_performance(),
        }
        return check_constraints(tables, star_rules(VARCHAR_LIMITS))

    def write(self, root: str, mode: str = "overwrite") -> dict[str, str]:
        """Write the six star tables (dims first, then facts) with their declared
        schemas under ``root``; returns table → path."""
        paths = {}
        for name, schema in TABLE_SCHEMAS.items():
            path = f"{root.rstrip('/')}/{name}"
            write_table(getattr(self, name)(), path, schema=schema, mode=mode)
            paths[name] = path
        return paths
