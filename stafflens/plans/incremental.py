"""Warehouse loads that come again: changes only, and keys that stay.

``IncrementalStar`` keeps the employee dimension and both facts as versioned
tables. A load registers the natural keys it has not seen, looks the keys up
and lets ``load_changes`` write the buckets of employees that are new, changed
or gone. The star of a second load is the one a load from scratch would build
over the same registries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.trends import monthly_counts
from ..sources.fixtures import HrTables, stored_path
from ..sources.versions import Load, VersionedTable, assign_keys, current_rows, load_by_file, load_changes
from .fixed_values import EXIT_EVENT
from .star import ATTRITION_MEASURES, EMPLOYEE, PERFORMANCE_MEASURES

#: This process writes versioned tables under a name of its own.
_RUN = uuid.uuid4().hex


class IncrementalStar:
    """The star under ``root``, loaded again and again from snapshots of staging."""

    REGISTRIES = {"department": ("Department", "department_id"), "job_role": ("JobRole", "job_role_id"),
                  "employee": ("EmployeeNumber", "employee_key")}
    TABLES = ("dim_employee", "fact_attrition", "fact_performance")

    def __init__(self, spark, root: str):
        self.registry = {n: VersionedTable(spark, f"{root}/keys_{n}") for n in self.REGISTRIES}
        self.table = {n: VersionedTable(spark, f"{root}/{n}") for n in self.TABLES}

    def load(self, staging: DataFrame, buckets: int = 64) -> dict[str, Load]:
        """One load of a full snapshot; the employee number is unique in it."""
        keyed = staging
        for name, (natural, key) in self.REGISTRIES.items():
            keyed = assign_keys(self.registry[name], keyed, [natural], key)
        keyed = keyed.checkpoint(eager=True)
        measure = lambda m: [(F.col(s).cast(kind) if kind else F.col(s)).alias(d) for s, d, kind in m]
        snapshots = {
            "dim_employee": keyed.select("employee_key", *[F.col(s).alias(d) for s, d in EMPLOYEE.items()]),
            # One row per employee: the fact's own key is the employee's.
            "fact_attrition": keyed.where("department_id IS NOT NULL").select(
                F.col("employee_key").alias("attrition_id"), "employee_key", "department_id", *measure(ATTRITION_MEASURES)),
            "fact_performance": keyed.where("department_id IS NOT NULL AND job_role_id IS NOT NULL").select(
                F.col("employee_key").alias("performance_id"), "employee_key", "job_role_id", "department_id",
                *measure(PERFORMANCE_MEASURES)),
        }
        return {n: load_changes(self.table[n], df, "employee_key", buckets=buckets) for n, df in snapshots.items()}

    def read(self, name: str) -> DataFrame:
        return current_rows(self.table[name])


def changed_twice(t: HrTables) -> VersionedTable:
    """Staging loaded in two states: the second has other employees in a hundredth, lacks one and raises another's pay."""
    kind = F.col("EmployeeNumber") % 100

    def write(path: str) -> None:
        stg, table = t.staging(), VersionedTable(t.spark, path)
        load_changes(table, stg.where(kind != 3), "EmployeeNumber")
        raised = F.when(kind == 1, F.col("MonthlyIncome") + 1).otherwise(F.col("MonthlyIncome")).cast("int")
        load_changes(table, stg.where(kind != 2).withColumn("MonthlyIncome", raised), "EmployeeNumber")
    return VersionedTable(t.spark, stored_path(t, f"changes_{_RUN}", write))


def keys_twice(t: HrTables) -> VersionedTable:
    """Employee keys of two loads: two thirds of staging, then all of it."""
    def write(path: str) -> None:
        ids = t.staging().select(F.col("EmployeeNumber").alias("employee_id"))
        registry = VersionedTable(t.spark, path)
        assign_keys(registry, ids.where("employee_id % 3 != 0"), ["employee_id"], "employee_key")
        assign_keys(registry, ids, ["employee_id"], "employee_key")
    return VersionedTable(t.spark, stored_path(t, f"keys_{_RUN}", write))


def month_counts(rows: DataFrame, key: str) -> DataFrame:
    """Exits per month and file of rows of ``orders``."""
    exits = rows.where(F.col("o_orderstatus") == "F")
    return exits.groupBy(key, F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.count(F.lit(1)).alias("attrition_count"))


def exits_by_file(t: HrTables) -> DataFrame:
    """(month, attrition_count), a row for each month and file of the source's orders; a source
    given as frames has no files and is counted whole."""
    if not t.materialize:
        return monthly_counts(t.retention_fact(), event_type=EXIT_EVENT, count_name="attrition_count")
    table = VersionedTable(t.spark, stored_path(t, f"exits_{_RUN}", lambda path: None))
    load_by_file(table, f"{t.sf_dir.rstrip('/')}/orders.parquet", lambda files: t.spark.read.parquet(*files), month_counts)
    return table.read().select("month", "attrition_count")
