"""Staging and score history stored bucketed and sorted by employee: joins on the employee key without exchange.

A bucketed table is written with one hash partitioning of its key; Spark knows it
from the session's catalog and joins or groups two tables of equal bucketing on
the key as they lie. The shuffle is paid once, at the load, and not by every
statement that joins on the employee.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import HrTables, _plan, dim_employee_wide, performance_fact, stored_path

#: A key with more rows makes one bucket, so one task of every join, too large.
MOST_ROWS = 1_000_000


def write_bucketed(df: DataFrame, key: str, path: str, buckets: int) -> DataFrame:
    """Write ``df`` as ``buckets`` files by the hash of ``key``, each sorted by it, and read it back by its catalog entry.

    The entry has a name of its own and lasts as long as the session's catalog does;
    the files lie at ``path``. A null key is a value like any other.
    """
    name = f"stafflens_bucketed_{uuid.uuid4().hex}"
    spread = df.repartition(buckets, key)  # the buckets' own hash: a task holds whole buckets and writes one file for each
    spread.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def largest_group(df: DataFrame, key: str) -> int:
    """Rows of the most frequent key (partial counts per task)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


class BucketedTables(HrTables):
    """HR tables whose staging and score history are bucketed by the employee.

    ``buckets`` is to be chosen for 128 to 256 MB a bucket (default: the session's
    shuffle partitions). A history in which one employee has more than ``most_rows``
    rows stays as it is: there a shuffle join, which the adaptive planner can split,
    is the better plan.
    """

    def __init__(self, spark, sf_dir: str, buckets: int | None = None, most_rows: int = MOST_ROWS):
        super().__init__(spark, sf_dir)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.most_rows = most_rows

    def _bucketed(self, name: str, key: str, build) -> DataFrame:
        def write_then_read() -> DataFrame:
            df = build()
            if name != "staging" and largest_group(df, key) > self.most_rows:
                return df
            found = []
            stored_path(self, f"{name}-by-{key}-{self.buckets}", lambda path: found.append(write_bucketed(df, key, path, self.buckets)))
            return found[0]
        return _plan(self.spark, ("bucketed", name, self.sf_dir, self.signature, self.buckets, self.most_rows), write_then_read)

    def staging(self) -> DataFrame:
        return self._bucketed("staging", "EmployeeNumber", super().staging)

    def performance_fact(self) -> DataFrame:
        return self._bucketed("performance_fact", "employee_id", lambda: performance_fact(self.spark, self.sf_dir))

    def dim_employee_wide(self) -> DataFrame:
        return dim_employee_wide(self.staging())
