"""Every staging-based key with NULLs injected into every staging column but the
key, compared with its oracle on the same table (SURVEY Appendix A traps)."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_MEDIUM
from stafflens.plans.catalog import CATALOG
from stafflens.plans.check import compare, duck_connection
from stafflens.plans.oracle import ORACLE
from stafflens.sources import fixtures

STAGING_FREE = {"q01_monthly_exits_rolling", "q11_rolling_3m", "q14_score_distribution", "q16_score_delta",
                "dim_time", "exits_trend_by_file"}
KEYS = sorted(k for k in CATALOG if k not in STAGING_FREE)

# The staging CTE of the oracle texts, replaced by the NULL-laden table.
_STAGING_CTE = re.compile(r"staging AS \(\n  SELECT\n.*?LEFT JOIN l ON l\.o_custkey = c\.c_custkey\)", re.S)


@pytest.fixture(scope="module")
def null_staging(spark, tmp_path_factory):
    base = fixtures.HrTables(spark, SF_MEDIUM).staging()
    cols = []
    for i, c in enumerate(base.columns):
        if c == "EmployeeNumber":
            cols.append(F.col(c))
        else:  # about one row in eleven per column, a different slice per column
            cols.append(F.when((F.col("EmployeeNumber") + i) % 11 == 0, F.lit(None)).otherwise(F.col(c)).alias(c))
    path = str(tmp_path_factory.mktemp("nulls") / "staging")
    base.select(*cols).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def duck(null_staging):
    con = duck_connection(SF_MEDIUM)
    con.execute(f"CREATE TABLE staging_nulls AS SELECT * FROM read_parquet('{null_staging}/*.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_key_with_null_staging(spark, duck, null_staging, monkeypatch, key):
    table = spark.read.parquet(null_staging)
    monkeypatch.setattr(fixtures.HrTables, "staging", lambda self: table)
    # A directory spelling of its own, so no plan cached for the clean tables is reused.
    sf = SF_MEDIUM + "/"
    sql, n = _STAGING_CTE.subn("staging AS (SELECT * FROM staging_nulls)", ORACLE[key])
    assert n == 1
    r = compare(key, CATALOG[key](spark, sf), sql, duck)
    assert r.ok, "\n".join(r.notes)
