"""Joins on the employee without exchange, and distinct employees by bitmap."""

import datetime as dt
import random
import re

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from stafflens.operators import trends
from stafflens.plans.catalog import CATALOG
from stafflens.plans.check import compare, duck_connection
from stafflens.plans.oracle import ORACLE
from stafflens.sources import bucketed
from stafflens.sources.fixtures import HrTables, register_source

STATEMENTS = ["q12_flight_risk", "q15_role_vs_dept", "q18_score_by_tenure", "q19_score_by_training", "q20_score_by_satisfaction", "q50_risk_proxy"]


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    """Exchanges by the employee's hash in the plan as it was made."""
    return re.findall(r"Exchange hashpartitioning\((?:EmployeeNumber|employee_id)#[^\n]*", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("key", STATEMENTS)
def test_statements_join_without_exchange(no_broadcast, key):
    name = register_source("bucketed", bucketed.BucketedTables(no_broadcast, SF_SMALL, buckets=4))
    df = CATALOG[key](no_broadcast, name)
    assert exchanges(df) == []
    assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
    result = compare(key, df, ORACLE[key], duck_connection(SF_SMALL))
    assert result.ok, "\n".join(result.notes)


@pytest.mark.parametrize("key", ["score_review", "cohort_retention_bitmaps"])
def test_keys_equal_sql(no_broadcast, key):
    df = CATALOG[key](no_broadcast, SF_SMALL)
    assert exchanges(df) == []
    result = compare(key, df, ORACLE[key], duck_connection(SF_SMALL))
    assert result.ok, "\n".join(result.notes)


def test_a_hot_employee_leaves_the_history_unbucketed(spark):
    plain = HrTables(spark, SF_SMALL).performance_fact()
    most = bucketed.largest_group(plain, "employee_id")
    rows = {}
    for bound in (most, most - 1):
        t = bucketed.BucketedTables(spark, SF_SMALL, buckets=3, most_rows=bound)
        rows[bound] = t.performance_fact()
    assert "Bucketed: true" in rows[most]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) or "SelectedBucketsCount" in rows[most].groupBy("employee_id").count()._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, plain.select("employee_id", "date_key", "performance_score").collect()))
    for df in rows.values():
        assert sorted(map(tuple, df.select("employee_id", "date_key", "performance_score").collect())) == want


def test_bitmaps_equal_pairs_with_nulls_repeats_and_a_hot_year(spark):
    rng = random.Random(4)
    days = [dt.date(y, 3, 1) for y in (2018, 2019, 2020, 2020, 2020)] + [None]
    ids = [*range(0, 200), *range(32_700, 32_800), 10**9, 5 * 10**9, None, None]
    members = [(i, rng.choice(days)) for i in ids] + [(7, dt.date(2020, 5, 5))] * 500
    events = [(rng.choice(ids), rng.choice(days), rng.choice(["exit", "exit", "other"])) for _ in range(900)]
    m = spark.createDataFrame(members, "employee_id long, hire_date date")
    e = spark.createDataFrame(events, "employee_id long, event_date date, event_type string")
    options = {"as_of": dt.date(2021, 1, 1), "event_type": "exit"}
    got = trends.cohort_retention_bitmaps(m, e, **options)
    assert sorted(got.collect()) == sorted(trends.cohort_retention(m, e, **options).collect())
    assert got.dtypes == trends.cohort_retention(m, e, **options).dtypes
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert trends.cohort_retention_bitmaps(m.limit(0), e, **options).count() == 0
    assert sorted(trends.cohort_retention_bitmaps(m, e.where(F.lit(False)), **options).collect()) == sorted(trends.cohort_retention(m, e.where(F.lit(False)), **options).collect())
