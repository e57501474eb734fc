"""Every catalog key against its DuckDB oracle (row count, names, types, values)."""

import pytest

from conftest import SF_MEDIUM, SF_SMALL
from stafflens.plans.catalog import CATALOG
from stafflens.plans.check import compare, duck_connection
from stafflens.plans.oracle import ORACLE

_CONS = {}


def _con(sf):
    if sf not in _CONS:
        _CONS[sf] = duck_connection(sf)
    return _CONS[sf]


def test_every_key_has_an_oracle():
    assert set(CATALOG) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(CATALOG))
def test_key_matches_oracle_sf0001(spark, key):
    r = compare(key, CATALOG[key](spark, SF_SMALL), ORACLE[key], _con(SF_SMALL))
    assert r.ok, "\n".join(r.notes)


# A cross-section at the driver's correctness scale: one per operator family.
MEDIUM_KEYS = ["q01_monthly_exits_rolling", "q02_cohort_retention", "q03_rate_dept_gender", "q13_rank_in_role",
               "q17_decile_extremes", "q22_declining", "q24_salary_percentiles", "q28_below_median",
               "q41_org_depth", "q49_dashboard", "q50_risk_proxy", "load_fact_attrition"]


@pytest.mark.parametrize("key", MEDIUM_KEYS)
def test_key_matches_oracle_sf001(spark, key):
    r = compare(key, CATALOG[key](spark, SF_MEDIUM), ORACLE[key], _con(SF_MEDIUM))
    assert r.ok, "\n".join(r.notes)
