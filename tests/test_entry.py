"""Driver contract: entry / queries / oracle_sql."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    mod = _entry_module()
    df = mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:2] == ["attrition_rank", "Department"]


def test_queries_and_oracles_align():
    mod = _entry_module()
    q, o = mod.queries(), mod.oracle_sql()
    assert len(q) >= 60
    assert set(o) <= set(q)
    from stafflens.plans.catalog import CATALOG
    assert set(CATALOG) <= set(o)


def test_cli_list_and_run(spark, capsys, tmp_path):
    from conftest import SF_SMALL
    from stafflens.__main__ import main
    assert main(["list"]) == 0
    assert "q49_dashboard" in capsys.readouterr().out.split()
    out = tmp_path / "q04"
    assert main(["run", "q04_rate_marital", "--sf", SF_SMALL, "--out", str(out)]) == 0
    assert spark.read.parquet(str(out)).count() == 3


def test_csv_staging_source_runs_the_catalog(spark, tmp_path):
    """A user's own HR snapshot as CSV: header matched by name (any order, extra
    columns, a byte-order mark), all keys run, staging keys equal the built-in path."""
    import csv
    from conftest import SF_SMALL
    from stafflens.plans.catalog import CATALOG
    from stafflens.sources.fixtures import HrTables, register_csv_source
    base = HrTables(spark, SF_SMALL).staging()
    cols = list(reversed(base.columns)) + ["EmployeeCount"]
    path = tmp_path / "hr.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["\ufeff" + cols[0]] + cols[1:])
        for r in base.collect():
            d = r.asDict()
            w.writerow([("" if d.get(c) is None else d[c]) if c in d else 1 for c in cols])
    name = register_csv_source(spark, str(path))
    for key in ("q04_rate_marital", "q49_dashboard", "q24_salary_percentiles", "q41_org_depth"):
        a = sorted(map(tuple, CATALOG[key](spark, name).collect()))
        b = sorted(map(tuple, CATALOG[key](spark, SF_SMALL).collect()))
        assert a == b, key
    assert CATALOG["q14_score_distribution"](spark, name).count() == 0  # no score history given
