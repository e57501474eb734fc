"""The star loaded again with a hundredth of its employees changed, against one built from scratch."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from stafflens.operators.warehouse import Rule, check_constraints
from stafflens.plans.incremental import IncrementalStar
from stafflens.sources.fixtures import HrTables


def resolved(star, name):
    """A table's rows with natural keys in place of surrogate ones."""
    out = star.read(name)
    for registry, (natural, key) in star.REGISTRIES.items():
        if key in out.columns:
            out = out.join(star.registry[registry].read(), key).drop(key)
    return sorted(map(str, out.drop("attrition_id", "performance_id").collect()))


def test_second_load_equals_a_full_build_and_writes_touched_buckets(spark, tmp_path):
    number = F.col("EmployeeNumber")
    first = HrTables(spark, SF_SMALL).staging().where("EmployeeNumber % 100 != 3")
    second = (HrTables(spark, SF_SMALL).staging().where("EmployeeNumber % 100 != 2")
              .withColumn("MonthlyIncome", F.when(number % 100 == 1, -5).otherwise(F.col("MonthlyIncome")).cast("int"))
              .withColumn("JobRole", F.when(number % 100 == 1, "new role").otherwise(F.col("JobRole"))))
    star = IncrementalStar(spark, f"{tmp_path}/star")
    star.load(first, buckets=16)
    keys = {r.EmployeeNumber: r.employee_key for r in star.registry["employee"].read().collect()}
    before = {n: t.commit_of().parts for n, t in star.table.items()}
    loads = star.load(second)
    n = second.count()
    changed, new, gone = second.where(number % 100 == 1).count(), second.where(number % 100 == 3).count(), first.where(number % 100 == 2).count()
    # A new role and pay reach the facts only; the dimension's own columns stay.
    assert loads["dim_employee"].counts == {"new": new, "changed": 0, "gone": gone, "same": n - new}
    for name in ("fact_attrition", "fact_performance"):
        assert loads[name].counts == {"new": new, "changed": changed, "gone": gone, "same": n - new - changed}
    for name, load in loads.items():
        after = star.table[name].commit_of().parts
        assert {b for b in after if after[b] != before[name].get(b)} <= set(map(str, load.touched)) and len(load.touched) < 16
    now = {r.EmployeeNumber: r.employee_key for r in star.registry["employee"].read().collect()}
    assert {k: now[k] for k in keys} == keys and sorted(now.values()) == list(range(1, len(now) + 1))

    fresh = IncrementalStar(spark, f"{tmp_path}/fresh")
    fresh.load(second)
    for name in star.TABLES:
        assert resolved(star, name) == resolved(fresh, name), name


def violations(tables, *rules):
    return {(r.table_name, r.rule, r.column_name): r.violations for r in check_constraints(tables, rules).collect()}


def test_bitmaps_and_distinct_values_count_alike(spark):
    """Dense keys go by bitmap, sparse ones by distinct value; planted violations are exact either way."""
    fact = spark.createDataFrame([(1, 1, 10**15, "a"), (2, 1, 10**15, "b"), (2, 9, 5, "c"), (None, None, None, None), (4, 70_000, -3, "a")],
                                 "id long, fk int, far long, name string")
    dim = spark.createDataFrame([(1, 5, "a"), (2, 10**15, "b"), (3, 7, "b"), (70_000, 8, "x")], "key long, far long, name string")
    dense = dim.where("key < 4")
    got = violations({"fact": fact, "dim": dim, "dense": dense},
                     Rule("fact", "unique", "id"), Rule("fact", "unique", "far"), Rule("fact", "unique", "name"), Rule("dense", "unique", "key"),
                     Rule("fact", "foreign_key", "id", ref_table="dense", ref_column="key"), Rule("fact", "foreign_key", "fk", ref_table="dim", ref_column="key"),
                     Rule("fact", "foreign_key", "far", ref_table="dim", ref_column="far"), Rule("fact", "lookup_miss", "id", ref_table="dense", ref_column="key"),
                     Rule("fact", "lookup_miss", "name", ref_table="dim", ref_column="name"), Rule("dense", "foreign_key", "key", ref_table="fact", ref_column="id"),
                     Rule("dim", "lookup_miss", "key", ref_table="dim", ref_column="key"), Rule("fact", "not_null", "fk"), Rule("dim", "max_length", "name", limit=0))
    assert got == {("fact", "unique", "id"): 2, ("fact", "unique", "far"): 2, ("fact", "unique", "name"): 2, ("dense", "unique", "key"): 0,
                   ("fact", "foreign_key", "id"): 1, ("fact", "foreign_key", "fk"): 1, ("fact", "foreign_key", "far"): 1,
                   ("fact", "lookup_miss", "id"): 2, ("fact", "lookup_miss", "name"): 2, ("dense", "foreign_key", "key"): 1,
                   ("dim", "lookup_miss", "key"): 0, ("fact", "not_null", "fk"): 1, ("dim", "max_length", "name"): 4}


def test_empty_tables_hold_all_rules(spark):
    empty = spark.createDataFrame([], "id long, name string")
    rules = [Rule("t", "unique", "id"), Rule("t", "foreign_key", "id", ref_table="t", ref_column="id"), Rule("t", "lookup_miss", "name", ref_table="t", ref_column="name"), Rule("t", "not_null", "id")]
    assert set(violations({"t": empty}, *rules).values()) == {0}


def test_rows_are_not_shuffled_by_reference_rules(spark):
    """A hot key with many rows costs one bitmap: nothing of its rows but counts reaches an exchange."""
    fact = spark.range(200_000).select((F.col("id") % 3 + 1).alias("fk"), F.lit("x" * 50).alias("wide"))
    dim = spark.range(1, 4).withColumnRenamed("id", "key")
    got = violations({"fact": fact, "dim": dim}, Rule("fact", "foreign_key", "fk", ref_table="dim", ref_column="key"), Rule("dim", "unique", "key"))
    assert set(got.values()) == {0}
