
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stafflens.functions.bands import band, label
from stafflens.functions.numeric import fround
from stafflens.operators import hierarchy, ranking, rates, scoring, stats, trends, warehouse
from stafflens.plans import fixed_values as V


def test_t_const_correlation_zero_variance_is_null(spark):
    df = spark.createDataFrame([(5, "Yes"), (5, "No"), (5, "Yes")], "d int, a string")
    y = F.when(F.col("a") == "Yes", 1.0).otherwise(0.0)
    assert stats.correlation(df, "d", y).collect()[0][0] is None


def test_t_const_correlation_drops_null_pairs(spark):
    import numpy as np
    rows = [(1, "Yes"), (2, "No"), (None, "Yes"), (4, "No"), (7, "Yes")]
    df = spark.createDataFrame(rows, "d int, a string")
    y = F.when(F.col("a") == "Yes", 1.0).otherwise(0.0)
    got = stats.correlation(df, "d", y, digits=None).collect()[0][0]
    xs = np.array([r[0] for r in rows if r[0] is not None], float)
    ys = np.array([1.0 if r[1] == "Yes" else 0.0 for r in rows if r[0] is not None])
    assert got == pytest.approx(np.corrcoef(xs, ys)[0, 1], rel=1e-12)


def test_t_null_score_rank_puts_nulls_first(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 3), (3, "a", 3), (4, "a", 5), (5, "b", 1)],
                               "id int, role string, s int")
    got = {r.id: (r.rk, r.m) for r in ranking.rank_within(df, "role", "s", rank_name="rk", mean_name="m").collect()}
    assert got[1][0] == 1 and got[4][0] == 2 and got[2][0] == got[3][0] == 3
    assert got[5][0] == 1
    assert got[2][1] == pytest.approx((3 + 3 + 5) / 3)


def test_t_null_score_ntile_matches_builtin(spark):
    rows = [(i, None if i % 7 == 0 else i % 4) for i in range(1, 38)]
    df = spark.createDataFrame(rows, "id int, s int")
    order = [F.col("s").desc_nulls_first(), F.col("id").asc()]
    got = {r.id: r.t for r in ranking.global_ntile(df, order, 10, "t", num_partitions=5).collect()}
    ref = {r.id: r.t for r in df.withColumn("t", F.ntile(10).over(Window.orderBy(*order))).collect()}
    assert got == ref


def test_t_null_score_lag_trend(spark):
    df = spark.createDataFrame([(1, date(2000, 1, 1), 3), (1, date(2001, 1, 1), None), (1, date(2002, 1, 1), 2)],
                               "employee_id long, date_key date, performance_score int")
    out = trends.lag_trend(df, labels=("D", "I", "S")).orderBy("date_key").collect()
    assert [r.trend for r in out] == ["S", "S", "S"]
    assert [r.delta for r in out] == [None, None, None]


def test_t_zero_rate_baselines_give_null(spark):
    df = spark.createDataFrame([("x", "No"), ("x", "No"), ("y", "Yes"), ("y", "No")], "g string, Attrition string")
    hit = F.col("Attrition") == "Yes"
    rel = {r.g: r.rel for r in rates.relative_rate(df, ["g"], hit, baseline="min", out_name="rel",
                                                       out_digits=1).collect()}
    assert rel == {"x": None, "y": None}
    first = {r.g: r.m for r in rates.relative_rate(df, ["g"], hit, baseline="first", order_by="g", out_name="m",
                                                       out_digits=2).collect()}
    assert first["x"] is None and first["y"] == 0.0


def test_t_one_row_group_sample_sd_is_null(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 4)], "g string, x int")
    got = {r.g: r.sd for r in stats.group_profile(df, ["g"], [("sd", stats.m_sd("x", 3))]).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.414)


def test_t_one_gender_gap_is_null_and_flag_else(spark):
    df = spark.createDataFrame([("r", "Male", 100), ("r", "Male", 300)], "JobRole string, Gender string, inc int")
    g = rates.two_group_gap(df, ["JobRole"], "Gender", "Male", "Female", "inc",
                            names={"n": "n", "n_a": "m", "n_b": "f", "mean_a": "am", "mean_b": "af"})
    gap = F.col("am") - F.col("af")
    r = g.select("n", "m", "f", gap.alias("gap"),
                 F.when(F.abs(gap) > 500, "review").otherwise("ok").alias("flag")).collect()[0]
    assert (r.n, r.m, r.f, r.gap, r.flag) == (2, 2, 0, None, "ok")


def test_t_ties_top_k_uses_tie_break(spark):
    df = spark.createDataFrame([(i, 10 if i < 6 else i) for i in range(1, 12)], "id int, y int")
    out = stats.top_k(df, [F.col("y").desc_nulls_first(), F.col("id").asc()], 8).collect()
    assert [r.id for r in out] == [11, 1, 2, 3, 4, 5, 10, 9]


def test_t_round_half_away_from_zero_through_decimal(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-1.005,), (0.125,)], "x double")
    assert [r[0] for r in df.select(fround("x", 2)).collect()] == [1.01, 2.68, -1.01, 0.13]


def test_t_threshold_decimal_weights_hit_060_exactly(spark):
    # OverTime, short tenure, low work-life balance, job hopping, low score: .20+.15+.10+.08+.07
    df = spark.createDataFrame([("Yes", 4, 1, 1, 1, 4, 6, 2)],
                               "OverTime string, JobSatisfaction int, YearsAtCompany int, StockOptionLevel int, "
                               "WorkLifeBalance int, EnvironmentSatisfaction int, NumCompaniesWorked int, "
                               "performance_score int")
    p = df.select(scoring.weighted(V.PROXY_FEATURES).alias("p")).collect()[0].p
    assert p == Decimal("0.60")
    assert 0.20 + 0.15 + 0.10 + 0.08 + 0.07 < 0.60  # the double sum misses the cut-off


def test_t_gap_month_row_frame_vs_calendar_frame(spark):
    ev = spark.createDataFrame([(1, date(2000, 1, 5), "exit"), (2, date(2000, 3, 9), "exit"),
                                (3, date(2000, 3, 10), "exit")], "employee_id long, event_date date, event_type string")
    rows = trends.rolling_event_trend(ev, event_type="exit", count_name="n", rolling_sums=[("s2", 2)]).collect()
    cal = trends.rolling_event_trend(ev, event_type="exit", count_name="n", rolling_sums=[("s2", 2)],
                                     gap_fill=True).collect()
    assert [(r.month.month, r.n, r.s2) for r in sorted(rows, key=lambda r: r.month)] == [(1, 1, 1), (3, 2, 3)]
    assert [(r.month.month, r.n, r.s2) for r in sorted(cal, key=lambda r: r.month)] == [(1, 1, 1), (2, 0, 1),
                                                                                           (3, 2, 2)]


def test_t_cycle_unreachable_nodes_dropped(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (10, 11), (11, 10)], "employee_id long, manager_id long")
    out = {r.employee_id: r.depth for r in hierarchy.hierarchy_depth(nodes).collect()}
    assert out == {1: 1, 2: 2, 3: 3}


def test_t_cycle_reachable_through_duplicate_ids_is_reported(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (1, 2)], "employee_id long, manager_id long")
    with pytest.raises(hierarchy.DuplicateNodes, match="employee_id: 1 "):
        hierarchy.hierarchy_depth(nodes)


@pytest.mark.parametrize("levels", [101, 1000])
def test_deep_chain_has_no_limit(spark, levels):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(levels)], "employee_id long, manager_id long")
    out = {r.employee_id: r.depth for r in hierarchy.hierarchy_depth(nodes).collect()}
    assert out == {i: i + 1 for i in range(levels)}


def test_orphans_cycles_and_rows_without_id(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 99), (4, 3), (5, 6), (6, 5), (7, 6), (None, 2)],
                                  "employee_id long, manager_id long")
    out = {(r.employee_id, r.depth) for r in hierarchy.hierarchy_depth(nodes).collect()}
    assert out == {(1, 1), (2, 2), (None, 3)}


def test_t_orphan_constraint_report(spark):
    dept = spark.createDataFrame([(1, "Sales"), (2, "Sales"), (3, None)], "department_id long, department_name string")
    fact = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "attrition_id long, department_id long")
    rules = [warehouse.Rule("dim_department", "unique", "department_name"),
             warehouse.Rule("dim_department", "not_null", "department_name"),
             warehouse.Rule("dim_department", "max_length", "department_name", limit=3),
             warehouse.Rule("fact_attrition", "foreign_key", "department_id", ref_table="dim_department",
                            ref_column="department_id")]
    out = {(r.table_name, r.rule): r.violations for r in warehouse.check_constraints(
        {"dim_department": dept, "fact_attrition": fact}, rules).collect()}
    assert out == {("dim_department", "unique"): 2, ("dim_department", "not_null"): 1,
                   ("dim_department", "max_length"): 2, ("fact_attrition", "foreign_key"): 1}


def test_t_empty_inputs_keep_schema(spark):
    empty = spark.createDataFrame([], "g string, Attrition string, x int, id long, manager_id long")
    hit = F.col("Attrition") == "Yes"
    assert rates.group_rate(empty, ["g"], hit).count() == 0
    assert "attrition_rate_pct" in rates.group_rate(empty, ["g"], hit).columns
    assert ranking.global_ntile(empty, [F.col("id").asc()], 10, "t").count() == 0
    assert ranking.rank_within(empty, "g", "x").count() == 0
    assert stats.correlation(empty, "x", F.lit(1.0)).collect()[0][0] is None
    assert hierarchy.hierarchy_depth(empty.select(F.col("id").alias("employee_id"), "manager_id")).count() == 0


def test_band_and_label_semantics(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (4,), (None,), (9,)], "y int")
    out = df.select(band("y", V.ROLE_TENURE_BANDS, V.ROLE_TENURE_ELSE).alias("b"),
                    label("y", V.EDUCATION_LABELS).alias("l")).collect()
    assert [r.b for r in out] == ["0  < 1 year", "1  1–3 years", "1  1–3 years", "2  4–6 years", "3  7+ years",
                                  "3  7+ years"]
    assert [r.l for r in out] == [None, "Below college", "Bachelor", "Master", None, None]


def test_asof_snapshot_filters_before_left_join(spark):
    left = spark.createDataFrame([(1,), (2,)], "employee_id long")
    hist = spark.createDataFrame([(1, date(2001, 1, 1), 4), (2, date(2000, 1, 1), 2)],
                                 "employee_id long, date_key date, performance_score int")
    out = {r.employee_id: r.performance_score for r in scoring.asof_snapshot(
        left, hist, left_key="employee_id", as_of=date(2001, 1, 1)).collect()}
    assert out == {1: 4, 2: None}


def test_vs_parent_mean_weighted_and_unweighted(spark):
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 3.0), ("d", "b", 3.0), ("d", "b", 3.0)],
                               "dept string, role string, x double")
    agg = stats.group_profile(df, ["dept", "role"], [("m", stats.m_mean("x")), ("n", stats.m_count())])
    out = {r.role: (r.u, r.w) for r in agg.select(
        "role", stats.vs_parent_mean(agg, "m", ["dept"]).alias("u"),
        stats.vs_parent_mean(agg, "m", ["dept"], weight_col="n").alias("w")).collect()}
    assert out["a"] == (pytest.approx(-1.0), pytest.approx(-1.5))
    assert out["b"] == (pytest.approx(1.0), pytest.approx(0.5))


def test_confusion_metrics(spark):
    df = spark.createDataFrame([(True, "Yes"), (True, "No"), (False, "Yes"), (False, "No"), (False, "No")],
                               "p boolean, a string")
    r = scoring.confusion_metrics(df, F.col("p"), F.col("a") == "Yes").collect()[0]
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 2)
    assert (r.precision, r.recall, r.accuracy) == (0.5, 0.5, 0.6)


def test_build_dim_raises_on_conflicting_attributes(spark):
    src = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, name string")
    with pytest.raises(warehouse.NaturalKeyConflict):
        warehouse.build_dim(src, {"id": "employee_id", "name": "name"}, "k", natural_key="employee_id")
    ok = warehouse.build_dim(src.where("id = 2 or name = 'a'"), {"id": "employee_id", "name": "name"}, "k",
                             natural_key="employee_id")
    assert sorted((r.k, r.employee_id) for r in ok.collect()) == [(1, 1), (2, 2)]
