"""Hot keys: one department, one employee, one score and one manager each hold
about a third of the rows. Results must equal a brute-force computation."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stafflens.operators import hierarchy, ranking, rates

N = 3000


@pytest.fixture(scope="module")
def members(spark):
    rnd = random.Random(17)
    rows = [(i, "HOT" if i % 3 == 0 else rnd.choice(["A", "B", "C"]), rnd.choice(["Male", "Female"]),
             rnd.choice(["Yes", "No"]), 4 if i % 3 else rnd.randint(1, 5)) for i in range(N)]
    return rows, spark.createDataFrame(rows, "employee_id long, department string, gender string, "
                                             "Attrition string, score int")


def test_group_rate_hot_department(spark, members):
    rows, df = members
    got = {r.department: (r.total_employees, r.attritions) for r in
           rates.group_rate(df, ["department"], F.col("Attrition") == "Yes").collect()}
    n, y = Counter(r[1] for r in rows), Counter(r[1] for r in rows if r[3] == "Yes")
    assert got == {d: (n[d], y[d]) for d in n}
    assert n["HOT"] >= N // 3


def test_event_rate_hot_employee_equals_fanout_join(spark, members):
    rows, df = members
    rnd = random.Random(5)
    events = [(0,)] * N + [(rnd.randrange(N * 2),) for _ in range(2 * N)]  # employee 0 holds a third
    ev = spark.createDataFrame(events, "employee_id long")
    got = {(r.department, r.gender): (r.total_employees, r.total_exits) for r in
           rates.event_rate(df, ev, ["department", "gender"]).collect()}
    k = Counter(e[0] for e in events)
    ref = defaultdict(lambda: [0, 0])
    for r in rows:
        ref[(r[1], r[2])][0] += max(k[r[0]], 1)
        ref[(r[1], r[2])][1] += k[r[0]]
    assert got == {g: tuple(v) for g, v in ref.items()}


def test_rank_within_hot_role_and_score(spark, members):
    _, df = members
    got = {r.employee_id: r.rk for r in ranking.rank_within(df, "department", "score", rank_name="rk").collect()}
    ref = df.select("employee_id", F.rank().over(
        Window.partitionBy("department").orderBy(F.col("score").desc_nulls_first())).alias("rk")).collect()
    assert got == {r.employee_id: r.rk for r in ref}


def test_global_ntile_hot_score(spark, members):
    _, df = members
    order = [F.col("score").desc_nulls_first(), F.col("employee_id").asc()]
    got = {r.employee_id: r.t for r in ranking.global_ntile(df, order, 10, "t", num_partitions=6).collect()}
    ref = df.select("employee_id", F.ntile(10).over(Window.orderBy(*order)).alias("t")).collect()
    assert got == {r.employee_id: r.t for r in ref}


def test_hierarchy_hot_manager(spark):
    # Node 1 manages a third of the tree directly; the rest is a chain of depth up to 4.
    edges = [(1, None)] + [(i, 1) for i in range(2, 400)] + [(i, i - 398) for i in range(400, 1200)]
    df = spark.createDataFrame(edges, "employee_id long, manager_id long")
    got = {r.employee_id: r.depth for r in hierarchy.hierarchy_depth(df).collect()}
    parent = dict(edges)
    def depth(x):
        d = 1
        while parent[x] is not None:
            x, d = parent[x], d + 1
        return d
    assert got == {e: depth(e) for e, _ in edges}


def test_key_moments_equal_raw_row_statistics(spark):
    from stafflens.operators import stats
    rnd = random.Random(23)
    rows = [(0 if i % 3 == 0 else rnd.randrange(500), rnd.choice("xyz"), rnd.choice([None, 1, 2, 3, 4, 5]))
            for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, g string, x int")
    # Give every key one group (as an employee has one department), key 0 holds a third of the rows.
    one_group = df.groupBy("k").agg(F.min("g").alias("g"))
    df1 = df.drop("g").join(one_group, "k")
    mom = stats.key_moments(df1.drop("g"), "k", "x").join(one_group, "k")
    got = {r.g: (r.m, r.sd, r.n) for r in mom.groupBy("g").agg(
        stats.mm_mean().alias("m"), stats.mm_sd().alias("sd"), stats.mm_rows().alias("n")).collect()}
    raw = {r.g: (r.m, r.sd, r.n) for r in df1.groupBy("g").agg(
        F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.count(F.lit(1)).alias("n")).collect()}
    assert got.keys() == raw.keys()
    for g in raw:
        assert got[g][0] == pytest.approx(raw[g][0], rel=1e-12)
        assert got[g][1] == pytest.approx(raw[g][1], rel=1e-9)
        assert got[g][2] == raw[g][2]


def test_salted_joins_equal_plain_joins(spark, members):
    from stafflens.operators import stats
    _, df = members
    plain = {r.employee_id: (r.rk, r.m) for r in
             ranking.rank_within(df, "department", "score", rank_name="rk", mean_name="m").collect()}
    salted = {r.employee_id: (r.rk, r.m) for r in ranking.rank_within(
        df, "department", "score", rank_name="rk", mean_name="m", salt_from=["employee_id"]).collect()}
    assert plain == salted
    a = sorted(tuple(r) for r in stats.vs_group_median(df, ["department"], "score", median_name="md").collect())
    b = sorted(tuple(r) for r in stats.vs_group_median(df, ["department"], "score", median_name="md",
                                                       salt_from=["employee_id"]).collect())
    assert a == b and len(a) == N
