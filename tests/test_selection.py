"""Percentiles by selection against the built-in value map and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stafflens.operators.selection import select_percentiles

PS, NAMES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0], ["p0", "p10", "p25", "p50", "p75", "p90", "p100"]


def plain(values, p):
    v = sorted(x for x in values if x is not None)
    if not v:
        return None
    pos = p * (len(v) - 1)
    lo, hi = v[math.floor(pos)], v[math.ceil(pos)]
    return lo if lo == hi else (1.0 - (pos - math.floor(pos))) * lo + (pos - math.floor(pos)) * hi


def check(spark, groups, **options):
    rows = [(g, x) for g, values in groups.items() for x in values]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: [r[n] for n in NAMES] + [r.n] for r in select_percentiles(df, ["g"], "x", PS, NAMES, extra=[F.count("*").alias("n")], **options).collect()}
    assert got == {g: [plain(values, p) for p in PS] + [len(values)] for g, values in groups.items()}


def test_continuous_and_hostile_values(spark):
    rnd = random.Random(2)
    groups = {
        "even": [rnd.random() for _ in range(4000)],
        "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(800)],
        "steps": [float(2**k) for k in range(-500, 500)],
        "close": [1.0 + k * 2.0**-52 for k in range(300)],
        "ties": [float(rnd.randrange(3)) for _ in range(500)],
        "one": [4.25], "same": [7.0] * 90, "none": [None, None], None: [1.0, None, 3.0],
        "infinite": [-math.inf, -1.0, 0.0, 5e-324, 1.0, math.inf, math.inf],
    }
    check(spark, groups)


@pytest.mark.parametrize("options", [{"bins": 2}, {"bins": 16, "max_broadcast_rows": 0}])
def test_few_bins_and_salted_join(spark, options):
    rnd = random.Random(3)
    check(spark, {"hot": [rnd.gauss(0, 1) for _ in range(600)], "a": [rnd.gauss(5, 1) for _ in range(40)], "b": [0.5]}, **options)


def test_equals_the_value_map(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.sin("id") * 1e6).alias("x"))
    ours = select_percentiles(df, ["g"], "x", PS, NAMES)
    theirs = df.groupBy("g").agg(F.percentile("x", PS).alias("v"))
    for r in ours.join(theirs, "g").collect():
        assert [r[n] for n in NAMES] == pytest.approx(r.v, rel=1e-15)


def test_all_rows_as_one_group_and_empty_table(spark):
    df = spark.range(1001).select((F.col("id") * 1.5).alias("x"))
    assert tuple(select_percentiles(df, [], "x", [0.5, 0.999], ["a", "b"]).first()) == (750.0, pytest.approx(1498.5))
    assert select_percentiles(df.withColumn("g", F.lit(1)).limit(0), ["g"], "x", [0.5], ["a"]).count() == 0


def test_state_is_bounded(spark):
    """No aggregate keeps values: every shuffled state is a count, a minimum and a maximum."""
    df = spark.range(1000).select(F.lit(1).alias("g"), F.sqrt("id").alias("x"))
    plan = select_percentiles(df, ["g"], "x", [0.5], ["m"])._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower().replace("select_percentiles", "")
    with pytest.raises(ValueError):
        select_percentiles(df, ["g"], "x", [1.5], ["m"])
