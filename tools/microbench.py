"""Custom distributed operators vs Spark's single-partition built-ins.

    python tools/microbench.py [sf_dir]

* W23 global NTILE(10) vs ``ntile`` over an unpartitioned window (lineitem)
* W05 dense 1..n key vs ``row_number`` over an unpartitioned window (lineitem)
* W25 first/last value per key: ``min_by``/``max_by`` vs full-frame windows + DISTINCT (orders)

Each pair is checked for identical results; prints one JSON line with seconds
(median of 3 after a warm-up) and the task count of the widest stage input.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from stafflens.operators.ranking import global_ntile, global_row_number  # noqa: E402
from stafflens.operators.trends import first_last_change  # noqa: E402
from stafflens.session import local_session  # noqa: E402


def timed(fn, reps=3):
    fn()
    ts = []
    for _ in range(reps):
        t0 = time.perf_counter()
        fn()
        ts.append(time.perf_counter() - t0)
    return round(statistics.median(ts), 3)


def digest(df, key_cols, val):
    """Order-free fingerprint of (key → value)."""
    h = F.xxhash64(*key_cols, F.col(val).cast("bigint"))
    return df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).collect()[0]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey",
                                                                    "o_totalprice")
    out = {"sf_dir": sf_dir, "lineitem_rows": li.count(), "orders_rows": orders.count()}

    order = [F.col("l_extendedprice").desc_nulls_first(), F.col("l_orderkey"), F.col("l_linenumber")]
    keys = [F.col("l_orderkey"), F.col("l_linenumber")]
    ours = lambda: global_ntile(li, order, 10, "t")
    builtin = lambda: li.withColumn("t", F.ntile(10).over(Window.orderBy(*order)))
    assert digest(ours(), keys, "t") == digest(builtin(), keys, "t")
    out["w23_ntile_distributed_sec"] = timed(lambda: ours().write.format("noop").mode("overwrite").save())
    out["w23_ntile_builtin_single_partition_sec"] = timed(lambda: builtin().write.format("noop").mode("overwrite").save())

    korder = [F.col("l_orderkey"), F.col("l_linenumber")]
    ours_k = lambda: global_row_number(li, korder, "k")
    builtin_k = lambda: li.withColumn("k", F.row_number().over(Window.orderBy(*korder)))
    assert digest(ours_k(), keys, "k") == digest(builtin_k(), keys, "k")
    out["w05_dense_key_distributed_sec"] = timed(lambda: ours_k().write.format("noop").mode("overwrite").save())
    out["w05_row_number_single_partition_sec"] = timed(
        lambda: builtin_k().write.format("noop").mode("overwrite").save())

    scores = orders.select(F.col("o_custkey").alias("employee_id"),
                           F.struct("o_orderdate", "o_orderkey").alias("date_key"),
                           F.col("o_totalprice").alias("performance_score"))
    ours_fl = lambda: first_last_change(scores)
    w = Window.partitionBy("employee_id").orderBy("date_key").rowsBetween(Window.unboundedPreceding,
                                                                          Window.unboundedFollowing)
    builtin_fl = lambda: scores.select(
        "employee_id", F.first("performance_score").over(w).alias("first_score"),
        F.last("performance_score").over(w).alias("latest_score")).distinct()
    assert sorted(ours_fl().collect()) == sorted(builtin_fl().collect())
    out["w25_min_by_max_by_sec"] = timed(lambda: ours_fl().write.format("noop").mode("overwrite").save())
    out["w25_window_distinct_sec"] = timed(lambda: builtin_fl().write.format("noop").mode("overwrite").save())
    print(json.dumps(out))


if __name__ == "__main__":
    main()
