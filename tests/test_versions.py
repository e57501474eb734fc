"""Safe replace, load of changes and the key registry, with failures in between."""

import random

import pytest
from pyspark.sql import functions as F

from stafflens.sources import versions
from stafflens.sources.versions import VersionedTable, assign_keys, current_rows, load_changes


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replace_append_and_versions(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    with pytest.raises(ValueError, match="no committed"):
        t.read()
    assert t.replace(spark.range(5).withColumn("x", F.lit("a"))) == 1
    assert t.replace(spark.range(3).withColumn("x", F.lit("b"))) == 2
    assert rows(t.read()) == [(0, "b"), (1, "b"), (2, "b")] and t.read(1).count() == 5
    assert t.append(spark.range(3, 4).withColumn("x", F.lit("c"))) == 3 and t.read().count() == 4
    t.replace(spark.range(0).withColumn("x", F.lit("d")))
    assert t.read().count() == 0 and t.read().columns == ["id", "x"] and t.versions() == [1, 2, 3, 4]


def test_killed_write_leaves_the_old_table_and_a_retry_no_doubles(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.replace(spark.range(100))
    # Some tasks have written their files when another one fails.
    broken = spark.range(0, 100, 1, 10).select(F.when(F.col("id") < 95, F.col("id")).otherwise(F.raise_error(F.lit("killed")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        t.replace(broken)
    assert t.versions() == [1] and t.read().count() == 100
    assert t.replace(spark.range(95)) == 2
    assert rows(t.read()) == sorted([(i,) for i in range(95)], key=str)
    assert len(t.vacuum()) == 1 and t.read(1).count() == 100 and t.read().count() == 95


def test_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.replace(spark.range(10))

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", crash)
        with pytest.raises(KeyboardInterrupt):
            t.append(spark.range(10, 20))
    assert t.read().count() == 10
    t.append(spark.range(10, 20))
    assert rows(t.read()) == sorted([(i,) for i in range(20)], key=str)


def test_short_write_is_not_committed(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.replace(spark.range(10))
    monkeypatch.setattr(versions, "Observation", lambda: type("Seen", (), {"get": {"n": 11}})())
    monkeypatch.setattr(type(spark.range(1)), "observe", lambda self, *a: self)
    with pytest.raises(versions.IncompleteWrite):
        t.replace(spark.range(10))
    assert t.versions() == [1]


def test_two_writers_of_one_version(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.replace(spark.range(1))
    stale = t.commit_of()
    t.replace(spark.range(2))
    with pytest.raises(versions.WriteConflict):
        t._commit(stale, stale.schema, {})
    assert t.read().count() == 2


def test_vacuum_keeps_the_last_versions(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", keep=2)
    for n in range(1, 5):
        t.replace(spark.range(n))
    assert len(t.vacuum()) == 2 and t.versions() == [3, 4]
    assert t.read(3).count() == 3 and t.read().count() == 4


def snapshot(spark, data):
    return spark.createDataFrame([(k, *v) for k, v in data.items()], "k long, x int, s string")


def test_loads_write_the_touched_buckets_only(spark, tmp_path):
    rnd = random.Random(1)
    t = VersionedTable(spark, f"{tmp_path}/t")
    data = {k: (rnd.randrange(9), rnd.choice(["a", None])) for k in range(2000)}
    first = load_changes(t, snapshot(spark, data), "k", buckets=50)
    assert first.counts == {"new": 2000, "changed": 0, "gone": 0, "same": 0} and len(first.touched) == 50
    before = t.commit_of()
    for k in range(0, 10):
        data[k] = (data[k][0] + 1, data[k][1])
    del data[77]
    data[5000] = (1, None)
    second = load_changes(t, snapshot(spark, data), "k", buckets=7)  # the first load's number of buckets holds
    assert second.counts == {"new": 1, "changed": 10, "gone": 1, "same": 1989} and len(second.touched) <= 12
    assert rows(current_rows(t)) == rows(snapshot(spark, data))
    after = t.commit_of()
    assert {b for b in before.parts if before.parts[b] != after.parts.get(b)} == {str(b) for b in second.touched}
    again = load_changes(t, snapshot(spark, data), "k")
    assert again.version == second.version and again.touched == []


def test_null_and_empty_differ_and_a_bucket_may_run_empty(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    load_changes(t, snapshot(spark, {1: (1, None), 2: (2, "")}), "k", buckets=4)
    assert load_changes(t, snapshot(spark, {1: (1, ""), 2: (2, "")}), "k").counts["changed"] == 1
    load_changes(t, snapshot(spark, {1: (1, "")}), "k")
    assert rows(current_rows(t)) == [(1, 1, "")]
    load_changes(t, snapshot(spark, {1: (1, "")}).limit(0), "k")
    assert current_rows(t).count() == 0
    with pytest.raises(ValueError, match="several rows"):
        load_changes(t, snapshot(spark, {1: (1, "")}).union(snapshot(spark, {1: (2, "")})), "k")


def test_keys_stay_over_loads(spark, tmp_path):
    r = VersionedTable(spark, f"{tmp_path}/keys")
    load = lambda names: spark.createDataFrame([(n, 1) for n in names], "name string, x int").repartition(3)
    key = lambda names: {x["name"]: x["id"] for x in assign_keys(r, load(names), ["name"], "id").collect()}
    first = key(["m", "c", "x", None, "c"])
    assert first == {"c": 1, "m": 2, "x": 3, None: None}
    assert key(["z", "a", "m"]) == {"m": 2, "a": 4, "z": 5}
    assert key(["x", "c"]) == {"c": 1, "x": 3} and r.versions() == [1, 2]
    assert sorted(x["id"] for x in r.read().collect()) == [1, 2, 3, 4, 5]


def test_registry_survives_a_crash(spark, tmp_path, monkeypatch):
    r = VersionedTable(spark, f"{tmp_path}/keys")
    df = spark.range(0, 40, 1, 6).withColumnRenamed("id", "k")
    assign_keys(r, df.where("k % 2 = 0"), ["k"], "id")

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", crash)
        with pytest.raises(KeyboardInterrupt):
            assign_keys(r, df, ["k"], "id")
    want = {k: i + 1 for i, k in enumerate([*range(0, 40, 2), *range(1, 40, 2)])}
    assert {x["k"]: x["id"] for x in assign_keys(r, df, ["k"], "id").collect()} == want


def test_only_new_and_replaced_files_are_read(spark, tmp_path):
    src, t = f"{tmp_path}/src", VersionedTable(spark, f"{tmp_path}/counts")
    put = lambda name, *values: spark.createDataFrame([(v,) for v in values], "x int").coalesce(1).write.mode("overwrite").parquet(f"{src}/{name}")
    read_files = []

    def read(files):
        read_files.append(len(files))
        return spark.read.parquet(*files)

    build = lambda rows, key: rows.where("x > 0").groupBy(key, "x").agg(F.count(F.lit(1)).alias("n"))
    load = lambda: len(versions.load_by_file(t, src, read, build))
    counts = lambda: dict(t.read().groupBy("x").agg(F.sum("n")).collect())
    put("a b", 1, 1, 2)
    put("b", 2)
    put("none", -1)
    assert load() == 3 and counts() == {1: 2, 2: 2}
    assert load() == 0 and read_files == [3] and t.versions() == [1]
    put("c", 3, 3, 3)
    assert load() == 1 and counts() == {1: 2, 2: 2, 3: 3}
    put("b", 1)  # replaced
    assert load() == 1 and counts() == {1: 3, 2: 1, 3: 3}
    (tmp_path / "kept").mkdir()
    import os
    for f in os.listdir(f"{src}/c"):
        os.rename(f"{src}/c/{f}", f"{tmp_path}/kept/{f}")
    assert load() == 0 and counts() == {1: 3, 2: 1} and read_files == [3, 1, 1]
