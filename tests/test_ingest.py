"""CSV ingest by name (W01) and the one-scan profile."""

import pytest
from pyspark.sql import types as T

from stafflens.sources.ingest import ingest_csv, profile

SCHEMA = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.IntegerType(), True),
                       T.StructField("d", T.DateType(), True)])


def _file(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def _rows(spark, path, **options):
    return [tuple(r) for r in ingest_csv(spark, path, SCHEMA, **options).rows.collect()]


def test_columns_are_bound_by_name(spark, tmp_path):
    import datetime as dt
    path = _file(tmp_path, "﻿b,extra,d,a\n1,x,2001-02-03,2\n,y,,4\n")
    assert _rows(spark, path) == [(2, 1, dt.date(2001, 2, 3)), (4, None, None)]
    assert _rows(spark, path, mode="PERMISSIVE") == [(2, 1, dt.date(2001, 2, 3)), (4, None, None)]


def test_absent_columns(spark, tmp_path):
    assert _rows(spark, _file(tmp_path, "a\n7\n")) == [(7, None, None)]
    with pytest.raises(ValueError, match="'a' is missing"):
        _rows(spark, _file(tmp_path, "b,d\n1,2001-01-01\n"))
    with pytest.raises(ValueError, match="more than once"):
        _rows(spark, _file(tmp_path, "a,b,a\n1,2,3\n"))


def test_bad_value_fails_or_goes_to_quarantine(spark, tmp_path):
    path = _file(tmp_path, "b,a,d\n1,2,2001-01-01\nx,3,2001-01-01\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        _rows(spark, path)
    out = ingest_csv(spark, path, SCHEMA, mode="PERMISSIVE")
    assert [r.a for r in out.rows.collect()] == [2]
    assert [r._corrupt_record for r in out.quarantine.collect()] == ["x,3,2001-01-01"]


def test_files_without_header_are_bound_by_position(spark, tmp_path):
    assert [r[:2] for r in _rows(spark, _file(tmp_path, "1,2,2001-01-01\n"), header=False)] == [(1, 2)]


def test_approximate_profile_is_one_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (None, None)], "a int, b string")
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    approx = profile(df, approx=True)
    assert approx._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(tuple, approx.collect())) == sorted(map(tuple, profile(df).collect())) == [("a", 3, 1, 2), ("b", 3, 1, 1)]


# ------------------------------------------------------------------ folders of files with different headers
PAIR = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.IntegerType(), True)])


def _folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_each_file_is_bound_by_its_own_header(spark, tmp_path):
    path = _folder(tmp_path, a="a,b\n1,2\n", b="b,a\n20,10\n", c='﻿"a", x ,b\n3,z,4\n', d="a\n5\n", e="", f="\n\nb,a\n7,6\n", _h="b,a\n0,0\n")
    rows = ingest_csv(spark, path, PAIR).rows
    assert sorted(map(tuple, rows.collect())) == [(1, 2), (3, 4), (5, None), (6, 7), (10, 20)]
    assert rows.dtypes == [("a", "int"), ("b", "int")]
    both = ingest_csv(spark, path, PAIR, mode="PERMISSIVE")
    assert sorted(map(tuple, both.rows.collect())) == sorted(map(tuple, rows.collect()))
    assert both.quarantine.count() == 0


def test_quarantine_names_file_and_line(spark, tmp_path):
    path = _folder(tmp_path, a="a,b\n1,2\nx,3\n", b="b,a,note\n20,10,n\ny,11,m\n")
    both = ingest_csv(spark, path, PAIR, mode="PERMISSIVE")
    assert sorted(map(tuple, both.rows.collect())) == [(1, 2), (10, 20)]
    bad = {(r["_file"].rsplit("/", 1)[1], r["_corrupt_record"]) for r in both.quarantine.collect()}
    assert bad == {("a.csv", "x,3"), ("b.csv", "y,11,m")}
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest_csv(spark, path, PAIR).rows.collect()


def test_headers_that_lack_or_repeat_a_column_name_their_file(spark, tmp_path):
    path = _folder(tmp_path, a="a,b\n1,2\n", b="b\n2\n")
    with pytest.raises(ValueError, match="'a' is missing in .*b.csv"):
        ingest_csv(spark, path, PAIR)
    other = tmp_path / "other"
    other.mkdir()
    with pytest.raises(ValueError, match="more than once in the header of .*r.csv"):
        ingest_csv(spark, _folder(other, r="a,a,b\n1,2,3\n", s="a,b\n1,2\n"), PAIR)


def test_patterns_compressed_and_empty_folders(spark, tmp_path):
    import gzip
    path = _folder(tmp_path, a="a,b\n1,2\n", b="b,a\n20,10\n")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("b,a\n40,30\n")
    assert sorted(map(tuple, ingest_csv(spark, path, PAIR).rows.collect())) == [(1, 2), (10, 20), (30, 40)]
    assert sorted(map(tuple, ingest_csv(spark, f"{path}/[bc].csv*", PAIR).rows.collect())) == [(10, 20), (30, 40)]
    empty = tmp_path / "empty"
    empty.mkdir()
    none = ingest_csv(spark, str(empty), PAIR, mode="PERMISSIVE")
    assert none.rows.count() == 0 and none.quarantine.count() == 0 and none.rows.dtypes == [("a", "int"), ("b", "int")]
