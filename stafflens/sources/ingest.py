"""CSV ingest (W01) and one-pass table profile.

``ingest_csv`` reads with a declared schema (never inferred: inference is a
full extra pass and types drift between files). Bad rows either fail the job
(``FAILFAST``) or are kept aside in a quarantine frame (``PERMISSIVE`` with a
corrupt-record column), never dropped silently. Every file is bound to the schema
by its own header.

``profile`` reports, per column, rows, NULLs and exact distinct non-NULL
values in one job: the table is unpivoted to (column, value) pairs, reduced
to distinct pairs with partial aggregation, then counted per column. The
shuffle carries distinct values, not rows; for an approximate and cheaper
width, ``approx=True`` uses HyperLogLog per column, all in one aggregate over
one scan.
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
FILE = "_file"


@dataclass
class Ingested:
    rows: DataFrame
    quarantine: DataFrame | None


def _hadoop(spark: SparkSession):
    """JVM gateway and Hadoop settings; None in a remote (Connect) session."""
    try:
        return spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:
        return None


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The files that Spark's readers find under ``path`` (a file, a folder or a pattern), in order:
    hidden ones, whose own or folder's name starts with ``_`` or ``.``, are left out."""
    hadoop = _hadoop(spark)
    if hadoop is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
        return sorted(r[0] for r in files.collect())
    jvm, conf = hadoop
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs, found = where.getFileSystem(conf), []
    for top in fs.globStatus(where) or ():
        base = top.getPath().toString()
        files = fs.listFiles(top.getPath(), True)
        while files.hasNext():
            f = files.next().getPath().toString()
            if not any(part[:1] in ("_", ".") for part in f[len(base):].split("/") if part):
                found.append(f)
    return sorted(found)


def _first_line(spark: SparkSession, file: str) -> str | None:
    """The file's first line that is not blank; only its head is read."""
    hadoop = _hadoop(spark)
    if hadoop is None:
        row = spark.read.text(file).where(F.trim("value") != "").first()
        return row[0] if row else None
    jvm, conf = hadoop
    where = jvm.org.apache.hadoop.fs.Path(file)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
    stream = where.getFileSystem(conf).open(where)
    stream = codec.createInputStream(stream) if codec is not None else stream
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        line = lines.readLine()
        while line is not None and not line.strip():
            line = lines.readLine()
        return line
    finally:
        lines.close()


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """Column names of the file's first line, without a byte-order mark and blanks around names."""
    line = _first_line(spark, file)
    names = next(csv.reader([line.lstrip("\ufeff")], escapechar="\\"), []) if line else []
    return tuple(c.strip() for c in names)


def files_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files under ``path`` by the header each one has; empty files are left out.

    One short read per file, eight at a time: the work of the driver grows with
    the number of files, not with their size.
    """
    files = data_files(spark, path)
    with ThreadPoolExecutor(8) as pool:
        headers = list(pool.map(lambda f: _header(spark, f), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for file, names in zip(files, headers):
        if names:
            out.setdefault(names, []).append(file)
    return out


def ingest_csv(spark: SparkSession, path: str, schema: T.StructType, *, mode: str = "FAILFAST",
               header: bool = True) -> Ingested:
    """Typed CSV read. ``mode`` is FAILFAST or PERMISSIVE (bad rows → quarantine).

    With a header, columns are bound to ``schema`` **by name, file by file**:
    any order, a leading byte-order mark stripped, extra columns ignored, absent
    nullable columns NULL, an absent required column an error that names the
    file. Files of one header share one reader; the readers' rows are united by
    name. The files are read with the declared types in their header's order, so
    a bad value is found by the parser and either fails the job or goes to the
    quarantine: its parsed fields, the raw line and the file's path (``_file``).
    A path without any header line gives no rows.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode must be FAILFAST or PERMISSIVE")
    if not header:
        return _read_group(spark, path, tuple(f.name for f in schema.fields), schema, mode, header=False)
    groups = files_by_header(spark, path)
    if not groups:
        rows = spark.createDataFrame([], schema)
        bad = None if mode == "FAILFAST" else rows.withColumns({c: F.lit(None).cast("string") for c in (CORRUPT, FILE)})
        return Ingested(rows, bad)
    # With one header Spark lists the path itself; else each reader gets its files.
    parts = [_read_group(spark, path if len(groups) == 1 else files, names, schema, mode)
             for names, files in sorted(groups.items())]
    rows = reduce(lambda a, b: a.unionByName(b), [p.rows for p in parts])
    if mode == "FAILFAST":
        return Ingested(rows, None)
    return Ingested(rows, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.quarantine for p in parts]))


def _read_group(spark: SparkSession, path: str | list[str], names: tuple[str, ...], schema: T.StructType, mode: str,
                header: bool = True) -> Ingested:
    """Files that share the header ``names``."""
    from .sinks import conform
    where = path if isinstance(path, str) else path[0]
    declared = {f.name: f for f in schema.fields}
    repeated = {n for n in names if names.count(n) > 1 and n in declared}
    if repeated:
        raise ValueError(f"columns {sorted(repeated)} occur more than once in the header of {where}")
    missing = [f.name for f in schema.fields if not f.nullable and f.name not in names]
    if missing:
        raise ValueError(f"required column {missing[0]!r} is missing in {where}")
    file_schema = T.StructType([T.StructField(n, declared[n].dataType if n in declared else T.StringType(), True)
                                for n in _distinct(list(names))])
    # Names are bound here; the parser must not compare the header with them (it may hold a byte-order mark).
    reader = spark.read.option("header", header).option("enforceSchema", True).option("mode", mode)
    if mode == "FAILFAST":
        return Ingested(conform(reader.schema(file_schema).csv(path), schema), None)
    wide = T.StructType(list(file_schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    raw = reader.option("columnNameOfCorruptRecord", CORRUPT).schema(wide).csv(path)
    good = conform(raw.where(F.col(CORRUPT).isNull()), schema)
    # The quarantine keeps the parsed fields next to the raw line. Spark refuses a query that reads
    # only the corrupt-record column of a raw file, so a condition that always holds reads another.
    first = F.col(f"`{file_schema.fields[0].name}`").cast("string")
    bad = raw.select("*", F.col("_metadata.file_path").alias(FILE)).where(
        F.col(CORRUPT).isNotNull() & (F.length(F.concat_ws("", first)) >= 0))
    return Ingested(good, bad)


def _distinct(names: list[str]) -> list[str]:
    """The header with repeated (undeclared) or empty names made distinct by position."""
    seen: set[str] = set()
    out = []
    for i, n in enumerate(names):
        n = n if n and n not in seen else f"_c{i}"
        seen.add(n)
        out.append(n)
    return out


def profile(df: DataFrame, columns: list[str] | None = None, *, approx: bool = False) -> DataFrame:
    """One row per column: column_name, n_rows, n_nulls, n_distinct."""
    cols = columns or df.columns
    if approx:
        one = df.agg(F.count(F.lit(1)).alias("_n"),
                     *[F.count_if(F.col(c).isNull()).alias(f"_u{i}") for i, c in enumerate(cols)],
                     *[F.approx_count_distinct(c).alias(f"_d{i}") for i, c in enumerate(cols)])
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("n_rows"),
                                  F.col(f"_u{i}").alias("n_nulls"), F.col(f"_d{i}").alias("n_distinct"))
                         for i, c in enumerate(cols)])
        return one.select(F.inline(rows))
    long = (df.select([F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "column_name", "value"))
    per_value = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_n"))
    return per_value.groupBy("column_name").agg(
        F.sum("_n").cast("bigint").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).cast("bigint").alias("n_nulls"),
        F.count("value").cast("bigint").alias("n_distinct"),
    )


def read_named_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of ``ingest_csv``; a bad value fails the job."""
    return ingest_csv(spark, path, schema).rows
