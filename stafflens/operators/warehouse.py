"""Star-schema build and checks.

* ``build_dim``: distinct natural keys (+ attributes) with a dense surrogate
  key (W05, no single-partition window).
* ``build_dim_time``: one row per calendar month of a date span derived from
  the data.
* ``build_fact``: natural-key → surrogate-key lookups. Small dimensions are
  broadcast behind a row-count check; the employee dimension is a shuffle
  join on its key. ``lookup_misses`` returns the rows an inner lookup drops,
  so they are reported instead of lost silently.
* ``check_constraints``: the declared rules (unique, not null, text length,
  foreign key) as one violation count per rule; dense integer keys by bitmap.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import bounded_broadcast
from .ranking import with_surrogate_key

SMALL_DIM_MAX_ROWS = 1_000_000


class NaturalKeyConflict(ValueError):
    """A natural key maps to more than one dimension row (UNIQUE would reject it)."""


def build_dim(df: DataFrame, columns: dict[str, str], key_name: str, *, distinct: bool = True,
              order: Sequence[str] | None = None, natural_key: str | None = None) -> DataFrame:
    """Project + rename ``columns`` (source → target), optionally distinct,
    and add a dense ``key_name`` following ``order`` (default: all target columns).

    With ``natural_key`` the dimension must hold one row per natural key: a key
    with conflicting attributes (or repeated rows when ``distinct`` is off)
    raises ``NaturalKeyConflict``. The check reads the dimension's checkpointed
    copy, so it costs one aggregation over the dimension, not over the source.
    """
    proj = df.select(*[F.col(src).alias(dst) for src, dst in columns.items()])
    if distinct:
        proj = proj.distinct()
    targets = list(columns.values())
    primary = list(order or targets)
    order_cols = [F.col(c).asc_nulls_last() for c in primary + [t for t in targets if t not in primary]]
    dim = with_surrogate_key(proj, order_cols, key_name)
    # A distinct projection of the key alone cannot repeat it: nothing to check.
    if natural_key is not None and not (distinct and targets == [natural_key]):
        dupes = (dim.where(F.col(natural_key).isNotNull()).groupBy(natural_key)
                 .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
        sample = dupes.limit(3).collect()
        if sample:
            raise NaturalKeyConflict(
                f"{natural_key}: {', '.join(repr(r[0]) for r in sample)} map to several rows")
    return dim


def build_dim_time(dates: DataFrame, date_col: str, key_name: str = "time_key") -> DataFrame:
    """One row per month between the first and last month of ``date_col``.

    The span is a one-row aggregate; the months are generated from it, so the
    table has (months in the span) rows and the numbering window runs on them.
    """
    span = dates.agg(F.trunc(F.min(date_col), "month").alias("lo"), F.trunc(F.max(date_col), "month").alias("hi"))
    months = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("_m"))
    m = F.col("_m")
    return months.select(
        F.row_number().over(Window.orderBy(m)).cast("bigint").alias(key_name),
        F.year(m).cast("int").alias("year"),
        F.quarter(m).cast("int").alias("quarter"),
        F.month(m).cast("int").alias("month"),
        F.date_format(m, "MMMM").alias("month_name"),
    )


@dataclass(frozen=True)
class Lookup:
    """Replace ``source_col`` of the staging rows by ``key_col`` of ``dim`` (matched on ``dim_col``)."""

    dim: DataFrame
    source_col: str
    dim_col: str
    key_col: str
    small: bool = False


def _lookup_side(lk: Lookup) -> DataFrame:
    side = lk.dim.select(F.col(lk.dim_col).alias(f"_lk_{lk.key_col}"), F.col(lk.key_col))
    return bounded_broadcast(side, SMALL_DIM_MAX_ROWS) if lk.small else side


def build_fact(staging: DataFrame, lookups: Sequence[Lookup], measures: Sequence[tuple[str, str, str | None]],
               key_name: str, order_by: str) -> DataFrame:
    """Staging rows with surrogate keys looked up (inner joins) + typed measures.

    measures: (source column, target column, cast type or None). The fact key
    is dense in ``order_by`` (a surrogate key column) with the measures as
    tie-break.
    """
    out = staging
    for lk in lookups:
        side = _lookup_side(lk)
        out = out.join(side, out[lk.source_col] == side[f"_lk_{lk.key_col}"], "inner").drop(f"_lk_{lk.key_col}")
    cols = [F.col(lk.key_col) for lk in lookups]
    for src, dst, typ in measures:
        c = F.col(src)
        cols.append((c.cast(typ) if typ else c).alias(dst))
    fact = out.select(*cols)
    order = [F.col(order_by).asc_nulls_last()] + [F.col(c).asc_nulls_last() for c in fact.columns if c != order_by]
    return with_surrogate_key(fact, order, key_name)


def lookup_misses(staging: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """Staging rows that at least one inner lookup of ``build_fact`` would drop."""
    misses = None
    for lk in lookups:
        side = lk.dim.select(F.col(lk.dim_col).alias("_lk"))
        side = bounded_broadcast(side, SMALL_DIM_MAX_ROWS) if lk.small else side
        miss = staging.join(side, staging[lk.source_col] == side["_lk"], "left_anti")
        misses = miss if misses is None else misses.unionByName(miss)
    return misses.distinct() if len(lookups) > 1 else misses


# --------------------------------------------------------------------------- W07
@dataclass(frozen=True)
class Rule:
    table: str
    kind: str            # unique | not_null | max_length | foreign_key | lookup_miss
    column: str
    limit: int | None = None
    ref_table: str | None = None
    ref_column: str | None = None


def _report(table: str, kind: str, column: str, violations) -> DataFrame:
    return violations.select(F.lit(table).alias("table_name"), F.lit(kind).alias("rule"),
                             F.lit(column).alias("column_name"), F.col("violations").cast("bigint").alias("violations"))


def _unique_rule(df: DataFrame, r: Rule) -> DataFrame:
    """UNIQUE rule of one column, counted in the column's own type: rows of repeated non-NULL values."""
    per_value = df.where(F.col(r.column).isNotNull()).groupBy(r.column).agg(F.count(F.lit(1)).alias("_n"))
    repeated = F.sum(F.when(F.col("_n") > 1, F.col("_n")))
    return _report(r.table, r.kind, r.column, per_value.agg(F.coalesce(repeated, F.lit(0)).alias("violations")))


def _reference_rule(tables: dict[str, DataFrame], r: Rule) -> DataFrame:
    """FOREIGN KEY (non-NULL values without a referenced row) or lookup miss (any row
    without a match, NULL included): the distinct values with their row counts,
    anti-joined against the referenced keys, so no row is moved."""
    df = tables[r.table]
    ref = tables[r.ref_table].select(F.col(r.ref_column).alias("_ref"))
    probe = df.where(F.col(r.column).isNotNull()) if r.kind == "foreign_key" else df
    values = probe.groupBy(F.col(r.column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    miss = values.join(ref, F.col("_v") == F.col("_ref"), "left_anti")
    return _report(r.table, r.kind, r.column, miss.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations")))


Place = tuple[str, str]  # table and column


def _places(r: Rule) -> list[Place]:
    return [(r.table, r.column)] + ([(r.ref_table, r.ref_column)] if r.ref_table else [])


def _measures(tables: dict[str, DataFrame], rules: Sequence[Rule], whole: Sequence[Place]) -> dict:
    """Every count that one row at a time gives: NULLs and long texts of the rules, and of each column
    in ``whole`` its NULLs, values, smallest and largest. One aggregate per table, all in one job."""
    wanted: dict[str, list[tuple[tuple, str]]] = {}
    for r in rules:
        if r.kind == "not_null":
            wanted.setdefault(r.table, []).append(((r,), f"count_if(`{r.column}` IS NULL)"))
        elif r.kind == "max_length":
            wanted.setdefault(r.table, []).append(((r,), f"count_if(length(`{r.column}`) > {r.limit})"))
    for table, column in whole:
        for name, value in (("nulls", "count_if({} IS NULL)"), ("n", "count({})"), ("min", "min({})"), ("max", "max({})")):
            wanted.setdefault(table, []).append(((table, column, name), value.format(f"`{column}`")))
    names, parts = [], []
    for table, measures in wanted.items():
        entries = [f"named_struct('i', {len(names) + i}, 'v', CAST({value} AS BIGINT))" for i, (_, value) in enumerate(measures)]
        names += [name for name, _ in measures]
        parts.append(tables[table].selectExpr(f"array({', '.join(entries)}) AS m").selectExpr("inline(m)"))
    if not parts:
        return {}
    return {names[i]: v for i, v in reduce(DataFrame.unionByName, parts).collect()}


#: A column is checked by bitmap while its values span at most so many numbers per value.
SPARSE = 64


def _bitmap_counts(tables: dict[str, DataFrame], places: Sequence[Place], refs: Sequence[Rule]) -> tuple[dict, dict]:
    """Distinct values of each place, and for each reference rule the distinct values without a
    referenced one: |values or referenced| - |referenced|, from one bitmap per 32,768 numbers."""
    if not places:
        return {}, {}
    number = {p: i for i, p in enumerate(places)}
    parts = []
    for table in dict.fromkeys(t for t, _ in places):  # one scan a table
        entries = [f"named_struct('place', {number[t, c]}, 'bucket', bitmap_bucket_number(CAST(`{c}` AS BIGINT)), "
                   f"'bit', bitmap_bit_position(CAST(`{c}` AS BIGINT)))" for t, c in places if t == table]
        parts.append(tables[table].selectExpr(f"inline(array({', '.join(entries)}))").where("bucket IS NOT NULL"))
    bits = reduce(DataFrame.unionByName, parts).groupBy("place", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    # What a place's bitmaps are counted for: the place itself, and its side of every reference rule.
    roles = [[(-1 - i, False)] + [(k, side == 1) for k, r in enumerate(refs) for side in (0, 1) if _places(r)[side] == p]
             for i, p in enumerate(places)]
    role = ", ".join(f"array({', '.join(f"named_struct('what', {w}, 'is_ref', {ref})" for w, ref in r)})" for r in roles)
    used = bits.selectExpr("bucket", "bits", f"inline(get(array({role}), place))")
    merged = used.groupBy("what", "bucket").agg(F.expr("bitmap_or_agg(bits) AS all"), F.expr("bitmap_or_agg(CASE WHEN is_ref THEN bits END) AS ref"))
    found = merged.groupBy("what").agg(F.expr("sum(bitmap_count(all) - coalesce(bitmap_count(ref), 0)) AS n"))
    counts = {row["what"]: row["n"] for row in found.collect()}  # one number a place and rule
    return ({p: counts.get(-1 - i, 0) for i, p in enumerate(places)}, {r: counts.get(i, 0) for i, r in enumerate(refs)})


def check_constraints(tables: dict[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """One row per rule with its violation count (0 = rule holds).

    A first job aggregates every table once: NULLs, long texts, and the span of
    integer key columns. Where the integers of a key are dense (surrogate keys
    are), a second one makes bitmaps of them, 4 KB per 32,768 numbers, merged
    within each task before they are shuffled; their bit counts tell whether a
    value repeats or lacks its referenced key, exactly and without moving a row.
    Rules that they clear are done. The others, and text keys, are counted by
    distinct value: one aggregate, and for references one anti-join of the
    distinct values.
    """
    for r in rules:
        if r.kind not in ("unique", "not_null", "max_length", "foreign_key", "lookup_miss"):
            raise ValueError(f"unknown rule kind {r.kind!r}")
    integer = {(t, f.name) for t, df in tables.items() for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    keyed = [r for r in rules if r.kind in ("unique", "foreign_key", "lookup_miss")]
    whole = list(dict.fromkeys(p for r in keyed if integer.issuperset(_places(r)) for p in _places(r)))
    seen = _measures(tables, rules, whole)
    dense = {(t, c) for t, c in whole
             if not seen[t, c, "n"] or seen[t, c, "max"] - seen[t, c, "min"] < SPARSE * seen[t, c, "n"]}
    by_bits = [r for r in keyed if dense.issuperset(_places(r))]
    refs = [r for r in by_bits if r.kind != "unique"]
    distinct, orphans = _bitmap_counts(tables, list(dict.fromkeys(p for r in by_bits for p in _places(r))), refs)

    known, parts = [], []
    for r in rules:
        if r.kind in ("not_null", "max_length"):
            known.append((r, seen[(r,)]))
        elif r in by_bits and r.kind == "unique" and distinct[r.table, r.column] == seen[r.table, r.column, "n"]:
            known.append((r, 0))
        elif r in by_bits and r.kind != "unique" and not orphans[r]:
            known.append((r, seen[r.table, r.column, "nulls"] if r.kind == "lookup_miss" else 0))
        else:
            parts.append(_unique_rule(tables[r.table], r) if r.kind == "unique" else _reference_rule(tables, r))
    if known:
        spark = next(iter(tables.values())).sparkSession
        parts.insert(0, spark.createDataFrame([(r.table, r.kind, r.column, n) for r, n in known],
                                              "table_name string, rule string, column_name string, violations bigint"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def star_rules(varchar_limits: dict[str, dict[str, int]]) -> list[Rule]:
    """The rules declared by the warehouse DDL, plus staging rows lost in the fact lookups."""
    rules = [
        Rule("dim_department", "unique", "department_id"),
        Rule("dim_department", "unique", "department_name"),
        Rule("dim_department", "not_null", "department_name"),
        Rule("dim_job_role", "unique", "job_role_id"),
        Rule("dim_job_role", "unique", "job_role_name"),
        Rule("dim_job_role", "not_null", "job_role_name"),
        Rule("dim_employee", "unique", "employee_key"),
        Rule("dim_employee", "unique", "employee_id"),
        Rule("dim_employee", "not_null", "employee_id"),
        Rule("fact_attrition", "unique", "attrition_id"),
        Rule("fact_attrition", "foreign_key", "employee_key", ref_table="dim_employee", ref_column="employee_key"),
        Rule("fact_attrition", "foreign_key", "department_id", ref_table="dim_department",
             ref_column="department_id"),
        Rule("fact_performance", "unique", "performance_id"),
        Rule("fact_performance", "foreign_key", "employee_key", ref_table="dim_employee", ref_column="employee_key"),
        Rule("fact_performance", "foreign_key", "job_role_id", ref_table="dim_job_role", ref_column="job_role_id"),
        Rule("fact_performance", "foreign_key", "department_id", ref_table="dim_department",
             ref_column="department_id"),
        Rule("staging", "lookup_miss", "Department", ref_table="dim_department", ref_column="department_name"),
        Rule("staging", "lookup_miss", "JobRole", ref_table="dim_job_role", ref_column="job_role_name"),
        Rule("staging", "lookup_miss", "EmployeeNumber", ref_table="dim_employee", ref_column="employee_id"),
    ]
    for table, cols in varchar_limits.items():
        for col_name, limit in cols.items():
            if table != "dim_time":
                rules.append(Rule(table, "max_length", col_name, limit=limit))
    return rules
