"""Side-by-side check of a catalog key against its SQL oracle (DuckDB).

Compares row count, column names, column types and the multiset of rows
(order-insensitive, exact values; floats compared by their repr).
"""

from __future__ import annotations

import datetime as _dt
import decimal
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

_SPARK_TYPES = {"bigint": "bigint", "int": "int", "double": "double", "string": "string", "date": "date",
                "timestamp_ntz": "timestamp", "timestamp": "timestamp", "boolean": "boolean", "float": "float",
                "smallint": "smallint", "tinyint": "tinyint"}
_DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
               "TIMESTAMP": "timestamp", "BOOLEAN": "boolean", "FLOAT": "float", "SMALLINT": "smallint",
               "TINYINT": "tinyint", "HUGEINT": "hugeint"}


def spark_type(t: str) -> str:
    if t.startswith("decimal"):
        return "decimal"
    return _SPARK_TYPES.get(t, t)


def duck_type(t: str) -> str:
    if t.startswith("DECIMAL"):
        return "decimal"
    return _DUCK_TYPES.get(t, t)


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return repr(v)  # -0.0 stays distinct from 0.0, as a value hash would see it
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (_dt.date, _dt.datetime)):
        return v.isoformat()
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) for v in row)


@dataclass
class CheckResult:
    key: str
    spark_rows: int
    oracle_rows: int
    columns_match: bool
    types_match: bool
    values_match: bool
    notes: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return self.spark_rows == self.oracle_rows and self.columns_match and self.types_match and self.values_match


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def compare(key: str, df: DataFrame, sql: str, con) -> CheckResult:
    s_cols = df.columns
    s_types = {f.name: spark_type(f.dataType.simpleString()) for f in df.schema.fields}
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_types = {d[0]: duck_type(str(d[1])) for d in cur.description}
    d_rows = cur.fetchall()
    notes = []
    cols_ok = sorted(s_cols) == sorted(d_cols) and len(set(s_cols)) == len(s_cols)
    if not cols_ok:
        notes.append(f"columns spark={s_cols} oracle={d_cols}")
    types_ok = cols_ok and all(s_types[c] == d_types[c] for c in s_cols)
    if cols_ok and not types_ok:
        notes.append("types " + ", ".join(f"{c}: {s_types[c]} vs {d_types[c]}" for c in s_cols
                                          if s_types[c] != d_types[c]))
    values_ok = False
    if cols_ok:
        order = sorted(s_cols)
        si = [s_cols.index(c) for c in order]
        di = [d_cols.index(c) for c in order]
        a = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=_key)
        b = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=_key)
        values_ok = a == b
        if not values_ok:
            sa, sb = set(a), set(b)
            only_s = [r for r in a if r not in sb][:3]
            only_d = [r for r in b if r not in sa][:3]
            notes.append(f"cols={order}")
            notes.append(f"only spark: {only_s}")
            notes.append(f"only oracle: {only_d}")
    return CheckResult(key, len(s_rows), len(d_rows), cols_ok, types_ok, values_ok, notes)


def check_keys(spark: SparkSession, sf_dir: str, keys=None) -> list[CheckResult]:
    from .catalog import CATALOG
    from .oracle import ORACLE
    con = duck_connection(sf_dir)
    out = []
    for k in keys or list(CATALOG):
        if k not in ORACLE:
            continue
        out.append(compare(k, CATALOG[k](spark, sf_dir), ORACLE[k], con))
    return out
