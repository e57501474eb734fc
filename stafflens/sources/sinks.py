"""Table sink (W02): write a frame with its declared schema, replace or append.

Columns are selected and cast to the declared schema first (missing nullable
columns become typed NULLs, as an INSERT with a shorter column list does), so
a table never drifts from its DDL. Writes are task-parallel Parquet files;
``partition_by`` lays facts out by date for partition pruning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema``'s columns in order, cast; absent nullable columns become NULL."""
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in have:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.nullable:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"required column {f.name!r} is missing")
    return df.select(*cols)


def write_table(df: DataFrame, path: str, *, schema: T.StructType | None = None, mode: str = "overwrite",
                partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Write ``df`` (conformed to ``schema`` if given) to ``path``."""
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be overwrite or append")
    out = conform(df, schema) if schema is not None else df
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
