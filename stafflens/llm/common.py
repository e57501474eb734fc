"""Shared pieces: words, stored intermediate tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stafflens.session import delete_at_exit, delete_now, ensure_checkpoint_dir

#: Word separators: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of the maximal runs of characters that are no separator; null text has none."""
    blanks = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.array_remove(F.split(blanks, " "), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where it is unset."""
    return ensure_checkpoint_dir(spark).rstrip("/")


#: While a table is stored: its shuffle files go as soon as it is written, and a Python task gets a few megabytes at a time.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """The settings of ``WRITING`` for the statements inside; the session's own come back."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the current stage only, and
    later jobs do not derive the table again. The folder goes when the session's
    JVM ends, or with ``discard``.
    """
    root = f"{shared_folder(df.sparkSession)}/llm"
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    with _writing(df.sparkSession):
        df.write.parquet(path, compression=compression)
    delete_at_exit(df.sparkSession, root)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` returned, when all that reads them is stored itself."""
    for table in tables:
        root = f"{shared_folder(table.sparkSession)}/llm/"
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            # Spark may spell the root in another way (file:/ or file:///).
            if root.split(":", 1)[-1].lstrip("/") in folder:
                delete_now(table.sparkSession, folder)


def components(edges: DataFrame, label: str = "cc", max_rounds: int | None = None) -> DataFrame:
    """Connected components by alternating large-star and small-star.

    ``edges`` has two columns (a, b) of one orderable type; direction, repeats
    and self loops do not matter. Returns (node, root): every node that has a
    link to another one, with the smallest node of its component. Each half
    round is one aggregation on the node for its smallest neighbour, which is
    stored, and one join on it. So a node with very many links is met by a
    partial minimum and by a join of two plain shuffles, whose hot partitions
    the adaptive planner splits, never by one gathered list.
    The rounds end when the links no longer change (a logarithmic number);
    ``max_rounds`` is a guard for tests and raises.
    """
    a, b = edges.columns
    current = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v != u").distinct()
    current = stored(current, label)
    state = _state(current)
    rounds = 0
    while state[0]:
        large, low = _large_star(current)
        small, lowest = _small_star(large)
        new = stored(small, label)
        discard(current, low, lowest)
        current, before, state = new, state, _state(new)
        rounds += 1
        if state == before:
            # A fixpoint of both stars is a set of stars around the smallest nodes.
            break
        if max_rounds and rounds >= max_rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.union(current.select(F.col("u"), F.col("u")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number of links and two digests of the set (two numbers to the driver)."""
    h = F.xxhash64("v", "u")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 30)))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours; also the table read for it."""
    both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    low = both.groupBy("v").agg(F.min("u").alias("m"))
    low = stored(low.select("v", F.least("v", "m").alias("m")), "low")
    # Rows of ``both`` whose neighbour is the larger end are the links (u, v) seen from u.
    seen = edges.select(F.col("u").alias("v"), F.col("v").alias("n"))
    return seen.join(low, "v").select(F.col("n").alias("v"), F.col("m").alias("u")).where("v != u").distinct(), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link a node and its smaller neighbours to the smallest of them; also the table read for it."""
    low = stored(edges.groupBy("v").agg(F.min("u").alias("m")), "low")
    moved = edges.join(low, "v")
    pairs = moved.select(F.col("u").alias("v"), F.col("m").alias("u")).union(moved.select("v", F.col("m").alias("u")))
    return pairs.where("v != u").distinct(), low
