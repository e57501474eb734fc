"""Mixing sources to target weights (native expressions only).

Words are summed per source, a target per source follows from the weights, and
each document is taken ``floor(rate)`` times plus one more with a probability
equal to the fraction of ``rate = target / source size``. The draw is a hash of
the seed and the document's id: no state, the same in every run, on every
partitioning, and for every retried task.

Targets: the sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ...
and share ``budget`` times the sum of all sizes. No target exceeds ``ceiling``
times its source's size; the excess is shared again by weight until none is
above.

Defined results: a null text has size 0, an empty source target 0; equal ids
draw alike; the null source is a source of its own; an empty table gives an
empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stafflens.llm.common import stored, words

WEIGHTS = (5, 2, 1)
SEED = "mix-1"


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, ceiling: int = 2) -> DataFrame:
    """(source, source_size, target): one row per source.

    The documents are reduced to one row per source by partial sums first. The
    order of the sources and the levelling work on that small table; a pass of
    the levelling sends two sums to the driver.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    per = stored(per.withColumn("weight", weight.cast("long")), "sources").withColumn("cap", F.lit(ceiling) * F.col("source_size"))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while True:
        # Level of the sources below their cap, given which are at it: the level only rises.
        at_cap = F.lit(level) * F.col("weight") > F.col("cap")
        fixed, shared, n = per.agg(F.sum(F.when(at_cap, F.col("cap")).otherwise(0)), F.sum(F.when(at_cap, 0).otherwise(F.col("weight"))), F.sum(at_cap.cast("long"))).first()
        if not shared or n == before:
            break
        level, before = (budget * total - fixed) / shared, n
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a keyed hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), seed: str = SEED, **targets) -> DataFrame:
    """``keep`` plus size, source_size, target and copies: how often the mix takes each row.

    The table of targets is joined on the source. It has a row per source; its
    size decides whether the planner broadcasts it, and a hot source on the
    other side is split by the adaptive join.
    """
    rows = df.select(F.struct(*keep).alias("__row"), F.col(source).alias("__source"), F.col(key).alias("__key"), F.size(words(F.col(text))).cast("long").alias("__size"))
    goal = source_targets(rows, "__source", "__size", **targets)
    joined = rows.join(goal, F.col("__source").eqNullSafe(F.col("source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("__rate", rate)
    n = F.floor("__rate") + (draw(F.col("__key"), seed) < F.col("__rate") - F.floor("__rate")).cast("long")
    return joined.select("__row.*", F.col("__size").alias("size"), "source_size", "target", n.alias("copies"))


def mix(df: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``df`` as often as it is taken, columns unchanged."""
    rows = df.select(F.struct(*df.columns).alias("__doc"), F.col(options.pop("text", "text")).alias("__text"), F.col(options.pop("source", "source")).alias("__from"), F.col(options.pop("key", "doc_id")).alias("__id"))
    taken = copies(rows, "__text", "__from", "__id", ("__doc",), **options).where("copies > 0")
    return taken.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__doc.*")
