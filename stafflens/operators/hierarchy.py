"""Depth of every node in a manager tree.

Pointer doubling: each row holds an ancestor and the number of levels up to it.
A round looks every unfinished row's ancestor up in the same table and adds the
two distances, so after k rounds all rows of the first 2^k levels are finished:
a chain of a thousand levels takes ten rounds, and a round is one equi-join,
whatever the depth. There is no limit on the depth.

The rounds end when one finishes no further row: any reachable row left over
would have an ancestor that the round had finished. What is left then hangs on
a cycle and is not returned, as in SQL; rows under a missing parent leave in the
round that misses it. ``strict`` reports both instead, and ``hierarchy_problems``
tells them apart, with the smallest id of each cycle. Ids must be unique (one aggregate checks it), because a
repeated id can close a cycle that is reachable from a root; repeated ids are
reported, not guessed at.

Each round's table is written with a reliable checkpoint, so no round replays an
earlier one after an executor loss. Both sides of the join are plain shuffles of
that table, so the adaptive planner can split a manager with very many reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


class DuplicateNodes(ValueError):
    """Some node ids occur in more than one row."""


class UnreachableNodes(ValueError):
    """Some rows hang on a cycle or under a missing parent."""


def _checkpointed(df: DataFrame, **measures) -> tuple[DataFrame, dict]:
    """The frame checkpointed, and aggregates of it observed in the same job."""
    obs = Observation()
    out = df.observe(obs, *[m.alias(name) for name, m in measures.items()]).checkpoint(eager=True)
    return out, obs.get


def hierarchy_depth(
    nodes: DataFrame,
    *,
    node: str = "employee_id",
    parent: str = "manager_id",
    depth_name: str = "depth",
    materialize_input: bool = True,
    strict: bool = False,
) -> DataFrame:
    """Every row reachable from a root, with its depth (roots = 1).

    ``materialize_input`` checkpoints ``nodes`` once, so a derived node table is
    not computed again for the result; turn it off for a stored table. Raises
    ``DuplicateNodes`` if an id has several rows. A row without id is nobody's
    parent and gets its own depth. With ``strict``, rows that no root reaches
    raise ``UnreachableNodes`` instead of being left out.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    if materialize_input:
        nodes = nodes.checkpoint(eager=True)
    edges = nodes.select(F.col(node).alias("_n"), F.col(parent).alias("_up")).where(F.col("_n").isNotNull())
    repeated = edges.groupBy("_n").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1).limit(3).collect()
    if repeated:
        raise DuplicateNodes(f"{node}: {', '.join(repr(r[0]) for r in repeated)} have several rows")

    root = F.col("_up").isNull()
    state = edges.select("_n", "_up", F.lit(1).cast("bigint").alias("_steps"), root.alias("_done"))
    open_rows = {"left": F.count_if(~F.col("_done"))}
    state, seen = _checkpointed(state, **open_rows)
    while seen["left"]:
        above = state.select(F.col("_n").alias("_a"), F.col("_up").alias("_a_up"), F.col("_steps").alias("_a_steps"),
                             F.col("_done").alias("_a_done"))
        moved = state.where(~F.col("_done")).join(above, F.col("_up") == F.col("_a")).select(
            "_n", F.col("_a_up").alias("_up"), (F.col("_steps") + F.col("_a_steps")).alias("_steps"),
            F.col("_a_done").alias("_done"), F.col("_a_done").alias("_new"))
        finished = state.where("_done").withColumn("_new", F.lit(False))
        state, now = _checkpointed(finished.unionByName(moved), new=F.count_if("_new"), **open_rows)
        state = state.drop("_new")
        # A round that drops rows under a missing parent may finish none and still change the rest.
        if not now["new"] and now["left"] == seen["left"]:
            break
        seen = now
    depths = state.where("_done").select(F.col("_n").alias("_p"), F.col("_steps").alias("_d"))
    out = nodes.join(depths, nodes[parent] == F.col("_p"), "left")
    depth = F.when(nodes[parent].isNull(), F.lit(1)).otherwise(F.col("_d") + 1)
    out = out.withColumn(depth_name, depth.cast("int")).drop("_p", "_d")
    if strict:
        lost = out.where(F.col(depth_name).isNull()).select(node).limit(3).collect()
        if lost:
            raise UnreachableNodes(f"{node}: no root reaches {', '.join(repr(r[0]) for r in lost)}; see hierarchy_problems")
    return out.where(F.col(depth_name).isNotNull())


CYCLE, UNDER_CYCLE, UNDER_MISSING = "cycle", "under_cycle", "under_missing"


def hierarchy_problems(nodes: DataFrame, *, node: str = "employee_id", parent: str = "manager_id",
                       materialize_input: bool = True) -> DataFrame:
    """(node, problem, cause): one row for every row of ``nodes`` that no root reaches.

    ``cycle``: the row is its own ancestor, cause is the smallest id of its
    cycle; ``under_cycle``: its ancestors end in a cycle, cause is that cycle's
    smallest id; ``under_missing``: they end at an id that has no row, which is
    the cause. A row without id is left out; repeated ids raise.

    The residue of the depth rounds is doubled on: each row holds an ancestor
    2^k levels up and the smallest id on the way there. Once the set of those
    ancestors stays the same size it maps onto itself, so it is the cycles; once
    also no smallest id falls any more, each is that of the whole cycle. Both
    hold after log2(rows) rounds at the latest.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    if materialize_input:
        nodes = nodes.checkpoint(eager=True)
    fine = hierarchy_depth(nodes, node=node, parent=parent, materialize_input=False).select(F.col(node).alias("_ok"))
    edges = nodes.select(F.col(node).alias("_n"), F.col(parent).alias("_up")).where(F.col("_n").isNotNull())
    lost = edges.join(fine, F.col("_n") == F.col("_ok"), "left_anti").checkpoint(eager=True)

    # A parent outside the residue has no row at all: below one that has, the row would be reachable.
    here = lost.select(F.col("_n").alias("_a"))
    state = lost.join(here, F.col("_up") == F.col("_a"), "left").select(
        "_n", "_up", F.col("_n").alias("_low"), F.col("_a").isNull().alias("_done")).checkpoint(eager=True)
    size = -1
    while True:
        above = state.select(F.col("_n").alias("_a"), F.col("_up").alias("_a_up"), F.col("_low").alias("_a_low"),
                             F.col("_done").alias("_a_done"))
        moved = state.where(~F.col("_done")).join(above, F.col("_up") == F.col("_a"))
        # The low of a finished ancestor plays no part: its chain has no cycle.
        low = F.when(F.col("_a_done"), F.col("_low")).otherwise(F.least("_low", "_a_low"))
        moved = moved.select("_n", F.col("_a_up").alias("_up"), low.alias("_low"), F.col("_a_done").alias("_done"),
                             ((low < F.col("_low")) | F.col("_a_done")).alias("_moved"))
        state, seen = _checkpointed(state.where("_done").withColumn("_moved", F.lit(False)).unionByName(moved),
                                    moved=F.count_if("_moved"), left=F.count_if(~F.col("_done")))
        state = state.drop("_moved")
        if seen["moved"] and seen["left"]:
            continue
        cycles, now = _checkpointed(state.where(~F.col("_done")).select(F.col("_up").alias("_c")).distinct(), n=F.count(F.lit(1)))
        if now["n"] == size or not seen["left"]:
            break
        size = now["n"]
    label = cycles.join(state.select(F.col("_n").alias("_l"), F.col("_low").alias("_cause")),
                        F.col("_c") == F.col("_l")).select("_c", "_cause")
    on_cycle = state.where(~F.col("_done")).join(label, F.col("_up") == F.col("_c"))
    member = cycles.withColumnRenamed("_c", "_m")
    on_cycle = on_cycle.join(member, F.col("_n") == F.col("_m"), "left").select(
        F.col("_n").alias("node"), F.when(F.col("_m").isNotNull(), CYCLE).otherwise(UNDER_CYCLE).alias("problem"),
        F.col("_cause").alias("cause"))
    ended = state.where("_done").select(F.col("_n").alias("node"), F.lit(UNDER_MISSING).alias("problem"), F.col("_up").alias("cause"))
    return on_cycle.unionByName(ended)
