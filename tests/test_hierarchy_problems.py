"""Cycles, what hangs under them and chains that end at a missing parent."""

import random

import pytest

from stafflens.operators.hierarchy import UnreachableNodes, hierarchy_depth, hierarchy_problems


def plain(up):
    out = {}
    for n in up:
        path, x = [], n
        while x in up and x not in path:
            path.append(x)
            x = up[x]
        if x is None:
            continue
        if x not in up:
            out[n] = ("under_missing", x)
        else:
            cycle = path[path.index(x):]
            out[n] = ("cycle" if n in cycle else "under_cycle", min(cycle))
    return out


def found(spark, up, kind="bigint"):
    df = spark.createDataFrame(list(up.items()), f"employee_id {kind}, manager_id {kind}").repartition(4)
    rows = hierarchy_problems(df).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: (r.problem, r.cause) for r in rows}


def test_kinds(spark):
    up = {1: None, 2: 1, 3: 4, 4: 3, 5: 3, 6: 5, 7: 99, 8: 7, 9: 9, 10: 9, 11: 2}
    got = found(spark, up)
    assert got == plain(up) == {3: ("cycle", 3), 4: ("cycle", 3), 5: ("under_cycle", 3), 6: ("under_cycle", 3),
                                7: ("under_missing", 99), 8: ("under_missing", 99), 9: ("cycle", 9), 10: ("under_cycle", 9)}


def test_long_cycle_and_long_tail(spark):
    order = list(range(1, 301))
    random.Random(4).shuffle(order)
    up = {a: b for a, b in zip(order, order[1:] + order[:1])}
    # A tail that enters the cycle, whose smallest id is its own far end.
    up |= {1000 + i: 1001 + i for i in range(200)} | {1200: order[7], 0: 1000}
    assert found(spark, up) == plain(up)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    up = {n: rnd.choice([None, *([rnd.randrange(150)] * 12)]) for n in rnd.sample(range(150), 110)}
    got = found(spark, up)
    assert got == plain(up)
    df = spark.createDataFrame(list(up.items()), "employee_id bigint, manager_id bigint")
    assert {r.employee_id for r in hierarchy_depth(df).collect()} == set(up) - set(got)


def test_text_ids_hot_parent_and_clean_tree(spark):
    up = {"r": None} | {f"n{i:03}": "x" for i in range(120)} | {"x": "y", "y": "x"}
    assert found(spark, up, "string") == plain(up)
    assert found(spark, {1: None, 2: 1, 3: 1}) == {} == found(spark, {1: None})


def test_null_ids_and_strict(spark):
    df = spark.createDataFrame([(None, 3), (3, 3), (1, None)], "employee_id bigint, manager_id bigint")
    assert {tuple(r) for r in hierarchy_problems(df).collect()} == {(3, "cycle", 3)}
    with pytest.raises(UnreachableNodes, match="3"):
        hierarchy_depth(df.where("employee_id IS NOT NULL"), strict=True)
    assert hierarchy_depth(df.where("employee_id = 1"), strict=True).count() == 1
