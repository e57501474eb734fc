import os
import random

import pandas as pd
import plain
from conftest import SF_SMALL
from pyspark.sql import functions as F
from stafflens.llm import common, neardup, paragraphs, substrings
from stafflens.llm.common import components


def _components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    return {r.node: r.root for r in components(df).collect()}


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    links += [(1000 + i, 1001 + i) for i in range(60)]  # a chain
    links += [(2000, 2000 + i) for i in range(1, 300)] + [(2500, 2001)]  # a hot node
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert _components(spark, links) == plain.components(nodes, [(a, b) for a, b in links if a != b])


def test_components_of_nothing(spark):
    assert _components(spark, []) == {}
    assert _components(spark, [(3, 3)]) == {}


def test_stored_tables_and_shuffles_go_when_they_are_done_with(spark):
    before = {k: spark.conf.get(k) for k in common.WRITING}
    df = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "gone")
    folder = {f.rsplit("/", 1)[0].split(":", 1)[1] for f in df.inputFiles()}.pop()
    assert df.count() == 7 and os.path.isdir(folder)
    assert {k: spark.conf.get(k) for k in common.WRITING} == before
    common.discard(df)
    assert not os.path.exists(folder)
    other = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    common.discard(other)  # no table of ours
    assert other.count() > 0


def test_tasks_of_a_stored_table_get_few_megabytes_at_a_time(spark):
    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    rows = spark.range(9000, numPartitions=1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    n = [r.n for r in common.stored(rows.mapInPandas(sizes, "n long"), "sizes").collect()]
    assert sum(n) == 9000 and max(n) <= 2000


def left_in_shared_folder(spark, run):
    """Labels of the tables that are left after ``run``."""
    root = common.shared_folder(spark).split(":", 1)[-1] + "/llm"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    run().collect()
    return {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}


def test_operators_leave_only_the_tables_their_result_reads(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(120)) for _ in range(12)]
    texts += [texts[0] + " and more", "\n".join(texts[1:4]), texts[5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert left_in_shared_folder(spark, lambda: substrings.repeated_spans(df, length=60)) == {"known", "results"}
    assert left_in_shared_folder(spark, lambda: neardup.components_of_documents(df)) == {"near-rows", "near-roots"}
    left = left_in_shared_folder(spark, lambda: paragraphs.repeated_documents(df))
    assert not left & {"units-digest", "units-sets", "units-moved", "moved", "places", "paragraphs", "members"}
