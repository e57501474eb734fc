"""Every query against its SQL, on empty tables, and the pipeline against plain Python."""

from collections import Counter

import duckdb
import plain
import pytest
from tables import SMALL

import corpus_pipeline
from stafflens.llm import packing, registry
from stafflens.plans.check import compare, duck_connection


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, name):
    result = compare(name, registry.QUERIES[name](spark, SMALL), registry.ORACLE[name], duck_connection(SMALL))
    assert result.ok, "\n".join(result.notes)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_on_empty_tables_with_more_columns(spark, tmp_path, name):
    for table in ("documents", "pages", "embeddings", "benchmark"):
        df = spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0)
        df.selectExpr("*", "1 AS row", "2 AS n", "3 AS unit", "4 AS id", "5 AS kept").write.parquet(f"{tmp_path}/{table}.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline_equals_plain(spark):
    rows = duckdb.connect().execute(f"SELECT doc_id, text, source FROM read_parquet('{SMALL}/documents.parquet')").fetchall()
    rows = [r for r in rows if plain.failed(plain.measures(r[1]), later=True) == 0]
    near = plain.near_components([r[:2] for r in rows], 80)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    # Pseudonyms keep the number of words; their texts are compared in test_pii.
    copies = dict(plain.mix_copies(rows))
    want = Counter()
    for d, t, _ in rows:
        n = len(plain.words(t))
        for piece, start in enumerate(range(0, n, max(packing.CAPACITIES))):
            want[d, piece, start, min(n - start, max(packing.CAPACITIES))] += copies[d]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in got) == +want
    used = Counter()
    for r in got:
        used[r.bin_id, r.capacity] += r.n_tokens
    assert all(n <= c for (_, c), n in used.items()) and len({b for b, _ in used}) == len(used)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.dtypes == docs.dtypes, name
    stage = dict(corpus_pipeline.STAGES)["personal_data"]
    assert stage(spark, docs, SMALL).where("n_chars != length(text)").count() == 0
