"""production@2 against the labels and against menu and table text."""

import duckdb
import plain
from tables import SF

import corpus_pipeline
from stafflens.llm import quality


def test_symbol_heavy_junk_goes_and_clean_text_stays(spark):
    texts = ["home | news | shop | help | about | login | cart | terms", "one two | three four five six seven eight nine ten", "no symbol at all in this line of more than ten words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in quality.filter_documents(df).collect()] == [0, 1, 2]
    assert [r.doc_id for r in quality.filter_documents(df, quality.PRODUCTION_2).collect()] == [1, 2]
    rows = quality.ledger(df, rules=quality.ALL_RULES)
    assert {r.doc_id: r.failed for r in rows.collect()} == {0: 1 << 7, 1: 0, 2: 0}
    assert {r.rule: r.n_only for r in quality.ablations(rows, quality.PRODUCTION_2).collect()}["dense_symbols"] == 1
    assert quality.PRODUCTION.mask == (1 << 7) - 1  # production@1 is as it was


def test_first_stage_by_the_labels(spark):
    found = duckdb.connect().execute(f"SELECT doc_id, text, quality FROM read_parquet('{SF}/documents.parquet') d JOIN read_parquet('{SF}/labels.parquet') l USING (doc_id)").fetchall()
    before = {q: {d for d, t, own in found if own == q and plain.failed(plain.measures(t)) == 0} for q in (0, 1)}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    assert before[1] <= kept  # no clean document is lost by the new rule
    assert before[0] and not before[0] & kept
