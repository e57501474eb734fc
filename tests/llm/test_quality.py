import random

import plain
from pyspark.sql import functions as F

from stafflens.llm import quality


def _texts():
    rng = random.Random(6)
    pool = ["a", "bb", "ccc", "é", "#x", "!!", "|", "\n", " ", "\t", "\x0b", "日本", "𝒳y"]
    out = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    out += ["x y z w v " * k for k in range(4)] + ["a b c d e f a b c d e f", "q " * 9, "a a a a a a"]
    return [*out, None, "", "   ", "same line here\n" * 5, " ".join(f"w{i}" for i in range(60_000)), "one two three four " * 4000, "z" * 200_000]


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, failed int")


def test_ledger_equals_plain_measures(spark):
    texts = _texts()
    rows = quality.apply_policy(quality.ledger(_frame(spark, texts)), quality.PRODUCTION).collect()
    assert len(rows) == len(texts)
    for r in rows:
        m = plain.measures(texts[r.doc_id])
        assert {k: r[k] for k in quality.MEASURES} == m, r.doc_id
        assert r.failed == plain.failed(m) and r.kept == (r.failed == 0) and r.policy == "production@1"


def test_policies_and_ablations(spark):
    texts = _texts()[:100]
    rows = quality.ledger(_frame(spark, texts))
    masks = [plain.failed(plain.measures(t)) for t in texts]
    policy = quality.Policy("some", 3, ("few_words", "symbols", "exclamations"))
    got = {r.rule: tuple(r)[1:] for r in quality.ablations(rows, policy).collect()}
    for rule in policy.rules:
        bit = next(1 << r.bit for r in quality.RULES if r.name == rule)
        own = [m & policy.mask for m in masks]
        assert got[rule] == (sum(1 for m in own if m & bit), sum(1 for m in own if m == bit), sum(1 for m in own if not m & ~bit))
    assert quality.ablations(rows.limit(0), policy).collect()[0][1:] == (0, 0, 0)


def test_filter_keeps_columns_and_repeats(spark):
    texts = ["a good plain line of more than ten words in it today", "too short", None]
    df = _frame(spark, texts).union(_frame(spark, texts))
    out = quality.filter_documents(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [0, 0]
    assert quality.filter_documents(df.where(F.lit(False))).count() == 0


def test_conditions_stay_above_the_measurements(spark, tmp_path):
    _frame(spark, _texts()[:20]).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for out in (quality.filter_documents(df), quality.apply_policy(quality.ledger(df), quality.BASE).where("kept and n_lines > 1")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "DataFilters: []" in plan and plan.count("split(") <= 2


def test_kept_names_meet_no_name_of_the_ledger(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, __w int, __t int, __lines int")
    row = quality.ledger(df, keep=("doc_id", "__w", "__t", "__lines")).collect()[0]
    assert (row["__w"], row["__t"], row["__lines"], row.n_words) == (5, 6, 7, 2)
