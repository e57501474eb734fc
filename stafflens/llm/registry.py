"""The operators as queries over the driver tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stafflens.llm import alignment, decontaminate, langid, mixing, neardup, packing, paragraphs, periodic, pii, quality, substrings, topk, urls
from stafflens.llm.common import let, words
from stafflens.llm.sql import SQL

#: Key of the pseudonyms in these queries; an own corpus takes an own secret.
PII_KEY = "stafflens-demo-key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


#: Rules of the url query; an own corpus passes its own list.
URL_RULES = (
    (urls.ALLOW, "org/"),
    (urls.BLOCK, "example.org/es/"),
    (urls.BLOCK, "example.org/en/1"),
    (urls.ALLOW, "com/fr/"),
    (urls.BLOCK, "com/de/"),
)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), urls.build_index(spark, URL_RULES))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(documents, PII_KEY, counts=True)


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_documents(_table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substrings.repeated_spans(_table(spark, sf_dir, "documents"), short=substrings.SHORT)
    return spans.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_short")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = documents.select("doc_id", "text", "lang", held_out.alias("held_out"))
    profiles = langid.learn(rows.where("not held_out"))
    return langid.identify(rows, profiles, keep=("doc_id", "held_out"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components_of_documents(_table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(_table(spark, sf_dir, "documents"))
    return taken.selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken", "copies")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents"), rules=quality.ALL_RULES), quality.PRODUCTION_2)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes(quality.BASE)).alias("base_failed"), "kept", "n_lines", "n_exclaims", "failed")


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


#: Vocabulary files of the alignment query; an own corpus passes its own paths.
TOKENIZERS = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(_table(spark, sf_dir, "documents"), *TOKENIZERS)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _looped(doc_id: Column, text: Column) -> Column:
    """The query's own texts: of a tenth of the documents, the words from some place on repeat with some period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: w[place(i).cast("int")])
        return F.when(n > 0, F.array_join(moved, " "))

    return F.when(h % 10 == 0, let(words(text), repeated)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", _looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(documents)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_url_filters,
        op3_pii,
        op4_paragraph_dedup,
        op5_suffix_array_dedup,
        op6_language_id,
        op7_minhash_near_dedup,
        op8_exact_top_k,
        op9_mixing,
        op10_quality_rules,
        op11_benchmark_decontamination,
        op12_cross_tokenizer_alignment,
        op13_periodic_runs,
    )
}
ORACLE = {k: SQL[k] for k in QUERIES if k in SQL}
