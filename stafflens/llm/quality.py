"""Quality rules as a bitmask ledger (native expressions only).

``ledger`` measures every text once and evaluates every rule once: one row per
input row with the measurements and a ``failed`` bit mask. A ``Policy`` is a
named, versioned set of rules; ``apply_policy`` is one bitwise test on the
stored mask, and ``ablations`` counts from the masks what each rule removes,
alone and together with the others, without reading a text again.

Defined results: a null or empty text has no words and all counts 0; repeated
rows are judged alike; an empty table gives an empty ledger; extra columns of
the input are carried only where named in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stafflens.llm.common import SPACES, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Column | str  # SQL over the measurements


#: Order is the bit order; a rule keeps its bit for good, new rules get new bits.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "n_symbols > n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 30 * n_words"),
    Rule(6, "exclamations", "n_exclaims > n_words"),
)
#: Rules that production@2 adds; a ledger has their bits only where it is asked for them.
LATER = (Rule(7, "dense_symbols", "10 * n_symbols > n_words"),)
ALL_RULES = RULES + LATER
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in ALL_RULES}
        return reduce(lambda m, n: m | 1 << bits[n], self.rules, 0)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
PRODUCTION = Policy("production", 1, tuple(r.name for r in RULES))
PRODUCTION_2 = Policy("production", 2, tuple(r.name for r in ALL_RULES))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _gram(w: Column, i: Column, join) -> Column:
    return join(*(F.get(w, i + k) for k in range(WINDOW)))


def _repeated(w: Column) -> Column:
    """Words inside a window of five that is found twice or more in the array ``w``.

    The windows are sorted with their positions; equal neighbours are repeats.
    The covered words follow from the gaps between the repeated positions.
    """
    grams = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(_gram(w, i, lambda *c: F.concat_ws(" ", *c)).alias("g"), i.alias("p"))))

    def hits(s: Column) -> Column:
        def position(k: Column) -> Column:
            same = (F.get(s, k)["g"] == F.get(s, k - 1)["g"]) | (F.get(s, k)["g"] == F.get(s, k + 1)["g"])
            return F.when(same, F.get(s, k)["p"])

        found = F.transform(F.sequence(F.lit(0), F.size(s) - 1), position)
        return F.sort_array(F.filter(found, lambda p: p.isNotNull()))

    def covered(ps: Column) -> Column:
        step = lambda acc, k: acc + F.least(F.lit(WINDOW), F.coalesce(F.get(ps, k + 1) - F.get(ps, k), F.lit(WINDOW)))
        return F.when(F.size(ps) == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(ps) - 1), F.lit(0), step))

    return let(let(grams, hits), covered)


def measured(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus the MEASURES (long) of each row's whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    # What is kept travels as one struct, so that its names meet none of these.
    df = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("__kept"), t.alias("__t"), words(t).alias("__w"))
    # A window hash that is nowhere repeated proves that no window is: only other texts are sorted.
    hashes = F.transform(F.sequence(F.lit(0), F.size("__w") - WINDOW), lambda i: _gram(F.col("__w"), i, F.xxhash64))
    df = df.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    df = df.withColumn("__h", F.when(F.size("__w") >= WINDOW, hashes))
    doubtful = F.size(F.array_distinct("__h")) < F.size("__h")
    # A condition on the ledger must not be copied down into these steps: it would split the text again
    # for each of its windows. The optimizer moves no condition below a column that is not deterministic.
    columns = {
        "n_words": F.when(F.monotonically_increasing_id() >= 0, F.size("__w")),
        "word_chars": _without(F.col("__t"), SPACES),
        "n_symbols": F.length("__t") - _without(F.col("__t"), SYMBOLS),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.when(doubtful, _repeated(F.col("__w"))).otherwise(0),
        "n_lines": F.size("__lines"),
        "n_exclaims": F.length("__t") - _without(F.col("__t"), "!"),
    }
    measures = F.struct(*(columns[c].cast("long").alias(c) for c in MEASURES))
    return df.select("__kept", measures.alias("__m")).select("__kept.*", "__m.*")


def ledger(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``failed`` (long): bit r.bit is set where rule r of ``rules`` fails."""
    m = measured(df, text, keep)
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    return m.withColumn("failed", reduce(lambda x, y: x.bitwiseOR(y), bits))


def passes(policy: Policy, failed: Column | str = "failed") -> Column:
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``policy`` (name@version) and ``kept``."""
    return rows.withColumn("policy", F.lit(f"{policy.name}@{policy.version}")).withColumn("kept", passes(policy))


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of ``policy`` does: rows it fails, rows only it fails, rows kept without it.

    The ledger is first counted by mask (at most 2^rules groups, partial counts
    per task); every figure is a bitwise sum over those counts.
    """
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    out = []
    for r in (r for r in ALL_RULES if r.name in policy.rules):
        bit, rest = 1 << r.bit, policy.mask & ~(1 << r.bit)
        total = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), F.col("n"))), F.lit(0))
        out.append(F.struct(F.lit(r.name).alias("rule"), total(f"(m & {bit}) != 0").alias("n_failed"), total(f"m = {bit}").alias("n_only"), total(f"(m & {rest}) = 0").alias("n_kept_without")))
    return masks.agg(F.array(*out).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def filter_documents(df: DataFrame, policy: Policy = PRODUCTION, text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``policy`` keeps, with all their columns."""
    whole = df.select(F.struct(*df.columns).alias("__row"), F.col(text).alias("__text"))
    rules = tuple(r for r in ALL_RULES if r.name in policy.rules)
    return ledger(whole, "__text", ("__row",), rules).where(passes(policy)).select("__row.*")
