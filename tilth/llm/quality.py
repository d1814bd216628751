"""Quality rules as a ledger of failure bits.

Each rule is evaluated once for each text; the ledger keeps its measurements and one bit a rule. A policy is a version
and the set of rules that count, so applying another policy, or leaving a rule out, reads the bits and never the text.
Everything is DataFrame expressions; nothing is shuffled but the few rows of an ablation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"

#: Rule -> condition under which a text fails it, over the ledger's measurements. Bits follow this order.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 40 * n_words",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "shouting": "100 * n_upper > 60 * word_chars",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}

#: Version -> rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
}


def mask(policy: str) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r in POLICIES[policy])


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(words: Column, width: int = 5) -> Column:
    """How many words lie in windows of ``width`` words that the text holds twice or more."""
    windows = _let(
        words,
        lambda w: F.when(
            F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        ).otherwise(F.array().cast("array<bigint>")),
    )

    def places(s: Column) -> Column:
        twice = F.filter(
            s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])
        )
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(h: Column) -> Column:
        listed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(_let(listed, places), total)).otherwise(F.lit(0))

    return _let(windows, count)


def _judged(docs: DataFrame, text_col: str, carried: Column) -> DataFrame:
    """Measurements and failure bits of each row's text beside one carried column; no join, no shuffle."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    split = docs.select(carried, text.alias("_text"), F.array_remove(F.split(text, _SPACE), "").alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    long = lambda c: c.cast("long")
    measured = split.select(
        split.columns[0],
        long(F.size("_words")).alias("n_words"),
        long(F.length(F.array_join("_words", ""))).alias("word_chars"),
        long(F.regexp_count("_text", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        _let(lines, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("_lines"),
        long(_covered(F.col("_words"))).alias("n_repeat_words"),
        long(F.regexp_count("_text", F.lit(r"\p{Lu}"))).alias("n_upper"),
    )
    measured = measured.withColumns({"n_lines": F.col("_lines.n"), "n_dup_lines": F.col("_lines.d")}).drop("_lines")
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0))
    return measured.select("*", bits.cast("int").alias("failed"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_repeat_words, n_upper, n_lines, n_dup_lines, failed): measurements
    and failure bits, one row for each input row.

    Words are ``[^\\x20\\x09-\\x0D]+``, characters are code points. A null or empty text has no words and measures 0. Null
    ids, repeated rows and ties come back as they are; other columns are ignored; an empty table gives no rows.
    """
    return _judged(docs, text_col, F.col(id_col).cast("long").alias("doc_id"))


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, failed, sole, kept_without): texts that fail the rule, that fail it alone, and that a policy without it
    would keep. One row for each rule of the policy, also where the ledger is empty."""
    whole = mask(policy)
    hit = F.col("failed").bitwiseAND(F.lit(whole))
    bits = {r: 1 << i for i, r in enumerate(RULES) if r in POLICIES[policy]}
    sums = [F.count(F.when(hit == 0, 1)).alias("kept")]
    for r, b in bits.items():
        sums += [F.count(F.when(hit.bitwiseAND(F.lit(b)) != 0, 1)).alias(f"f_{r}"), F.count(F.when(hit == b, 1)).alias(f"s_{r}")]
    each = [F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("failed"), F.col(f"s_{r}").alias("sole"), (F.col("kept") + F.col(f"s_{r}")).alias("kept_without")) for r in bits]
    return rows.agg(*sums).select(F.inline(F.array(*each)))


def keep_good(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, whose text the policy keeps. Null and empty texts go, as they have
    too few words."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return _judged(docs, text_col, row).where(F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0).select("_row.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the ledger of all documents with the verdicts of the base and the current policy."""
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_upper", "n_lines", "failed")
