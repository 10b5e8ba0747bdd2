"""Quality rules as a bitmask ledger.

``rule_ledger`` evaluates every rule once for each document and stores the measurements beside
one ``fail_bits`` number, bit ``i`` for rule ``i``.  A policy is a mask of the bits that reject;
applying another version of it, or asking what each rule costs, reads the ledger's bits alone and
never the texts again.

Everything is made of built-in column functions over one row, so the ledger is a narrow
projection without any shuffle.

Defined results
---------------
* null text: no words, fails ``too_few_words``
* white space only: as null, but lines are still counted
* equal rows: judged alike; equal ids are not merged
* empty table: empty ledger; ablations of it are all zero
* other columns pass through ``rule_ledger``; one named like an output gives way to it
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CHARS, SPACE_CLASS, carried, let

#: Bit of each rule in ``fail_bits``.  Bits are never given to another rule.
RULES = {
    "too_few_words": 0,
    "repeated_windows": 1,
    "symbol_heavy": 2,
    "duplicate_lines": 3,
    "long_or_short_words": 4,
    "shouting": 5,
}

#: Thresholds of the rules, as ratios.
MIN_WORDS = 50
MAX_REPEATED = 0.5
MAX_SYMBOLS_PER_WORD = 0.2
MAX_DUPLICATE_LINES = 0.5
WORD_LENGTH = (2.0, 20.0)
MAX_UPPER = 0.5


def mask(*rules: str) -> int:
    return sum(1 << RULES[r] for r in rules)


#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": mask("too_few_words", "repeated_windows"),
    "2": mask(*RULES),
}
POLICY = "2"

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper",
]


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def _window_hashes(words: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur more than once, by sorting (hash, position) pairs."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def repeated(s: Column) -> Column:
        at = lambda k: F.get(s, k)["h"]
        twice = F.filter(s, lambda x, k: x["h"].eqNullSafe(at(k - 1)) | x["h"].eqNullSafe(at(k + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def total(starts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
        return F.aggregate(
            starts,
            zero,
            lambda acc, p: F.struct(
                (acc["n"] + p + 3 - F.greatest(p, acc["end"])).cast("long").alias("n"), (p + 3).alias("end")
            ),
            lambda acc: acc["n"],
        )

    return let(pairs, lambda s: total(repeated(s)))


def repeat_words(words: Column) -> Column:
    """Number of words that lie in a three-word window found twice or more; words is let-bound."""
    none = F.lit(0).cast("long")
    return F.when(F.size(words) < 4, none).otherwise(
        let(
            _window_hashes(words),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_covered(h)),
        )
    )


def rule_ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus the measurements and ``fail_bits``."""
    body = F.col("_body")
    squeezed = F.regexp_replace(body, SPACE_CLASS + "+", "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    measured = (
        docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_body"))
        .select(
            "_row",
            let(words_of(body), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))).alias("_w"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_l"),
            let(
                squeezed,
                lambda x: F.struct(
                    F.length(x).cast("long").alias("chars"),
                    F.length(F.regexp_replace(x, r"[^#*$%&|<>]+", "")).cast("long").alias("symbols"),
                    (F.length(x) - F.length(F.regexp_replace(x, "[A-Z]+", ""))).cast("long").alias("upper"),
                ),
            ).alias("_c"),
        )
        .select(
            *carried(docs, "_row", [text_col, *MEASURES, "fail_bits"]),
            F.col("_w.n").alias("n_words"),
            F.col("_c.chars").alias("word_chars"),
            F.col("_c.symbols").alias("n_symbols"),
            F.col("_l.n").alias("n_lines"),
            F.col("_l.dup").alias("n_dup_lines"),
            F.col("_w.r").alias("n_repeat_words"),
            F.col("_c.upper").alias("n_upper"),
        )
    )
    n, chars = F.col("n_words"), F.col("word_chars")
    failed = {
        "too_few_words": n < MIN_WORDS,
        "repeated_windows": 100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * n,
        "symbol_heavy": F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * n,
        "duplicate_lines": F.col("n_dup_lines") > MAX_DUPLICATE_LINES * F.col("n_lines"),
        "long_or_short_words": (chars < WORD_LENGTH[0] * n) | (chars > WORD_LENGTH[1] * n),
        "shouting": F.col("n_upper") > MAX_UPPER * chars,
    }
    bits = F.lit(0).cast("long")
    for rule, bit in RULES.items():
        bits = bits.bitwiseOR(F.when(failed[rule], F.lit(1 << bit)).otherwise(0).cast("long"))
    return measured.withColumn("fail_bits", bits)


def passes(policy: str | int = POLICY, bits: str | Column = "fail_bits") -> Column:
    """True where no rule of the policy (a version's name, or a mask) failed."""
    wanted = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col(bits).bitwiseAND(F.lit(wanted).cast("long")) == 0 if isinstance(bits, str) else bits.bitwiseAND(F.lit(wanted).cast("long")) == 0


def ablations(ledger: DataFrame, policy: str | int = POLICY) -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone, and kept without it.

    The ledger shrinks to one count for each bit pattern (at most 2 to the number of rules)
    before anything else happens.
    """
    wanted = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(wanted).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sums = []
    for rule, bit in RULES.items():
        if wanted >> bit & 1:
            one = F.lit(1 << bit).cast("long")
            rest = F.lit(wanted & ~(1 << bit)).cast("long")
            zero = F.lit(0).cast("long")
            sums.append(
                F.struct(
                    F.lit(rule).alias("rule"),
                    F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(one) != 0, F.col("n"))), zero).alias("n_failed"),
                    F.coalesce(F.sum(F.when(F.col("bits") == one, F.col("n"))), zero).alias("n_failed_alone"),
                    F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(rest) == 0, F.col("n"))), zero).alias("n_kept_without"),
                )
            )
    return patterns.agg(F.array(*sums).alias("rules")).select(F.inline("rules"))


def keep_good(docs: DataFrame, text_col: str = "text", policy: str | int = POLICY) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs``."""
    ledger = rule_ledger(docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_text")), "_text")
    return ledger.where(passes(policy)).select("_doc.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rule_ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"),
        passes().alias("kept"),
        "n_lines", "n_upper", "fail_bits",
    )


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM win
  QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT UNNEST([0, 1, 2]) AS k) GROUP BY doc_id
), m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
         len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_own_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper
  FROM t LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_lines - n_own_lines AS n_dup_lines,
         (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
          + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
          + CASE WHEN n_symbols > 0.2::DOUBLE * n_words THEN 4 ELSE 0 END
          + CASE WHEN n_lines - n_own_lines > 0.5::DOUBLE * n_lines THEN 8 ELSE 0 END
          + CASE WHEN word_chars < 2.0::DOUBLE * n_words OR word_chars > 20.0::DOUBLE * n_words THEN 16 ELSE 0 END
          + CASE WHEN n_upper > 0.5::DOUBLE * word_chars THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_upper, fail_bits
FROM b
"""
