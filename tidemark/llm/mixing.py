"""Mixing sources to target weights by Poisson replication.

Every source has a target weight; its repetition rate is the target number of documents divided by
the number it has.  A document is repeated a Poisson number of times with that mean: a uniform
number is derived from a hash of its id and the seed, and the Poisson distribution is inverted
at it.  The copies are exploded and shuffled globally by a hash of (id, copy, seed).

The counts depend on nothing but id, seed and rate, so a lost task or a second run repeats them.

Defined results
---------------
* null source: a source of its own
* null id: hashed as the word ``null``
* equal ids: hashed alike, so repeated equally often; each row makes its own copies
* a source without a weight when weights are given: weight 0, no copies
* null or empty text: mixed like any other
* empty table: empty result
* other columns pass through ``mix``; one named ``copy``, ``rate`` or ``shuffle_key`` gives way
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import carried, let, staged

SEED = 17
#: Rates above this are split into so many independent parts, whose sum is Poisson again.
MOST_RATE = 16.0
#: Terms of the distribution that an inversion looks at: above MOST_RATE + 12 deviations.
TERMS = 96
#: Sources up to this number are broadcast, at about 900 bytes each; more are met by a merge join, whose hot
#: partitions adaptive execution splits.
BROADCAST_SOURCES = 10_000
#: Hexadecimal digits of the hash that make the uniform number: 52 bits.
HEX_DIGITS = 13


def uniform(key: Column) -> Column:
    """A number from 0 to 1 (exclusive) from the MD5 of a string."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("double") / float(16**HEX_DIGITS)


def poisson_distribution(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... events; rate at most MOST_RATE."""
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.array_append(acc["out"], acc["sum"] + p).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, lambda acc: acc["out"])


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, total: float | None) -> DataFrame:
    """``(source, rate, parts, cdf)``: one row for each source.

    Without weights all sources weigh the same.  ``total`` is the wanted number of rows, by
    default that of ``docs``.
    """
    counts = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None)
        weight = F.coalesce(known[F.col("_source")].cast("double") if weights else F.lit(0.0), F.lit(0.0))
    sums = counts.select("_source", "n", weight.alias("weight"))
    whole = sums.agg(F.sum("weight").alias("weights"), F.sum("n").alias("rows"))
    wanted = F.lit(float(total)) if total is not None else F.col("rows").cast("double")
    rate = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights") * wanted / F.col("n")).otherwise(0.0)
    parts = F.greatest(F.ceil(F.col("rate") / MOST_RATE), F.lit(1)).cast("int")
    return (
        sums.join(F.broadcast(whole))  # one row
        .select("_source", rate.alias("rate"))
        .withColumn("parts", parts)
        .withColumn("cdf", poisson_distribution(F.col("rate") / F.col("parts")))
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    total: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` replicated to the weights, in globally shuffled order, plus ``copy``, ``rate``, ``shuffle_key``."""
    table = staged(rates(docs, source_col, weights, total), "rates")
    table = F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table.hint("merge")
    name = F.coalesce(F.col("_row")[id_col].cast("string"), F.lit("null"))

    def times(c: Column) -> Column:
        drawn = lambda i: uniform(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), name))
        below = lambda u: F.size(F.filter(c, lambda p: p <= u))
        return F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, i: acc + let(drawn(i), below))

    rows = docs.select(F.struct("*").alias("_row"), F.col(source_col).alias("_own"))
    made = (
        rows.join(table, F.col("_own").eqNullSafe(F.col("_source")))
        .withColumn("_n", times(F.col("cdf")))
        .where("_n > 0")
        .select("_row", "rate", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy"))
        .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"shuffle{seed}"), F.col("copy").cast("string"), name).cast("binary")))
    )
    return made.select(
        *carried(docs, "_row", ["copy", "rate", "shuffle_key"]), F.col("copy").cast("int").alias("copy"), "rate", "shuffle_key"
    ).repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key")


OP4_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM n) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n),
p AS (SELECT source, rate, greatest(ceil(rate / 16), 1)::INT AS parts FROM r),
cdf AS (
  SELECT source, k, sum(exp(-rate / parts + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate / parts) END - lgamma(k + 1)))
                     OVER (PARTITION BY source ORDER BY k) AS c
  FROM p, (SELECT UNNEST(range(0, 97)) AS k)
),
draws AS (
  SELECT doc_id, d.source, i,
         ('0x' || substr(md5('17:' || i || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT UNNEST(range(1, parts + 1)) AS i)
),
times AS (
  SELECT doc_id, sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM draws.source AND c <= u)) AS n
  FROM draws GROUP BY doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, g.copy::INT AS copy,
       md5('shuffle17:' || g.copy || ':' || coalesce(d.doc_id::VARCHAR, 'null')) AS shuffle_key
FROM documents d JOIN times t ON d.doc_id = t.doc_id, LATERAL (SELECT UNNEST(range(0, t.n::BIGINT)) AS copy) g
"""
