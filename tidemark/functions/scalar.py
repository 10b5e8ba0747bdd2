"""Scalar helpers over columns."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_field(payload: Column, name: str) -> Column:
    """A top-level field of a JSON text as a string; null where the text is no JSON."""
    return F.get_json_object(payload, f"$.{name}")


def readable_json(payload: Column) -> Column:
    return F.try_parse_json(payload).isNotNull()


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def tagged_id(prefix: str, tag: str, value: Column) -> Column:
    """A prefix and the first 32 hexadecimal digits of the SHA-256 of tag and value."""
    return F.concat(F.lit(prefix), F.substring(sha256_hex(F.concat(F.lit(tag), value.cast("string"))), 1, 32))


def generation_name(version: Column) -> Column:
    return F.concat(F.lit("ds-v"), version.cast("string"))


def lease_name(job: Column, token: Column) -> Column:
    return F.concat_ws("#", job.cast("string"), token.cast("string"))


def probe_parts(probe: Column) -> Column:
    """(worker_id, job_id) of ``worker:job``, or null if there is not exactly one of each."""
    ok = probe.rlike("^[^:]+:[^:]+$")
    return F.when(ok, F.struct(F.split_part(probe, F.lit(":"), F.lit(1)).alias("worker_id"), F.split_part(probe, F.lit(":"), F.lit(2)).alias("job_id")))


def staged_path(path: Column) -> Column:
    """(task_id, job_id, attempt, content_hash) of ``.../staging/task/job/attempt/hash``."""
    parts = F.split(path, "/")
    names = ("task_id", "job_id", "attempt", "content_hash")
    return F.struct(*[F.try_element_at(parts, F.lit(i - 4)).alias(n) for i, n in enumerate(names)])


def first_set(*values: Column) -> Column:
    """The first value that is neither null nor zero, else zero."""
    return F.coalesce(*[F.nullif(v, F.lit(0)) for v in values], F.lit(0))


def tumbling_bucket(ts: Column, window: int) -> Column:
    return F.floor(ts / window).cast("long")


def latest_of(*times: Column) -> Column:
    """The largest of the times that are set."""
    return F.greatest(*times) if len(times) > 1 else times[0]


def seeded_sample(df: DataFrame, id_col: str, rate: float, seed: str, least: int = 1) -> DataFrame:
    """A repeatable sample: the rows of the smallest hashes of (seed, id), ``max(least, n * rate)`` of them.

    The product is taken in decimals and its halves are rounded up, as in SQL; rows without an id come last.
    """
    n = df.count()
    k = min(n, max(least, int((n * Decimal(str(rate))).to_integral_value(ROUND_HALF_UP))))
    key = sha256_hex(F.concat(F.lit(seed), F.col(id_col).cast("string")))
    return df.withColumn("sample_key", key).orderBy(F.asc_nulls_last("sample_key"), F.asc_nulls_last(id_col)).limit(k)
