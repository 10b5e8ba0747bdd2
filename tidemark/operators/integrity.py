"""Log integrity and table constraints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canonical import GENESIS


def link(prev: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws(":", prev, body), 256)


def _chained(log: DataFrame, seq: str, body: str, starts: dict | None = None, segment: str | None = None) -> DataFrame:
    """Chains over rows that come in order, in one task each; a new ``segment`` begins a new chain."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev, now = (starts or {}).get("hash", GENESIS), None
        for part in parts:
            before, own = [], []
            labels = part[segment] if segment else [None] * len(part)
            for text, label in zip(part[body], labels, strict=True):
                if label != now:
                    prev, now = GENESIS, label
                before.append(prev)
                prev = hashlib.sha256(f"{prev}:{text}".encode()).hexdigest()
                own.append(prev)
            yield part.assign(prev_hash=before, hash=own)

    schema = ", ".join(f"{n} {t}" for n, t in log.dtypes) + ", prev_hash string, hash string"
    return log.mapInPandas(run, schema)


def build_chain(log: DataFrame, seq: str = "seq", body: str = "body", after: str = GENESIS) -> DataFrame:
    """Adds ``prev_hash`` and ``hash``, each over the one before: sequential by nature, so one task.

    It is meant for what one writer appends at a time, after the stored hash ``after``.  Large logs are chained
    by ``build_segments``, whose chains are independent.
    """
    return _chained(log.repartition(1).sortWithinPartitions(seq), seq, body, {"hash": after})


def build_segments(log: DataFrame, length: int, seq: str = "seq", body: str = "body") -> DataFrame:
    """``(segment, seq, body, prev_hash, hash)``: chains over ``length`` numbers each, built in parallel."""
    rows = log.select(F.floor(F.col(seq) / length).cast("long").alias("segment"), F.col(seq).alias("seq"), F.col(body).alias("body"))
    return _chained(rows.repartition("segment").sortWithinPartitions("segment", "seq"), "seq", "body", segment="segment")


def chain_failures(log: DataFrame, length: int | None = None) -> DataFrame:
    """Rows ``(seq, problem)`` whose link to the row before, or whose own hash, does not hold.

    ``length`` is that of the segments, if the log has any: each begins at the genesis.

    Each row is joined with its predecessor by number, in parallel.  The first row must follow
    the genesis; a gap shows as a wrong link.  A cut tail cannot be seen: see ``tip``.
    """
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    first = log.agg(F.min("seq").alias("_first"))
    joined = log.join(before, "seq", "left").crossJoin(F.broadcast(first))  # one row
    begins = F.col("seq") == F.col("_first")
    if length:
        begins = begins | (F.col("seq") % length == 0)
    expected = F.when(begins, F.lit(GENESIS)).otherwise(F.col("_before"))
    problem = F.when(~F.col("prev_hash").eqNullSafe(expected), "prev_hash_mismatch").when(
        ~F.col("hash").eqNullSafe(link(F.col("prev_hash"), F.col("body"))), "hash_mismatch"
    )
    return joined.select("seq", problem.alias("problem")).where(F.col("problem").isNotNull())


def first_failure(log: DataFrame) -> DataFrame:
    """The first failing row, or no row."""
    return chain_failures(log).orderBy("seq").limit(1)


def tip(log: DataFrame) -> DataFrame:
    """One row: last number and hash (to be anchored elsewhere), row count, and contiguity."""
    last = F.coalesce(F.max("seq"), F.lit(0).cast("long"))
    n = F.count(F.lit(1))
    found = [last.alias("tip_seq"), n.alias("rows"), (last == n).alias("contiguous")]
    if "hash" in log.columns:
        found.append(F.max_by("hash", "seq").alias("tip_hash"))
    return log.agg(*found)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` that refer to no row of ``parent``; nulls refer to nothing and are fine."""
    known = parent.select(F.col(key).alias("_key")).distinct()
    return child.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_key"), "left_anti")


def orphan_files(files: DataFrame, table: DataFrame) -> DataFrame:
    """Staged files ``(path, task_id, job_id, attempt, content_hash)`` that no artifact row names."""
    return files.join(table.select(F.col("artifact_id").alias("content_hash")).distinct(), "content_hash", "left_anti")
