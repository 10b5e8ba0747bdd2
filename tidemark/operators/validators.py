"""Validators as columns, registered by id and version, and the receipts that they make."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Validator = Callable[[dict[str, Column]], Column]


class Registry:
    """Validators by (id, version).  A validator maps a row's columns to a true or false column."""

    def __init__(self):
        self._known: dict[tuple[str, str], Validator] = {}

    def add(self, ident: str, version: str, check: Validator) -> None:
        if (ident, version) in self._known:
            raise ValueError(f"validator {ident} {version} is registered already")
        self._known[ident, version] = check

    def run(self, rows: DataFrame, now: int, required: list[tuple[str, str]] | None = None) -> DataFrame:
        """One receipt for each row and validator; a check that gives null fails.

        All validators are evaluated in one pass over the rows.
        """
        wanted = required if required is not None else list(self._known)
        columns = {name: F.col(name) for name in rows.columns}
        checks = [
            F.struct(
                F.lit(i).alias("validator_id"), F.lit(v).alias("validator_version"),
                F.when(F.coalesce(self._known[i, v](columns), F.lit(False)), "PASS").otherwise("FAIL").alias("result"),
            )
            for i, v in wanted
        ]
        receipts = rows.withColumn("_r", F.explode(F.array(*checks)))
        return receipts.select("artifact_id", "_r.*", F.lit(False).alias("quarantined"), "content_hash", F.lit(now).cast("long").alias("validated_at"))


def all_required(receipts: DataFrame, required: list[tuple[str, str]]) -> DataFrame:
    """Artifacts that hold a PASS of every required validator for their content."""
    n = F.count_distinct(F.when(F.concat_ws("@", "validator_id", "validator_version").isin(*[f"{i}@{v}" for i, v in required]) & (F.col("result") == "PASS") & ~F.col("quarantined"), F.concat_ws("@", "validator_id", "validator_version")))
    return receipts.groupBy("artifact_id", "content_hash").agg(n.alias("_n")).where(F.col("_n") == len(set(required))).drop("_n")
