"""Declared specs: validation, normal form, identity; upgrades of stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import TABLES

FIELDS = ("task_id", "stage_id", "max_attempts", "policy")
MAX_ATTEMPTS = 3


def spec_problem(text: Column) -> Column:
    """The first rule that a spec's JSON text breaks, or null.

    A spec is an object of the known fields only, with a non-empty task, a text or no stage, a
    positive whole number of attempts and an object as its policy.
    """
    spec = F.try_parse_json(text)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(spec, path, "variant"))
    given = lambda name: F.array_contains(F.json_object_keys(text), name)
    unknown = F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, FIELDS)))) > 0
    task = F.get_json_object(text, "$.task_id")
    attempts = F.get_json_object(text, "$.max_attempts")
    return (
        F.when(spec.isNull() | F.json_object_keys(text).isNull(), "not_an_object")
        .when(unknown, "unknown_field")
        .when(task.isNull() | (task == "") | ~F.coalesce(kind("$.task_id") == "STRING", F.lit(False)), "task_id")
        .when(given("stage_id") & ~kind("$.stage_id").isin("STRING", "VOID"), "stage_id")
        .when(given("max_attempts") & ~F.coalesce((kind("$.max_attempts") == "BIGINT") & (attempts.try_cast("long") >= 1), F.lit(False)), "max_attempts")
        .when(given("policy") & ~kind("$.policy").startswith("OBJECT"), "policy")
    )


def normal_spec(text: Column) -> Column:
    """The four fields of a spec with defaults, or null for a spec that breaks a rule."""
    fields = F.struct(
        F.get_json_object(text, "$.task_id").alias("task_id"),
        F.get_json_object(text, "$.stage_id").alias("stage_id"),
        F.coalesce(F.get_json_object(text, "$.max_attempts").try_cast("long"), F.lit(MAX_ATTEMPTS).cast("long")).alias("max_attempts"),
        F.coalesce(F.get_json_object(text, "$.policy"), F.lit("{}")).alias("policy"),
    )
    return F.when(spec_problem(text).isNull(), fields)


def spec_identity(text: Column) -> Column:
    """A digest of the normal form, so specs that differ in defaults or key order are one; null for a bad one."""
    n = normal_spec(text)
    parts = F.concat_ws("|", n["task_id"], F.coalesce(n["stage_id"], F.lit("-")), n["max_attempts"].cast("string"), n["policy"])
    return F.when(n.isNotNull(), F.sha2(parts, 256))


#: Upgrades of a table's rows from a version to the next: (version, table) to a function of the frame.
Upgrade = Callable[[DataFrame], DataFrame]


def migrate(df: DataFrame, table: str, version: int, upgrades: dict[tuple[int, str], Upgrade], to: int) -> DataFrame:
    """Rows of an older version brought to ``to`` step by step and checked against the table's columns."""
    for step in range(version, to):
        df = upgrades.get((step, table), lambda x: x)(df)
    wanted = TABLES[table]
    missing = [f.name for f in wanted if f.name not in df.columns and not f.nullable]
    if missing:
        raise ValueError(f"{table}: columns are missing after the upgrade: {missing}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
