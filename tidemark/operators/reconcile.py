"""Declared against actual state, and the admission of work."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.operators.breakers import with_denials
from tidemark.operators.keyed import digest

VERDICTS = (
    "OBSOLETE", "CONTRADICTORY", "DESIRED_MISSING", "DESIRED_ALREADY_PRESENT", "DESIRED_ACTIVE", "DESIRED_COMPLETE",
    "DESIRED_FAILED", "DESIRED_BLOCKED", "DESIRED_UNCERTAIN",
)


def diff(desired: DataFrame, mapping: DataFrame, jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """``(desired_work_id, job_id, verdict)`` for every declared item.

    ``desired (desired_work_id, canonical_job_id, task_id, spec_hash, retired)``; a null ``spec_hash``
    is a spec that cannot be read.  ``mapping (desired_work_id, job_id, spec_hash)``.
    """
    c = F.col
    m = mapping.select("desired_work_id", c("job_id").alias("_mapped"), c("spec_hash").alias("_mapped_hash"), F.lit(True).alias("_has_map"))
    j = jobs.select(c("job_id").alias("canonical_job_id"), c("status").alias("_status"), F.lit(True).alias("_has_job"))
    t = tasks.select("task_id", F.lit(True).alias("_has_task"))
    has = lambda name: F.coalesce(c(name), F.lit(False))
    status = c("_status")
    verdict = (
        F.when(c("retired"), "OBSOLETE")
        .when(~has("_has_task"), "CONTRADICTORY")
        .when(has("_has_map") != has("_has_job"), "CONTRADICTORY")
        .when(has("_has_map") & ~c("_mapped").eqNullSafe(c("canonical_job_id")), "CONTRADICTORY")
        .when(has("_has_map") & (c("spec_hash").isNull() | ~c("spec_hash").eqNullSafe(c("_mapped_hash"))), "CONTRADICTORY")
        .when(~has("_has_job"), "DESIRED_MISSING")
        .when(status == "PENDING", "DESIRED_ALREADY_PRESENT")
        .when(status.isin(*P.ACTIVE, "VERIFYING"), "DESIRED_ACTIVE")
        .when(status.isin("COMPLETE", "FAILED", "BLOCKED", "UNCERTAIN"), F.concat(F.lit("DESIRED_"), status))
        .otherwise("CONTRADICTORY")
    )
    return (
        desired.join(m, "desired_work_id", "left").join(j, "canonical_job_id", "left").join(t, "task_id", "left")
        .select("desired_work_id", c("canonical_job_id").alias("job_id"), verdict.alias("verdict"))
    )


def outcomes(diffs: DataFrame, paused_tasks: DataFrame | None = None) -> DataFrame:
    """Adds ``outcome``: what a pass does with each item.

    A missing item is created, blocked if its task is paused (column ``task_paused``), and failed
    if its spec cannot be read (column ``spec_readable``).
    """
    c = F.col
    columns = set(diffs.columns)
    paused = F.coalesce(c("task_paused"), F.lit(False)) if "task_paused" in columns else F.lit(False)
    readable = F.coalesce(c("spec_readable"), F.lit(True)) if "spec_readable" in columns else F.lit(True)
    outcome = (
        F.when(c("verdict") == "CONTRADICTORY", "conflict")
        .when(c("verdict") == "DESIRED_MISSING", F.when(~readable, "failed").when(paused, "blocked").otherwise("created"))
        .otherwise("skipped")
    )
    return diffs.withColumn("outcome", outcome)


def pass_result(items: DataFrame, order: str) -> DataFrame:
    """One row: counts of a pass and its result.

    A pass ends at its first failed item, so only items up to it count; that item is found
    by one aggregate instead of a running flag over an ordered table.
    """
    first = items.where(F.col("outcome") == "failed").agg(F.min(order).alias("_stop"))
    done = items.crossJoin(F.broadcast(first)).where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop")))  # one row
    n = lambda what: F.count_if(F.col("outcome") == what)
    counts = done.agg(
        F.count(F.lit(1)).alias("examined"), n("created").alias("created"), n("blocked").alias("blocked"),
        n("conflict").alias("conflicts"), n("failed").alias("failed"), n("skipped").alias("skipped"),
    )
    result = (
        F.when(F.col("failed") > 0, "FAILED").when(F.col("conflicts") > 0, "CONFLICT").when(F.col("blocked") > 0, "BLOCKED")
        .when(F.col("created") > 0, "CHANGED").otherwise("CONVERGED")
    )
    return counts.withColumn("result", result)


def to_create(diffs: DataFrame) -> DataFrame:
    """Items to make a job for: missing ones only, so a second pass adds nothing."""
    return diffs.where(F.col("verdict") == "DESIRED_MISSING")


def eligible(jobs: DataFrame, tasks: DataFrame, in_recovery: DataFrame) -> DataFrame:
    """Pending claimable jobs not in open recovery, of existing tasks that are not paused."""
    running = tasks.where(~F.col("status").isin(*P.HUMAN_GATED)).select("task_id")
    return (
        jobs.where(F.col("status") == "PENDING")
        .join(in_recovery.select("job_id").distinct(), "job_id", "left_anti")
        .join(running, "task_id", "left_semi")
    )


def admissions(waiting: DataFrame, breakers: DataFrame, scopes: DataFrame, active: int, most: int, batch: int, probes: int = 1) -> DataFrame:
    """The jobs that are admitted: not denied by a breaker, oldest first, while there is room.

    A job takes one probe of every half-open scope it has, or is not admitted if one of them has none left, so
    the decisions on such jobs depend on those before.  Jobs without a half-open scope don't touch
    probes: of them the oldest ``room`` are found by a top-k.  Only jobs that are older than the last of these can
    still matter; those of them with half-open scopes are folded in their order by one task, which holds
    the probes taken and nothing else.
    """
    room = max(0, min(batch, most - active))
    c = F.col
    half = (
        scopes.join(breakers, ["scope_type", "scope_id"])
        .where(P.breaker_class(c("state"), c("version"), c("half_open_probes_used")) == "half_open")
        .groupBy("job_id")
        .agg(F.array_sort(F.collect_set(F.struct(F.concat_ws(":", "scope_type", "scope_id").alias("scope"), c("half_open_probes_used").alias("used")))).alias("half"))
    )
    judged = with_denials(waiting, breakers, scopes, probes).where(c("denied_by").isNull())
    free = judged.where(c("probe_scope").isNull()).orderBy("created_at", "job_id").limit(room)
    # With fewer free jobs than room there is no last one, and every job matters.
    last = free.agg(F.when(F.count(F.lit(1)) >= room, F.max(F.struct("created_at", "job_id"))).alias("_last"))
    asked = judged.where(c("probe_scope").isNotNull()).crossJoin(F.broadcast(last))  # one row
    asked = asked.where(c("_last").isNull() | (F.struct("created_at", "job_id") < c("_last"))).drop("_last").join(half, "job_id")

    def fold(parts):
        left, taken = room, {}
        for part in parts:
            picked = []
            for job, held in zip(part["job_id"], part["half"], strict=True):
                if left and all(int(h["used"]) + taken.get(h["scope"], 0) < probes for h in held):
                    for h in held:
                        taken[h["scope"]] = taken.get(h["scope"], 0) + 1
                    picked.append(job)
                    left -= 1
            yield pd.DataFrame({"job_id": picked})
            if not left:
                return

    kind = dict(waiting.dtypes)["job_id"]
    ordered = asked.select("job_id", "created_at", "half").repartition(1).sortWithinPartitions("created_at", "job_id")
    probing = judged.join(ordered.select("job_id", "half").mapInPandas(fold, f"job_id {kind}"), "job_id", "left_semi")
    picked = free.unionByName(probing).orderBy("created_at", "job_id").limit(room)
    return picked.withColumn("rank", F.row_number().over(Window.orderBy("created_at", "job_id")))  # at most ``room`` rows


def orphans(claimed: DataFrame, spawned: DataFrame, beats: DataFrame, stale_after: int, now: int) -> DataFrame:
    """Claimed jobs without a process of their owner and without a live beat of it."""
    live = beats.where(P.beat_live(F.col("last_beat"), stale_after, now)).select(F.col("worker_id").alias("owner_worker_id"))
    mine = spawned.select(F.col("worker_id").alias("owner_worker_id"), "job_id").distinct()
    return claimed.join(mine, ["owner_worker_id", "job_id"], "left_anti").join(live.distinct(), "owner_worker_id", "left_anti")


def snapshot_hash(items: DataFrame) -> DataFrame:
    """One row: SHA-256 over the whole declared set, and its size."""
    text = F.concat_ws(":", F.col("desired_work_id").cast("string"), F.coalesce("spec_hash", F.lit("-")), F.col("retired").cast("int").cast("string"), F.col("version").cast("string"))
    return digest(items, [], F.col("desired_work_id"), text).select(F.col("digest").alias("snapshot_hash"), F.col("entries").alias("items"))


def listed(items: DataFrame, include_retired: bool) -> DataFrame:
    """Declared items, retired ones only if asked for."""
    return items if include_retired else items.where(~F.col("retired"))


def open_runs(runs: DataFrame) -> DataFrame:
    """Reconciliation runs that were never completed."""
    return runs.where(F.col("completed_at").isNull())


def desired_of(jobs: DataFrame, mapping: DataFrame) -> DataFrame:
    """The declared item of each job, null if none is mapped to it."""
    return jobs.select("job_id").join(mapping.select("job_id", "desired_work_id"), "job_id", "left")
