"""Boundary predicates.  ``now`` is always a parameter: epoch microseconds, or a column.

Every comparison is deliberate about its boundary and about nulls; none of them returns null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIVE = ("CLAIMED", "RUNNING", "COMMITTING")
TERMINAL_JOB = ("COMPLETE", "FAILED")
TERMINAL_WORKER = ("DEAD", "RETIRED")
OPEN_ATTEMPT = ("CREATED", "RUNNING", "VERIFYING", "UNCERTAIN")
CLOSED_ATTEMPT = ("SUCCEEDED", "FAILED", "BLOCKED")
#: How a recovery policy may have ended.
TERMINAL_POLICY = ("RECOVERY_COMPLETE", "BUDGET_EXHAUSTED", "R5_TERMINAL", "BLOCKED_CONTRADICTORY", "BLOCKED_STATE_UNAVAILABLE", "SUPERSEDED")
BREAKER_STATES = ("CLOSED", "OPEN", "HALF_OPEN")
SECOND = 1_000_000

WORK_CREATORS = ("human", "scheduler", "system", "test", "reconciler")
RECLAIMERS = ("recovery-controller", "reconciler", "system", "operator", "test")
HUMAN_GATED = ("PAUSED_FOR_HUMAN",)


def seconds(value: float, name: str = "duration") -> int:
    """A positive number of seconds as microseconds; rejects booleans, NaN and what is not above 0."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not value > 0:
        raise ValueError(f"{name} must be a positive number of seconds, got {value!r}")
    return round(value * SECOND)


def count_of(value: int, name: str = "count", least: int = 0) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}, got {value!r}")
    return value


def _sure(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def _at(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


def lease_expired(lease: Column, now) -> Column:
    """At or before now; a missing lease is not expired."""
    return _sure(lease <= _at(now))


def lease_live(lease: Column, now) -> Column:
    return _sure(lease > _at(now))


def may_renew(lease: Column, now) -> Column:
    return lease.isNull() | _sure(lease > _at(now))


def may_claim(status: Column, owner: Column, lease: Column, now) -> Column:
    return _sure(status == "PENDING") & (owner.isNull() | lease.isNull() | _sure(lease <= _at(now)))


def is_active(status: Column) -> Column:
    return _sure(status.isin(*ACTIVE))


def expired_execution(status: Column, owner: Column, lease: Column, now) -> Column:
    return owner.isNotNull() & lease_expired(lease, now) & is_active(status)


def is_stale(ts: Column, threshold: int, now) -> Column:
    """Strictly older than the threshold; a missing time is never stale."""
    return _sure(_at(now) - ts > threshold)


def beat_live(beat: Column, stale_after: int, now) -> Column:
    return _sure(_at(now) - beat <= stale_after)


def window_over(now, started: Column, window: int) -> Column:
    """A new window begins: there is none, or now is strictly beyond it."""
    return started.isNull() | _sure(_at(now) - started > window)


def cooldown_over(until: Column, now) -> Column:
    return _sure(until <= _at(now))


def claim_is_stale(claimed: Column, timeout: int, now) -> Column:
    """A claim without a time is stale."""
    return claimed.isNull() | _sure(_at(now) - claimed > timeout)


def still_observing(verify_after: Column, now) -> Column:
    return _sure(verify_after > _at(now))


def fence_failure(owner: Column, token: Column, lease: Column, worker, expected_token, now) -> Column:
    """The first reason that an execution may not write, or null: owner, then token, then lease."""
    mine = worker if isinstance(worker, Column) else F.lit(worker)
    known = expected_token if isinstance(expected_token, Column) else F.lit(expected_token)
    return (
        F.when(~owner.eqNullSafe(mine), "not_owner")
        .when(~token.eqNullSafe(known), "stale_token")
        .when(~lease_live(lease, now), "lease_expired")
    )


def breaker_class(state: Column, version: Column, probes: Column) -> Column:
    """closed, open, half_open, or corrupt for a row that cannot be read as a breaker."""
    return (
        F.when(~_sure(state.isin(*BREAKER_STATES)) | version.isNull() | probes.isNull(), "corrupt")
        .when(state == "OPEN", "open")
        .when(state == "HALF_OPEN", "half_open")
        .otherwise("closed")
    )


def policy_problems(row: dict[str, Column]) -> Column:
    """Names of the rules that a recovery policy row breaks, in order; an unreadable value breaks its rule."""
    bad = lambda ok, name: F.when(~_sure(ok), name)
    return F.array_compact(
        F.array(
            bad(row["current_rung"].between(1, 5), "current_rung"),
            bad(row["version"] >= 1, "version"),
            bad(row["incident_budget"] > 0, "incident_budget"),
            bad(row["remaining_budget"].between(0, row["incident_budget"]), "remaining_budget"),
            bad(row["attempt_count"] >= 0, "attempt_count"),
            bad(row["attempt_count"] + row["remaining_budget"] == row["incident_budget"], "budget_identity"),
            bad(row["consumed_attempt_number"] >= 0, "consumed_attempt_number"),
            bad(row["result_consumed_attempt_number"] >= 0, "result_consumed_attempt_number"),
            bad(row["zero_progress_count"] >= 0, "zero_progress_count"),
            bad(is_json_object(_text(row["per_rung_attempts"])), "per_rung_attempts"),
            bad(rung_map(_text(row["per_rung_budgets"])), "per_rung_budgets"),
            bad(row["policy_version"] != "", "policy_version"),
            bad(row["terminal_state"].isNull() | row["terminal_state"].isin(*TERMINAL_POLICY), "terminal_state"),
        )
    )


def _text(json: Column) -> Column:
    """A JSON column; missing and empty stand for an empty object."""
    return F.coalesce(F.nullif(json, F.lit("")), F.lit("{}"))


def is_json_object(json: Column) -> Column:
    return _sure(F.schema_of_variant(F.try_parse_json(json)).startswith("OBJECT<"))


def rung_map(json: Column) -> Column:
    """A JSON object from rungs 1 to 5 to whole numbers that are not negative."""
    entries = F.map_entries(F.try_parse_json(json).cast("map<string,variant>"))
    fine = lambda e: (
        e["key"].try_cast("int").between(1, 5) & (F.schema_of_variant(e["value"]) == "BIGINT") & (F.try_variant_get(e["value"], "$", "bigint") >= 0)
    )
    return is_json_object(json) & _sure(F.when(is_json_object(json), F.forall(entries, lambda e: _sure(fine(e)))))


def is_worker_actor(actor: Column) -> Column:
    return _sure(actor.startswith("worker:"))


def may_create_work(actor: Column) -> Column:
    return _sure(actor.isin(*WORK_CREATORS))


def may_reclaim(actor: Column) -> Column:
    return _sure(actor.isin(*RECLAIMERS))


def evidence_violation(decision: Column, delta: Column, effect_observed: Column) -> Column:
    """Success without positive progress or without an observed effect."""
    return _sure(decision == "success") & (~_sure(delta > 0) | ~_sure(effect_observed))
