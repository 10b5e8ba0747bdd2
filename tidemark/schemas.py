"""Logical tables.  All times are epoch microseconds (long); ids may be of any type."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

_KINDS = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "i": T.IntegerType()}


def _table(text: str) -> T.StructType:
    """``name:kind`` pairs; ``?`` marks a nullable column."""
    fields = []
    for item in text.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, _KINDS[kind[0]], kind.endswith("?")))
    return T.StructType(fields)


TABLES = {
    "jobs": _table(
        "job_id:s task_id:s stage_id:s? status:s owner_worker_id:s? fencing_token:l lease_acquired_at:l? lease_expires_at:l? "
        "progress_done:d progress_total:d? progress_updated_at:l? result_artifact_id:s? content_hash:s? created_at:l updated_at:l"
    ),
    "tasks": _table("task_id:s status:s pause_reason:s? created_at:l updated_at:l"),
    "workers": _table("worker_id:s status:s last_seen_at:l?"),
    "heartbeats": _table("seq:l worker_id:s proc_id:s job_id:s? fencing_token:l? hb_seq:l worker_state:s? ts:l"),
    "ledger": _table("seq:l event_type:s payload:s actor:s ts:l prev_hash:s hash:s"),
    "watchdog_verdicts": _table("verdict_id:s job_id:s fencing_token:l verdict:s evaluated_at:l"),
    "incidents": _table("incident_id:s scope:s failure_class:s signature:s outcome:s? escalated_to:s? created_at:l"),
    "recovery_attempts": _table(
        "attempt_id:s incident_id:s job_id:s fencing_token:l attempt_number:l attempt_state:s rung:i progress_delta:d "
        "decision:s started_at:l? claimed_at:l? verify_after:l?"
    ),
    "recovery_policy": _table(
        "incident_id:s version:l current_rung:i incident_budget:l remaining_budget:l attempt_count:l consumed_attempt_number:l "
        "result_consumed_attempt_number:l zero_progress_count:l terminal_state:s?"
    ),
    "artifacts": _table("artifact_id:s job_id:s? status:s size:l content_hash:s"),
    "artifact_stagings": _table("artifact_id:s job_id:s worker_id:s fencing_token:l staged_at:l"),
    "validations": _table(
        "validation_id:s artifact_id:s validator_id:s validator_version:s result:s quarantined:b content_hash:s validated_at:l"
    ),
    "checkpoints": _table("checkpoint_id:s task_id:s verification_status:s canonical_manifest:s created_at:l"),
    "checkpoint_pointers": _table("name:s checkpoint_id:s"),
    "desired_state": _table("desired_work_id:s spec:s retired:b version:l"),
    "desired_job_map": _table("desired_work_id:s job_id:s spec_hash:s"),
    "breaker_state": _table(
        "scope_type:s scope_id:s state:s version:l failure_count:l window_started_at:l? cooldown_until:l? half_open_probes_used:l"
    ),
    "breaker_signals": _table("signal_id:s scope_type:s scope_id:s failure_kind:s observed_at:l"),
}

#: Primary keys, and foreign keys as (table, column, parent, parent column).
KEYS = {
    "jobs": ["job_id"], "tasks": ["task_id"], "workers": ["worker_id"], "ledger": ["seq"], "heartbeats": ["seq"],
    "incidents": ["incident_id"], "recovery_attempts": ["attempt_id"], "recovery_policy": ["incident_id"],
    "artifacts": ["artifact_id"], "artifact_stagings": ["artifact_id", "job_id"], "validations": ["validation_id"],
    "checkpoints": ["checkpoint_id"], "checkpoint_pointers": ["name"], "desired_state": ["desired_work_id"],
    "desired_job_map": ["desired_work_id"], "breaker_state": ["scope_type", "scope_id"], "breaker_signals": ["signal_id"],
    "watchdog_verdicts": ["verdict_id"],
}
REFERENCES = [
    ("jobs", "task_id", "tasks", "task_id"),
    ("recovery_attempts", "incident_id", "incidents", "incident_id"),
    ("recovery_policy", "incident_id", "incidents", "incident_id"),
    ("artifact_stagings", "artifact_id", "artifacts", "artifact_id"),
    ("validations", "artifact_id", "artifacts", "artifact_id"),
]
