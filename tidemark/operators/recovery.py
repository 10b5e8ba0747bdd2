"""Recovery: candidates, intake, progress, verification, and the policy ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.operators.keyed import latest_per_key, since_progress, trailing_run

#: Attempts that each rung and each incident may use, and the last rung.
RUNG_BUDGETS = {1: 2, 2: 2, 3: 3, 4: 0, 5: 0}
INCIDENT_BUDGET = 7
LAST_RUNG = 5
#: Zero-progress attempts in a row that escalate.
ZERO_RUN = 2

FAILED_STATES = ("FAILED", "BLOCKED")


def candidates(jobs: DataFrame, verdicts: DataFrame, incidents: DataFrame, lingering: DataFrame, now: int) -> DataFrame:
    """``(job_id, fencing_token, failure_class, verdict)`` of every execution in need of recovery.

    Owned active jobs whose lease expired, or whose verdict is STALLED or DEAD; and the ownerless
    jobs of open incidents (job_id) for which a process lingers (job_id).
    """
    c = F.col
    last = verdicts.select("job_id", "fencing_token", "verdict")
    owned = jobs.where(P.is_active(c("status")) & c("owner_worker_id").isNotNull()).join(last, ["job_id", "fencing_token"], "left")
    failure = F.when(P.lease_expired(c("lease_expires_at"), now), "LEASE_EXPIRED").when(c("verdict").isin("STALLED", "DEAD"), c("verdict"))
    failed = owned.withColumn("failure_class", failure).where(c("failure_class").isNotNull())
    ownerless = (
        jobs.where(c("owner_worker_id").isNull() & ~c("status").isin(*P.TERMINAL_JOB))
        .join(incidents.select("job_id").distinct(), "job_id", "left_semi")
        .join(lingering.select("job_id").distinct(), "job_id", "left_semi")
    )
    return failed.select("job_id", "fencing_token", "failure_class", "verdict").unionByName(
        ownerless.select("job_id", "fencing_token", F.lit("STALE_AUTHORITY").alias("failure_class"), F.lit(None).cast("string").alias("verdict"))
    )


def attempt_facts(attempts: DataFrame) -> DataFrame:
    """One row for each incident: trailing failures, open and succeeded flags, counts, zero progress."""
    state = F.col("attempt_state")
    sums = attempts.groupBy("incident_id").agg(
        F.max(state.isin(*P.OPEN_ATTEMPT)).alias("has_open"),
        F.max(state == "SUCCEEDED").alias("has_success"),
        F.count(F.lit(1)).alias("attempts"),
        F.max("attempt_number").alias("last_number"),
    )
    run = trailing_run(attempts, "incident_id", "attempt_number", state.isin(*FAILED_STATES)).withColumnRenamed("run", "trailing_failures")
    zero = since_progress(attempts, "incident_id", "attempt_number", "progress_delta")
    return sums.join(run, "incident_id", "left").join(zero, "incident_id", "left").withColumn(
        "trailing_failures", F.coalesce("trailing_failures", F.lit(0).cast("long"))
    )


def intake(cands: DataFrame) -> DataFrame:
    """Adds ``decision`` to candidates with the facts of their incident; the first rule decides.

    Columns read: job_status, outcome, has_open, has_success, lingering, trailing_failures, owner.
    """
    c = F.col
    yes = lambda name: F.coalesce(c(name), F.lit(False))
    action = F.when(c("owner").isNotNull(), "reclaim").when(yes("lingering"), "fence")
    decision = (
        F.when(c("job_status").isin(*P.TERMINAL_JOB), "no_incident")
        .when(c("outcome").isNotNull(), "incident_closed")
        .when(yes("has_open"), "attempt_open")
        .when(yes("has_success") & ~yes("lingering"), "close_success")
        .when(F.coalesce(c("trailing_failures"), F.lit(0)) >= ZERO_RUN, "escalate")
        .when(action.isNull(), "no_action")
        .otherwise(F.concat(F.lit("create_"), action))
    )
    return cands.withColumn("decision", decision)


def progress_delta(action: Column, before: Column, after: Column, replacement: Column) -> Column:
    """1.0 if the action had its effect, else 0.0.

    ``before`` and ``after`` are structs (token, owner, status, progress_at, verified, good_checkpoint, process).
    """
    more = lambda f: F.coalesce(after[f] > before[f], after[f].isNotNull() & before[f].isNull())
    reclaimed = (after["token"] > before["token"]) & after["owner"].isNull() & after["status"].isin("PENDING", "UNCERTAIN")
    fenced = after["process"].isNull() | after["process"].isin("dead", "reuse")
    new_good = after["good_checkpoint"].isNotNull() & ~after["good_checkpoint"].eqNullSafe(before["good_checkpoint"])
    restarted = after["owner"].eqNullSafe(replacement) & (more("progress_at") | more("verified") | new_good)
    done = F.when(action == "reclaim", reclaimed).when(action == "fence", fenced).when(action == "restart", restarted)
    return F.when(F.coalesce(done, F.lit(False)), 1.0).otherwise(0.0)


def verify_decision(delta: Column, earlier_failures: Column) -> Column:
    return F.when(delta > 0, "success").when(earlier_failures + 1 >= ZERO_RUN, "escalate").otherwise("retry")


def effect_present(action: Column, before: Column, after: Column, replacement: Column) -> Column:
    """Whether an action's effect is there: true, false, or null if the state cannot be read."""
    return (
        F.when(after.isNull(), F.lit(None).cast("boolean"))
        .when(action == "reclaim", after["token"] > before["token"])
        .when(action == "fence", F.coalesce(after["process"].isin("dead", "reuse"), F.lit(True)) | (before["process"] != "live_match"))
        .when(action == "restart", after["owner"].eqNullSafe(replacement))
    )


def next_action(state: Column, claimed_at: Column, verify_after: Column, timeout: int, now: int) -> Column:
    """What the driver does with an open attempt."""
    return (
        F.when(state == "CREATED", F.when(claimed_at.isNotNull() & ~P.claim_is_stale(claimed_at, timeout, now), "wait").otherwise("dispatch"))
        .when(state == "RUNNING", F.when(P.claim_is_stale(claimed_at, timeout, now), "mark_uncertain").otherwise("wait"))
        .when(state == "VERIFYING", F.when(P.still_observing(verify_after, now), "wait").otherwise("verify"))
        .when(state == "UNCERTAIN", "reconcile")
    )


def rung_decision(
    rung: Column, attempts_at_rung: Column, attempts: Column, zero_progress: Column,
    available: Column, contradictory: Column, intake_blocked: Column, executable: Column,
    budgets: dict[int, int] | None = None, incident_budget: int = INCIDENT_BUDGET,
) -> Column:
    """struct(rung, terminal, advanced, reason): the first rule that applies; never goes back a rung."""
    caps = budgets or RUNG_BUDGETS
    cap = F.coalesce(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[rung], F.lit(0))
    up = F.least(rung + 1, F.lit(LAST_RUNG))

    def out(to: Column, terminal: Column | str | None, advanced: bool, reason: str) -> Column:
        end = terminal if isinstance(terminal, Column) else F.lit(terminal).cast("string")
        return F.struct(
            to.cast("int").alias("rung"), end.alias("terminal"), F.lit(advanced).alias("advanced"), F.lit(reason).alias("reason")
        )

    last = F.lit(LAST_RUNG)
    advance = lambda why: out(up, F.when(up == LAST_RUNG, "R5_TERMINAL"), True, why)
    return (
        F.when(~F.coalesce(rung.between(1, LAST_RUNG), F.lit(False)), F.raise_error(F.lit("rung out of range")))
        .when(rung == LAST_RUNG, out(last, "R5_TERMINAL", False, "last_rung"))
        .when(~available, out(last, "BLOCKED_STATE_UNAVAILABLE", True, "state_unavailable"))
        .when(contradictory, out(last, "BLOCKED_CONTRADICTORY", True, "contradictory"))
        .when(attempts >= incident_budget, out(last, "BUDGET_EXHAUSTED", True, "incident_budget"))
        .when(zero_progress >= ZERO_RUN, advance("zero_progress"))
        .when(attempts_at_rung >= cap, advance("rung_budget"))
        .when(rung == 4, advance("no_executor"))
        .when(intake_blocked & ~executable, advance("intake_blocked"))
        .otherwise(out(rung, None, False, "continue"))
    )


def attempts_per_rung(attempts: DataFrame) -> DataFrame:
    """``(incident_id, rung, n)``."""
    return attempts.groupBy("incident_id", "rung").agg(F.count(F.lit(1)).alias("n"))


def budget_use(attempts: DataFrame, policies: DataFrame) -> DataFrame:
    """What an incident's new attempts may still draw: attempts above the watermark, cut to what remains."""
    seen = policies.select("incident_id", "consumed_attempt_number", "remaining_budget")
    new = (
        attempts.join(seen, "incident_id")
        .where(F.col("attempt_number") > F.col("consumed_attempt_number"))
        .groupBy("incident_id")
        .agg(F.count(F.lit(1)).alias("new_attempts"), F.max("attempt_number").alias("watermark"))
    )
    n = F.coalesce("new_attempts", F.lit(0).cast("long"))
    payable = F.least(n, F.col("remaining_budget"))
    return seen.join(new, "incident_id", "left").select(
        "incident_id", n.alias("new_attempts"), payable.alias("payable"),
        (F.col("remaining_budget") - payable).alias("remaining_after"),
        F.coalesce("watermark", "consumed_attempt_number").alias("consumed_attempt_number"),
    )


def policy_outcome(
    known: Column, corrupt: Column, terminal: Column, outcome: Column, escalated_to: Column, job_status: Column,
    task_status: Column, unnumbered: Column,
) -> Column:
    """Why a policy is settled before any rung is chosen, or null; the first rule decides."""
    return (
        F.when(~known, "UNKNOWN_INCIDENT")
        .when(corrupt, "CORRUPT")
        .when(terminal.isNotNull(), terminal)
        .when(outcome.isin("success", "stopped"), "RECOVERY_COMPLETE")
        .when(outcome == "superseded", "SUPERSEDED")
        .when(escalated_to == "human", "R5_TERMINAL")
        .when(job_status.isNull(), "BLOCKED_STATE_UNAVAILABLE")
        .when(job_status.isin(*P.TERMINAL_JOB), "RECOVERY_COMPLETE")
        .when(task_status.isin(*P.HUMAN_GATED), "STOOD_DOWN")
        .when(unnumbered, "CORRUPT")
    )


def open_incidents(incidents: DataFrame, scope: str) -> DataFrame:
    return incidents.where(F.col("outcome").isNull() & (F.col("scope") == scope))


def escalated_incidents(incidents: DataFrame, to: str) -> DataFrame:
    return incidents.where(F.col("escalated_to") == to)


def open_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts that still own their incident."""
    return attempts.where(F.col("attempt_state").isin(*P.OPEN_ATTEMPT))


def escalated_with_policy(incidents: DataFrame, policies: DataFrame, to: str) -> DataFrame:
    """Escalated incidents with their policy's end, null if it has not ended or there is no policy."""
    return escalated_incidents(incidents, to).join(policies.select("incident_id", "terminal_state"), "incident_id", "left")


def settled_without_policy_end(incidents: DataFrame, policies: DataFrame) -> DataFrame:
    """Incidents with an outcome whose policy has not ended."""
    ended = policies.where(F.col("terminal_state").isNull()).select("incident_id")
    return incidents.where(F.col("outcome").isNotNull()).join(ended, "incident_id")


def first_per_signature(incidents: DataFrame) -> DataFrame:
    """One incident for each signature: the oldest, then the smallest id."""
    flipped = incidents.groupBy("signature").agg(F.min_by(F.struct(*[c for c in incidents.columns if c != "signature"]), F.struct("created_at", "incident_id")).alias("_r"))
    return flipped.select("signature", *[F.col("_r")[c].alias(c) for c in incidents.columns if c != "signature"])


def all_incidents(*lists: DataFrame) -> DataFrame:
    """The union of incident lists; the first list that has an incident gives its row."""
    out = None
    for i, df in enumerate(lists):
        part = df.withColumn("_list", F.lit(i))
        out = part if out is None else out.unionByName(part)
    negated = out.withColumn("_list", -F.col("_list"))
    return latest_per_key(negated, ["incident_id"], ["_list"]).drop("_list")
