"""The registered queries: one for each operator, over the views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions import scalar as S
from tidemark.operators import artifacts as A
from tidemark.operators import breakers as B
from tidemark.operators import declared as D
from tidemark.operators import execution as E
from tidemark.operators import graph as G
from tidemark.operators import integrity as I
from tidemark.operators import keyed as K
from tidemark.operators import recovery as R
from tidemark.operators import reconcile as C
from tidemark.operators.validators import Registry, all_required
from tidemark.operators.workload import BEHAVIOURS, behaviour_log
from tidemark.plans import views as V
from tidemark.plans.views import DAY, NOW_EVENTS, NOW_ORDERS

HOUR = 3_600_000_000
c = F.col


def expired_leases(spark: SparkSession, d: str) -> DataFrame:
    return E.expired_leases(V.jobs(spark, d), NOW_ORDERS)


def owned_active_jobs(spark, d):
    return E.owned_active(V.jobs(spark, d)).select("job_id", "status", "owner_worker_id", "fencing_token")


def jobs_in_states(spark, d):
    return E.jobs_in(V.jobs(spark, d), ["FAILED", "UNCERTAIN"]).select("job_id", "status")


def pending_topk(spark, d):
    return E.pending(V.jobs(spark, d), 100).select("job_id", "created_at")


def claimed_by_scheduler(spark, d):
    named = V.jobs(spark, d).withColumn("owner_worker_id", F.concat(F.when(c("owner_worker_id") % 2 == 0, "sched-").otherwise("w-"), c("owner_worker_id").cast("string")))
    return E.claimed_by_prefix(named, "sched-", NOW_ORDERS).select("job_id", "owner_worker_id", "lease_expires_at")


def active_capacity(spark, d):
    return E.capacity(V.jobs(spark, d), 5000)


def lease_rules(spark, d):
    lease, owner, status = c("lease_expires_at"), c("owner_worker_id"), c("status")
    return V.jobs(spark, d).select(
        "job_id", P.lease_expired(lease, NOW_ORDERS).alias("expired"), P.lease_live(lease, NOW_ORDERS).alias("live"),
        P.may_renew(lease, NOW_ORDERS).alias("may_renew"), P.may_claim(status, owner, lease, NOW_ORDERS).alias("may_claim"),
        P.fence_failure(owner, c("fencing_token"), lease, c("task_id") % 75, F.lit(2), NOW_ORDERS).alias("fence_failure"),
    )


def _steps(spark, d):
    names = {"signup": "PROVISIONING", "view": "ASSIGNED", "click": "RUNNING", "purchase": "IDLE", "error": "SUSPECT"}
    rows = V.table(spark, d, "events", "event_id", "user_id", "event_type").select("event_id", "user_id", V.mapped("event_type", names).alias("dst"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    return rows.withColumn("src", F.lag("dst").over(w)).where("src IS NOT NULL")


def illegal_transitions(spark, d):
    return G.illegal_transitions(_steps(spark, d), "worker").select("event_id", "user_id", "src", "dst")


def gate_violations(spark, d):
    steps = V.tasks(spark, d).select("task_id", c("status").alias("src"), F.lit("EXECUTING").alias("dst"))
    approvals = V.table(spark, d, "orders", "o_custkey", "o_orderstatus").select(c("o_custkey").alias("task_id"), F.when(c("o_orderstatus") == "P", "APPROVED").otherwise("DENIED").alias("status"))
    return G.gate_violations(steps, approvals).select("task_id", "src", "dst")


def state_closure(spark, d):
    return G.closure(spark)


def _processes(spark, d):
    return V.ledger(spark, d, "worker.proc_spawned"), V.ledger(spark, d, "worker.proc_reaped")


def unreaped_spawns(spark, d):
    return E.unreaped_spawns(*_processes(spark, d)).select("seq", "worker_id", "proc_id", "ts")


def latest_spawn_generation(spark, d):
    return E.latest_generation(*_processes(spark, d))


def latest_heartbeat(spark, d):
    return K.latest_per_key(V.ledger(spark, d, "heartbeat").select("worker_id", "seq", "ts", "proc_id"), ["worker_id"], ["ts", "seq"])


def newest_heartbeats(spark, d):
    return K.newest(V.ledger(spark, d, "heartbeat").select("worker_id", "seq", "ts"), ["worker_id"], ["ts", "seq"], 3)


def accepted_heartbeats(spark, d):
    beats = V.ledger(spark, d, "heartbeat").select("seq", "worker_id", c("proc_id").alias("hb_seq"))
    return K.increasing_only(beats, ["worker_id"], "hb_seq", ["seq"])


def _deaths(spark, d):
    spawns, reaps = _processes(spark, d)
    alive = V.observed(E.unreaped_spawns(spawns, reaps))
    return E.death_evidence(V.workers(spark), alive, E.latest_generation(spawns, reaps))


def death_evidence(spark, d):
    return _deaths(spark, d)


def _prior(spark, d):
    """A past verdict of every seventh job: DEAD for its first token."""
    jobs = V.table(spark, d, "orders", "o_orderkey").where(c("o_orderkey") % 7 == 0)
    return jobs.select(
        c("o_orderkey").alias("verdict_id"), c("o_orderkey").alias("job_id"), (c("o_orderkey") % 3 + 1 - c("o_orderkey") % 2).alias("fencing_token"),
        F.when(c("o_orderkey") % 3 == 0, "DEAD").otherwise("HEALTHY").alias("verdict"), c("o_orderkey").alias("evaluated_at"),
    )


def _verdicts(spark, d):
    beats = V.ledger(spark, d, "heartbeat").select("worker_id", "ts")
    return E.watchdog_verdicts(V.jobs(spark, d, progress=True), _deaths(spark, d), beats, _prior(spark, d), NOW_ORDERS, 30 * DAY)


def watchdog_verdict(spark, d):
    return _verdicts(spark, d)


def verdict_changes(spark, d):
    log = V.table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    verdict = F.when((c("event_type") == "purchase") & (c("value") > 40), "DEAD").when(c("event_type") == "error", "STALLED").otherwise("HEALTHY")
    rows = log.select("event_id", "user_id", verdict.alias("verdict"))
    return K.changes(rows, ["user_id"], ["event_id"], "verdict", "DEAD")


def _authority(spark, d):
    """Claims and, every fifth of them, reclaims from the worker of the same number modulo 5."""
    log = V.ledger(spark, d, "job.claimed")
    reclaim = c("seq") % 5 == 0
    return log.select(
        "seq", "ts", "job_id", F.when(reclaim, "job.lease_reclaimed").otherwise("job.claimed").alias("event_type"),
        F.when(~reclaim, c("worker_id")).alias("worker_id"), F.when(reclaim, c("worker_id") % 5).alias("prev_owner"),
    )


def _revoked(spark, d):
    spawns, reaps = _processes(spark, d)
    return E.revocations(E.unreaped_spawns(spawns, reaps), _authority(spark, d))


def revocation_after_spawn(spark, d):
    return _revoked(spark, d).select("spawn_seq", "worker_id", "job_id", "revoked_seq", "revoked_by")


def fence_timing(spark, d):
    deaths = V.ledger(spark, d, "failure").groupBy("worker_id").agg(F.max("ts").alias("death_ts"))
    revoked = _revoked(spark, d)
    found = revoked.select("spawn_seq", "worker_id").join(deaths, "worker_id").select("spawn_seq", "death_ts")
    return E.fence_timing(revoked, found, 10 * DAY)


def boot_dispositions(spark, d):
    spawns, reaps = _processes(spark, d)
    alive = V.observed(E.unreaped_spawns(spawns, reaps))
    return E.boot_dispositions(alive, V.workers(spark), V.jobs(spark, d), _revoked(spark, d), NOW_ORDERS)


def disposition_histogram(spark, d):
    return E.histogram(boot_dispositions(spark, d), "disposition")


def reclaim_outcomes(spark, d):
    k = c("o_orderkey")
    requests = V.table(spark, d, "orders", "o_orderkey").where(k % 2 == 0).select(
        k.alias("job_id"), F.when(k % 10 == 0, "worker:1").otherwise("reconciler").alias("actor"), (k % 4 == 0).alias("forced"),
        F.when(k % 8 == 0, "DEAD").alias("verdict"), F.when(k % 8 == 0, k).alias("incident_id"),
    )
    return E.reclaim(V.jobs(spark, d), requests, NOW_ORDERS)


def lease_state(spark, d):
    kinds = {"view": "job.claimed", "click": "lease.renewed", "purchase": "lease.released", "error": "job.lease_reclaimed"}
    log = V.table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "props").select(
        (c("event_id") + 1).alias("seq"), V.mapped("event_type", kinds).alias("event_type"), F.get_json_object("props", "$.k").cast("long").alias("job_id"),
        c("user_id").alias("worker_id"), (V.micros("ts") + HOUR).alias("lease_expires_at"),
    )
    return E.lease_state(log)


def trailing_failures(spark, d):
    return K.trailing_run(V.attempts(spark, d), "incident_id", "attempt_number", c("attempt_state").isin("FAILED", "BLOCKED"))


def zero_progress_run(spark, d):
    return K.since_progress(V.attempts(spark, d), "incident_id", "attempt_number", "progress_delta")


def attempts_per_rung(spark, d):
    return R.attempts_per_rung(V.attempts(spark, d))


def rung_selection(spark, d):
    facts = R.attempt_facts(V.attempts(spark, d))
    k = c("incident_id")
    decided = facts.withColumn("rung", (k % 5 + 1).cast("int")).withColumn(
        "r",
        R.rung_decision(c("rung"), k % 4, c("attempts"), c("zero_progress"), k % 50 != 0, k % 41 == 0, c("trailing_failures") >= 2, k % 3 == 0, incident_budget=12),
    )
    return decided.select("incident_id", c("rung").alias("from_rung"), c("r.rung").alias("rung"), "r.terminal", "r.advanced", "r.reason")


def budget_consumption(spark, d):
    return R.budget_use(V.attempts(spark, d), V.policies(spark, d))


def recovery_candidates(spark, d):
    jobs = V.jobs(spark, d)
    lingering = V.table(spark, d, "orders", "o_orderkey").where(c("o_orderkey") % 3 == 0).select(c("o_orderkey").alias("job_id"))
    verdicts = _verdicts(spark, d).select("job_id", "fencing_token", "verdict")
    return R.candidates(jobs, verdicts, R.open_incidents(V.incidents(spark, d), "recovery"), lingering, NOW_ORDERS)


def intake_decision(spark, d):
    facts = R.attempt_facts(V.attempts(spark, d)).withColumnRenamed("incident_id", "job_id")
    jobs = V.jobs(spark, d).select("job_id", c("status").alias("job_status"), c("owner_worker_id").alias("owner"))
    cands = (
        V.incidents(spark, d).select("job_id", "outcome").join(jobs, "job_id").join(facts, "job_id", "left").withColumn("lingering", c("job_id") % 3 == 0)
    )
    return R.intake(cands).select("job_id", "decision")


def progress_and_verify(spark, d):
    jobs = V.jobs(spark, d, progress=True)
    k = c("job_id")
    before = F.struct(
        c("fencing_token").alias("token"), c("owner_worker_id").alias("owner"), c("status"), c("created_at").alias("progress_at"),
        F.lit(0).alias("verified"), F.lit(None).cast("long").alias("good_checkpoint"), F.lit("live_match").alias("process"),
    )
    after = F.struct(
        (c("fencing_token") + k % 2).alias("token"), F.when(k % 3 != 0, c("owner_worker_id")).alias("owner"), F.when(k % 2 == 0, "PENDING").otherwise(c("status")).alias("status"),
        c("progress_updated_at").alias("progress_at"), (k % 2).cast("int").alias("verified"), F.when(k % 11 == 0, k).alias("good_checkpoint"),
        F.when(k % 4 == 0, "dead").when(k % 4 == 1, "live_match").alias("process"),
    )
    action = F.when(k % 3 == 0, "reclaim").when(k % 3 == 1, "fence").otherwise("restart")
    delta = R.progress_delta(action, before, after, c("task_id") % V.OWNERS)
    return jobs.select(
        "job_id", action.alias("action"), delta.cast("int").alias("delta"), R.verify_decision(delta, k % 2).alias("decision"),
        R.effect_present(action, before, after, c("task_id") % V.OWNERS).alias("effect"),
    )


def next_actions(spark, d):
    k = c("o_orderkey")
    state = F.when(k % 5 == 0, "CREATED").when(k % 5 == 1, "RUNNING").when(k % 5 == 2, "VERIFYING").when(k % 5 == 3, "UNCERTAIN").otherwise("SUCCEEDED")
    rows = V.table(spark, d, "orders", "o_orderkey", "o_orderdate").select(k.alias("attempt_id"), state.alias("state"), F.when(k % 3 != 0, V.micros("o_orderdate")).alias("claimed_at"), (V.micros("o_orderdate") + DAY).alias("verify_after"))
    return rows.select("attempt_id", "state", R.next_action(c("state"), c("claimed_at"), c("verify_after"), 30 * DAY, NOW_ORDERS).alias("action"))


def policy_row_validity(spark, d):
    rows = V.policies(spark, d)
    problems = P.policy_problems({name: c(name) for name in rows.columns})
    return rows.select("incident_id", F.array_join(problems, ",").alias("problems"))


def policy_outcomes(spark, d):
    policies = V.policies(spark, d)
    corrupt = F.size(P.policy_problems({name: c(name) for name in policies.columns})) > 0
    rows = (
        V.incidents(spark, d).join(policies.withColumn("corrupt", corrupt).select("incident_id", "terminal_state", "corrupt"), "incident_id")
        .join(V.jobs(spark, d).select("job_id", "task_id", c("status").alias("job_status")), "job_id")
        .join(V.tasks(spark, d).select("task_id", c("status").alias("task_status")), "task_id", "left")
    )
    found = R.policy_outcome(F.lit(True), c("corrupt"), c("terminal_state"), c("outcome"), c("escalated_to"), c("job_status"), c("task_status"), F.lit(False))
    return rows.select("incident_id", found.alias("settled"))


def incidents_with_open_policy(spark, d):
    return R.settled_without_policy_end(V.incidents(spark, d), V.policies(spark, d)).select("incident_id", "outcome")


def incident_lists(spark, d):
    every = V.incidents(spark, d)
    return R.all_incidents(R.open_incidents(every, "recovery"), R.escalated_incidents(every, "human")).select("incident_id", "scope", "escalated_to")


def incident_per_signature(spark, d):
    return R.first_per_signature(V.incidents(spark, d)).select("signature", "incident_id")


def evidence_violations(spark, d):
    rows = V.attempts(spark, d).withColumn("decision", F.when(c("attempt_number") % 3 == 0, "success").otherwise("retry"))
    return rows.where(P.evidence_violation(c("decision"), c("progress_delta"), c("rung") % 2 == 0)).select("incident_id", "attempt_number")


def _diff(spark, d):
    return C.diff(V.desired(spark, d), V.mapping(spark, d), V.actual(spark, d), V.tasks(spark, d))


def reconcile_diff(spark, d):
    return _diff(spark, d)


def reconcile_summary(spark, d):
    readable = c("desired_work_id") != 14_000
    return C.pass_result(C.outcomes(_diff(spark, d).withColumn("spec_readable", readable).withColumn("task_paused", c("desired_work_id") % 2 == 0)), "desired_work_id")


def desired_job_ids(spark, d):
    missing = C.to_create(_diff(spark, d))
    return missing.select("desired_work_id", S.tagged_id("dj-", "desired:", c("desired_work_id")).alias("new_job_id"))


def desired_snapshot(spark, d):
    return C.snapshot_hash(V.desired(spark, d))


def _in_recovery(spark, d):
    return R.open_incidents(V.incidents(spark, d), "recovery").select("job_id")


def scheduler_eligible(spark, d):
    return C.eligible(V.jobs(spark, d), V.tasks(spark, d), _in_recovery(spark, d)).select("job_id", "task_id")


def scheduler_admission(spark, d):
    waiting = C.eligible(V.jobs(spark, d), V.tasks(spark, d), _in_recovery(spark, d))
    scopes = waiting.select("job_id", F.lit("TASK").alias("scope_type"), c("task_id").cast("string").alias("scope_id"))
    return C.admissions(waiting, V.breakers(spark, d), scopes, 4000, 4400, 300).select("rank", "job_id", "task_id", "probe_scope")


def admission_probes(spark, d):
    """Jobs of several half-open scopes: their task's, and one that they share with other items; two probes a scope."""
    waiting = C.eligible(V.jobs(spark, d), V.tasks(spark, d), _in_recovery(spark, d))
    shared = (c("job_id") % 40).cast("string")
    scopes = waiting.select("job_id", F.explode(F.array(
        F.struct(F.lit("TASK").alias("scope_type"), c("task_id").cast("string").alias("scope_id")), F.struct(F.lit("DESIRED").alias("scope_type"), shared.alias("scope_id")),
    )).alias("s")).select("job_id", "s.*")
    n = c("id")
    more = spark.range(40).where(n % 3 != 0).select(
        F.lit("DESIRED").alias("scope_type"), n.cast("string").alias("scope_id"), F.when(n % 3 == 1, "HALF_OPEN").otherwise("CLOSED").alias("state"),
        F.lit(1).cast("long").alias("version"), F.lit(0).cast("long").alias("half_open_probes_used"),
    )
    breakers = V.breakers(spark, d).select("scope_type", "scope_id", "state", "version", "half_open_probes_used").unionByName(more)
    return C.admissions(waiting, breakers, scopes, 4000, 4400, 300, probes=2).select("rank", "job_id")


def open_attempts(spark, d):
    return R.open_attempts(V.open_attempts(spark, d)).select("attempt_id", "incident_id", "attempt_state")


def desired_items(spark, d):
    return C.listed(V.desired(spark, d), False).select("desired_work_id", "task_id")


def desired_items_all(spark, d):
    return C.listed(V.desired(spark, d), True).groupBy("retired").agg(F.count(F.lit(1)).alias("n"))


def open_runs(spark, d):
    runs = V.table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").select(
        c("o_orderkey").alias("run_id"), V.micros("o_orderdate").alias("started_at"), F.when(c("o_orderstatus") == "F", V.micros("o_orderdate") + DAY).alias("completed_at")
    )
    return C.open_runs(runs).select("run_id", "started_at")


def escalated_policies(spark, d):
    return R.escalated_with_policy(V.incidents(spark, d), V.policies(spark, d), "human").select("incident_id", "terminal_state")


def job_desired_items(spark, d):
    return C.desired_of(V.jobs(spark, d).where("status = 'PENDING'"), V.mapping(spark, d))


def _ranked(rows, order):
    """The first rows in their order, which is told by a number: at most 50 rows."""
    return rows.limit(50).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def claims_by_expiry(spark, d):
    rows = E.claimed_by_prefix(V.jobs(spark, d).withColumn("owner_worker_id", F.concat(F.lit("sched-"), c("owner_worker_id").cast("string"))), "sched-", NOW_ORDERS)
    return _ranked(rows, ["lease_expires_at", "job_id"]).select("rank", "job_id", "lease_expires_at")


def breakers_in_order(spark, d):
    return _ranked(B.listed(V.release_breakers(spark, d)), ["scope_type", "scope_id"]).select("rank", "scope_type", "scope_id", "state")


def actor_rules(spark, d):
    names = ["human", "scheduler", "worker:7", "reconciler", "worker", "recovery-controller", None]
    return V.table(spark, d, "orders", "o_orderkey").select("o_orderkey", V.pick(c("o_orderkey"), names).alias("actor")).select(
        "o_orderkey", P.is_worker_actor(c("actor")).alias("is_worker"), P.may_create_work(c("actor")).alias("may_create"), P.may_reclaim(c("actor")).alias("may_reclaim"),
    )


def heartbeat_ingest(spark, d):
    k = c("seq")
    beats = V.ledger(spark, d, "heartbeat").select(
        "seq", (c("worker_id") % 20).alias("worker_id"), (c("proc_id") % 3).alias("proc_id"), F.when(k % 6 != 0, c("job_id")).alias("job_id"),
        F.when(k % 11 != 0, c("job_id") % 3 + 1).alias("fencing_token"), (c("proc_id") + k % 50).alias("hb_seq"),
    )
    jobs = V.jobs(spark, d).select("job_id", "fencing_token", F.when(c("job_id") % 2 == 0, c("job_id") % 20).otherwise(0).alias("owner_worker_id"))
    return K.ingested(beats.withColumn("worker_id", F.when(c("job_id") % 4 == 0, c("job_id") % 20).otherwise(c("worker_id"))), jobs)


def claim_beats(spark, d):
    kind = F.when(c("seq") % 9 == 0, "withdraw").when(c("seq") % 31 == 0, "clear").otherwise("beat")
    return E.live_claims(V.ledger(spark, d, "heartbeat").select("worker_id", "seq", "ts", kind.alias("kind")), DAY, NOW_EVENTS)


def behaviour_events(spark, d):
    k = c("o_orderkey")
    specs = V.table(spark, d, "orders", "o_orderkey").select(k.alias("job_id"), V.pick(k, list(BEHAVIOURS)).alias("kind"), (k % 4 + 1).cast("int").alias("steps"))
    return behaviour_log(spark, specs).groupBy("kind", "event").agg(F.count(F.lit(1)).alias("n"), F.max("n").cast("int").alias("last"))


def orphan_dispatch(spark, d):
    claimed = E.jobs_in(V.jobs(spark, d), ["CLAIMED"])
    spawned = V.ledger(spark, d, "worker.proc_spawned").select("worker_id", "job_id")
    beats = V.ledger(spark, d, "heartbeat").groupBy("worker_id").agg(F.max("ts").alias("last_beat"))
    return C.orphans(claimed, spawned, beats, HOUR * 6, NOW_EVENTS).select("job_id", "owner_worker_id")


def _failures(spark, d):
    rows = V.ledger(spark, d, "failure")
    kind = F.when(c("seq") % 3 == 0, "R7_DEAD").when(c("seq") % 3 == 1, "R8_ATTEMPT_FAILED").otherwise("R9_ESCALATED")
    return rows.select(
        kind.alias("failure_kind"), c("worker_id").alias("incident_id"), F.when(c("seq") % 3 == 1, c("proc_id")).alias("attempt_id"), c("worker_id").alias("job_id"),
        F.when(c("worker_id") % 4 != 0, c("worker_id") % 10).alias("task_id"), c("ts").alias("observed_at"), (c("seq") % 3 != 2).alias("windowed"),
    )


def breaker_signals(spark, d):
    return B.signals(_failures(spark, d), NOW_EVENTS, 20 * DAY)


def breaker_touched(spark, d):
    return B.touched(B.signals(_failures(spark, d), NOW_EVENTS, 20 * DAY))


def anchored_window_count(spark, d):
    return B.windows(B.signals(_failures(spark, d), NOW_EVENTS, 60 * DAY).where("scope_type = 'JOB'"), 12 * HOUR)


def breaker_trips(spark, d):
    rows = B.windows(B.signals(_failures(spark, d), NOW_EVENTS, 60 * DAY), 10 * DAY)
    return B.trips(rows, NOW_EVENTS, 10 * DAY).select("scope_type", "scope_id", "failure_count")


def recovery_pressure(spark, d):
    rows = V.attempts(spark, d)
    one = rows.where(c("attempt_state") == "BLOCKED")
    two = rows.where(c("attempt_state") == "FAILED")
    three = V.incidents(spark, d).where("escalated_to IS NOT NULL").select(c("created_at").alias("ts"))
    return B.pressure(one, two, three, NOW_ORDERS, 30 * DAY)


def breaker_pass(spark, d):
    k = c("scope_id").cast("long")
    status = F.when(k % 4 == 0, "COMPLETE").when(k % 4 != 1, "RUNNING")
    probe = B.probe_outcome(status, k % 6, F.when(k % 5 != 0, F.lit(3)), k % 3 == 0)
    rows = V.breakers(spark, d)
    return rows.select(
        "scope_id", "state", probe.alias("probe"), P.breaker_class(c("state"), c("version"), c("half_open_probes_used")).alias("class"),
        B.next_state(c("state"), c("tripped"), c("cooldown_until"), probe, NOW_ORDERS).alias("next_state"),
    )


def artifact_dedupe(spark, d):
    return A.artifacts(V.staged_documents(spark, d))


def artifact_stagings(spark, d):
    return A.stagings(V.staged_documents(spark, d))


def receipts_latest_pass(spark, d):
    return A.receipts(V.validations(spark, d)).select("artifact_id", "validator_version", "validation_id", "validated_at")


def quarantine_effect(spark, d):
    bad = spark.createDataFrame([("structural", 1)], "validator_id string, validator_version long")
    return A.receipts(V.validations(spark, d), bad).select("artifact_id", "validation_id")


def _passes(spark, d):
    """One receipt for each artifact: that of the newest version."""
    return K.latest_per_key(A.receipts(V.validations(spark, d)).select("artifact_id", "content_hash", "validator_version"), ["artifact_id"], ["validator_version", "content_hash"])


def verified_artifacts(spark, d):
    return A.verified_artifacts(V.artifact_rows(spark, d), _passes(spark, d)).select("artifact_id", "status")


def candidate_artifacts(spark, d):
    staged = V.staged_documents(spark, d).select("job_id", "artifact_id", F.lit("staging").alias("how"))
    legacy = V.artifact_rows(spark, d).select("job_id", "artifact_id", F.lit("row").alias("how"))
    return A.candidate_artifacts(staged, legacy)


def _commits(spark, d):
    rows = V.staged_documents(spark, d)
    return rows.select(
        "job_id", "task_id", F.when(c("job_id") % 3 == 0, "COMPLETE").otherwise("RUNNING").alias("status"),
        F.when(c("job_id") % 8 == 1, F.concat(F.lit("gone"), c("artifact_id"))).when(c("job_id") % 12 != 0, c("artifact_id")).alias("artifact_id"),
    )


def _known(spark, d):
    return A.with_evidence(V.artifact_rows(spark, d), A.observed_bytes(V.contents(spark, d)), A.receipts(V.validations(spark, d)))


def structural_check(spark, d):
    rows = V.artifact_rows(spark, d).withColumn("size", F.when(c("job_id") % 6 != 1, c("size") + F.when(c("job_id") % 10 == 2, 1).otherwise(0)))
    checked = A.structural_check(rows, A.observed_bytes(V.contents(spark, d)))
    return checked.select("artifact_id", F.array_join("problems", ",").alias("problems"))


def completion_inspection(spark, d):
    n = c("job_id")
    given = F.when(n % 9 == 6, F.lit(None)).when(n % 15 == 3, "other").otherwise(c("artifact_id"))
    jobs = _commits(spark, d).select("job_id", "status", c("artifact_id").alias("result_artifact_id"), F.when(c("status") == "COMPLETE", given).alias("content_hash"))
    return A.completion(jobs, _known(spark, d), candidate_artifacts(spark, d).select("job_id", "artifact_id"))


def commit_adoption(spark, d):
    staged = V.staged_documents(spark, d).select("artifact_id", "job_id", (c("job_id") % 4).alias("fencing_token"))
    return A.adoptable(staged, V.jobs(spark, d)).select("artifact_id", "job_id")


def checkpoint_manifests(spark, d):
    entries = V.staged_documents(spark, d).select("task_id", "artifact_id", c("artifact_id").alias("content_hash"))
    return A.manifests(entries)


def checkpoint_verify(spark, d):
    """A checkpoint for each odd document and one for every eight even ones; every fifth has another name than its manifest's digest."""
    rows = _commits(spark, d).where("artifact_id IS NOT NULL")
    claimed = F.when(c("job_id") % 64 == 6, "stale").otherwise(c("artifact_id"))
    entries = rows.select(F.when(c("job_id") % 2 == 1, c("job_id") + 1_000_000).otherwise(F.floor(c("job_id") / 16)).cast("string").alias("task_id"), "artifact_id", claimed.alias("content_hash")).distinct()
    names = A.manifests(entries).select("task_id", F.when(c("task_id").cast("long") % 5 == 0, F.concat(F.lit("x"), c("task_id"))).otherwise(c("checkpoint_id")).alias("checkpoint_id"))
    known = _known(spark, d).withColumn("size", c("size") + F.when(c("job_id") % 32 == 9, 1).otherwise(0))
    return A.verify_checkpoints(names, entries.join(names, "task_id").select("checkpoint_id", "artifact_id", "content_hash"), known, I.tip(_log(spark, d)))


def _lenient(spark, d):
    """Checkpoints by source whose status is given, and pointers to them, one of them dangling."""
    rows = checkpoint_manifests(spark, d).select("task_id", "checkpoint_id", F.when(c("entries") % 2 == 0, "VERIFIED").otherwise("CORRUPT").alias("verification_status"))
    name = F.concat(F.lit("lkg:"), c("task_id"))
    pointers = rows.select(name.alias("name"), F.when(c("task_id") == "src3", "gone").otherwise(c("checkpoint_id")).alias("checkpoint_id"))
    return rows, pointers


def latest_known_good(spark, d):
    return A.latest_known_good(*_lenient(spark, d)).select("name", "checkpoint_id")


def checkpoint_pointers(spark, d):
    return A.all_pointers(*_lenient(spark, d)).select("name", "checkpoint_id", "verification_status")


def finalization_blockers(spark, d):
    items = C.listed(V.desired(spark, d), False).select("desired_work_id")
    k = c("desired_work_id")
    mapping = items.where(k % 50 != 1).select("desired_work_id", (k + F.when(k % 60 == 7, 10_000_000).otherwise(0)).alias("job_id"))
    tasks = V.tasks(spark, d).withColumn("status", F.when(c("task_id") % 53 == 0, "MANUAL_REVIEW").otherwise(c("status")))
    every, policies = V.incidents(spark, d), V.policies(spark, d)
    return A.release_blockers(A.Evidence(
        generation="g-5", version=4, task_id="release", head=spark.createDataFrame([(5,)], "version long"), items=items, mapping=mapping,
        jobs=V.release_jobs(spark, d), tasks=tasks, artifacts=V.release_artifacts(spark, d), spawns=E.unreaped_spawns(*_processes(spark, d)),
        incidents=R.open_incidents(every, "recovery").withColumn("failure_class", c("signature")), attempts=R.open_attempts(V.open_attempts(spark, d)),
        escalated=R.escalated_with_policy(every, policies, "human"), unconsumed=R.settled_without_policy_end(every, policies),
        breakers=V.release_breakers(spark, d), checkpoints=V.release_checkpoints(spark),
    ))


def blocker_counts(spark, d):
    return E.histogram(finalization_blockers(spark, d), "category")


def release_manifest(spark, d):
    return A.manifest_hash(A.artifacts(V.staged_documents(spark, d)).select("job_id", "artifact_id"), "artifact_id", "artifact_id")


def _log(spark, d):
    return V.table(spark, d, "events", "event_id", "user_id", "event_type", "props").select(
        (c("event_id") + 1).alias("seq"), F.concat_ws("|", c("event_type"), c("user_id").cast("string"), c("props")).alias("body")
    )


def ledger_contiguity(spark, d):
    return I.tip(_log(spark, d))


def ledger_chain_verify(spark, d):
    tampered = I.build_segments(_log(spark, d), 64).where("seq % 2500 <> 11")
    return I.chain_failures(tampered.withColumn("body", F.when(c("seq") % 1000 == 7, F.concat("body", F.lit("!"))).otherwise(c("body"))), 64)


def ledger_segments(spark, d):
    rows = I.build_segments(_log(spark, d), 8)
    return rows.groupBy("segment").agg(F.max_by("hash", "seq").alias("tip_hash"), F.count(F.lit(1)).alias("rows"))


def pk_duplicates(spark, d):
    return I.duplicate_keys(V.table(spark, d, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


def fk_violations(spark, d):
    return I.dangling(V.jobs(spark, d).select("job_id", "task_id"), "task_id", V.tasks(spark, d), "task_id")


def event_histogram(spark, d):
    return V.ledger(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("worker_id").alias("workers"), F.max("seq").alias("last_seq"))


def job_events(spark, d):
    return V.ledger(spark, d).where(c("job_id") == 42).select("seq", "event_type", "worker_id")


def evidence_per_worker(spark, d):
    spawns, reaps = _processes(spark, d)
    last = E.latest_generation(spawns, reaps)
    beat = K.latest_per_key(V.ledger(spark, d, "heartbeat").select("worker_id", "ts", "seq"), ["worker_id"], ["ts", "seq"]).select("worker_id", c("seq").alias("beat_seq"))
    jobs = E.owned_active(V.jobs(spark, d)).groupBy(c("owner_worker_id").alias("worker_id")).agg(F.count(F.lit(1)).alias("active_jobs"))
    return V.workers(spark).join(last, "worker_id", "left").join(beat, "worker_id", "left").join(jobs, "worker_id", "left").select(
        "worker_id", "status", "spawn_seq", "reap_seq", "beat_seq", F.coalesce("active_jobs", F.lit(0).cast("long")).alias("active_jobs")
    )


def keyset_batch(spark, d):
    return K.after_cursor(V.table(spark, d, "orders", "o_orderkey", "o_totalprice"), "o_orderkey", 500, 100)


def seeded_sample(spark, d):
    return S.seeded_sample(V.table(spark, d, "documents", "doc_id"), "doc_id", 0.05, "20260924", 3)


def scalar_functions(spark, d):
    k = c("o_orderkey")
    probe = F.concat(F.lit("w"), (k % 9).cast("string"), F.when(k % 4 != 0, ":").otherwise(""), F.when(k % 6 != 0, F.concat(F.lit("j"), k.cast("string"))).otherwise(""))
    path = F.concat_ws("/", F.lit("/data/staging"), F.concat(F.lit("t"), (k % 5).cast("string")), F.concat(F.lit("j"), k.cast("string")), F.lit("1"), F.sha2(k.cast("string"), 256))
    parts, split = S.probe_parts(probe), S.staged_path(path)
    return V.table(spark, d, "orders", "o_orderkey", "o_custkey").select(
        "o_orderkey", S.generation_name(k % 7).alias("generation"), S.lease_name(k, c("o_custkey")).alias("lease"), parts["job_id"].alias("probe_job"),
        split["task_id"].alias("task"), split["job_id"].alias("job"), S.first_set(k % 3, k % 5).alias("first_set"), S.tumbling_bucket(k, 300).alias("bucket"),
    )


def sql_query(spark, d):
    from tidemark.sources.catalog import Store

    return Store.open(spark, d).query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey >= :low GROUP BY c_nationkey", low=5)


def _specs(spark, d):
    """Spec texts of every shape, good and bad."""
    k = c("o_orderkey")
    n = k % 12
    text = (
        F.when(n == 0, F.lit('{"task_id": "t", "max_attempts": 0}'))
        .when(n == 1, F.lit('{"task_id": "", "policy": {}}'))
        .when(n == 2, F.lit('{"task_id": "t", "extra": 1}'))
        .when(n == 3, F.lit("no json"))
        .when(n == 4, F.lit('["task_id"]'))
        .when(n == 5, F.lit('{"task_id": 5}'))
        .when(n == 6, F.lit('{"task_id": "t", "stage_id": 7}'))
        .when(n == 7, F.lit('{"task_id": "t", "policy": []}'))
        .when(n == 8, F.concat(F.lit('{"max_attempts": 3, "task_id": "t'), (k % 30).cast("string"), F.lit('"}')))
        .when(n == 9, F.concat(F.lit('{"task_id": "t'), (k % 30).cast("string"), F.lit('", "stage_id": "s"}')))
        .when(n == 10, F.lit('{"task_id": "t", "max_attempts": true}'))
        .otherwise(F.concat(F.lit('{"task_id": "t'), (k % 30).cast("string"), F.lit('"}')))
    )
    return V.table(spark, d, "orders", "o_orderkey").select("o_orderkey", text.alias("spec"))


def spec_normalisation(spark, d):
    n = D.normal_spec(c("spec"))
    return _specs(spark, d).select(
        "o_orderkey", D.spec_problem(c("spec")).alias("problem"), n["task_id"].alias("task_id"), n["stage_id"].alias("stage_id"), n["max_attempts"].alias("max_attempts"),
        D.spec_identity(c("spec")).alias("identity"),
    )


def validator_receipts(spark, d):
    registry = Registry()
    registry.add("structural", "1", lambda row: F.length(row["artifact_id"]) == 64)
    registry.add("size", "1", lambda row: row["size"].between(100, 5000))
    rows = V.artifact_rows(spark, d)
    required = [("structural", "1"), ("size", "1")]
    return all_required(registry.run(rows, NOW_EVENTS, required), required).select("artifact_id")


def progress_evidence(spark, d):
    jobs = V.staged_documents(spark, d).select("job_id", "task_id", "size")
    table = V.artifact_rows(spark, d).join(V.staged_documents(spark, d).select("job_id", "task_id"), "job_id").select("artifact_id", "task_id", "status")
    rows, pointers = _lenient(spark, d)
    good = A.latest_known_good(rows, pointers).select("task_id", "checkpoint_id")
    return A.progress_evidence(jobs, table, good).select("job_id", "verified_artifacts", "latest_known_good")


def newest_verified_checkpoint(spark, d):
    k = c("doc_id")
    rows = V.table(spark, d, "documents", "doc_id", "source").select(
        k.alias("checkpoint_id"), c("source").alias("task_id"), F.when(k % 3 == 0, "VERIFIED").otherwise("UNVERIFIED").alias("verification_status"), (k % 40).alias("created_at")
    )
    return A.newest_verified(rows)


def manifest_drift(spark, d):
    rows = V.staged_documents(spark, d)
    pinned = rows.where(c("job_id") % 9 != 0).select(c("job_id").alias("key"), c("artifact_id").alias("digest"))
    current = rows.where(c("job_id") % 10 != 0).select(c("job_id").alias("key"), F.when(c("job_id") % 11 == 0, "new").otherwise(c("artifact_id")).alias("digest"))
    return A.manifest_drift(pinned, current)


def fenced_executions(spark, d):
    spawns, reaps = _processes(spark, d)
    tracked = E.unreaped_spawns(spawns, reaps).select("seq", (c("worker_id") % 5).alias("worker_id"), c("job_id"), F.when(c("seq") % 2 == 0, c("seq") % 3 + 1).alias("epoch"))
    jobs = V.jobs(spark, d).withColumn("owner_worker_id", c("job_id") % 5)
    return E.fenced(tracked, jobs, _revoked(spark, d))


def relevant_breakers(spark, d):
    scopes = V.jobs(spark, d).where("status = 'FAILED'").select(F.lit("TASK").alias("scope_type"), c("task_id").cast("string").alias("scope_id"))
    return B.relevant(V.breakers(spark, d), scopes).select("scope_id", "state")


QUERIES = {
    name: f
    for name, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", None) == __name__ and not name.startswith("_")
}
