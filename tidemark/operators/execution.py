"""Leases, capacity, process evidence and the watchdog's verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions.scalar import latest_of
from tidemark.operators.keyed import latest_per_key, without


def expired_leases(jobs: DataFrame, now: int) -> DataFrame:
    """Active owned jobs whose lease is over, with the observation and its reason."""
    c = F.col
    reason = F.concat(
        F.lit("lease of job "), c("job_id").cast("string"), F.lit(" expired at "), c("lease_expires_at").cast("string"),
        F.lit(f" <= {now}; owner="), c("owner_worker_id").cast("string"), F.lit(" status="), c("status"),
        F.lit(" token="), c("fencing_token").cast("string"),
    )
    return jobs.where(P.expired_execution(c("status"), c("owner_worker_id"), c("lease_expires_at"), now)).select(
        "job_id", "owner_worker_id", "fencing_token", "status", "lease_acquired_at", "lease_expires_at",
        F.lit(now).cast("long").alias("observed_at"), reason.alias("reason"),
    )


def owned_active(jobs: DataFrame) -> DataFrame:
    return jobs.where(P.is_active(F.col("status")) & F.col("owner_worker_id").isNotNull())


def jobs_in(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """Jobs in any of the states; no states give no jobs."""
    return jobs.where(F.col("status").isin(*statuses)) if statuses else jobs.where(F.lit(False))


def pending(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.where(F.col("status") == "PENDING").orderBy("created_at", "job_id").limit(max(0, limit))


def claimed_by_prefix(jobs: DataFrame, prefix: str, now: int) -> DataFrame:
    """Claimed jobs with a live lease whose owner's name starts with ``prefix``."""
    c = F.col
    mine = (c("status") == "CLAIMED") & c("owner_worker_id").cast("string").startswith(prefix)
    return jobs.where(mine & P.lease_live(c("lease_expires_at"), now)).orderBy("lease_expires_at", "job_id")


def capacity(jobs: DataFrame, most: int) -> DataFrame:
    """One row: active jobs, and how many more may run."""
    n = F.count_if(P.is_active(F.col("status")))
    return jobs.agg(n.alias("active"), F.greatest(F.lit(most) - n, F.lit(0)).alias("free"))


def reclaim(jobs: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """Outcome of requests ``(job_id, actor, forced, verdict, incident_id)`` to revoke a lease.

    An accepted request gives the state afterwards: claimed goes back to pending, running and
    committing become uncertain, the token grows, the owner goes.
    """
    c = F.col
    reason = (
        F.when(~P.may_reclaim(c("actor")), "actor_not_allowed")
        .when(~P.is_active(c("status")) | c("owner_worker_id").isNull(), "not_reclaimable")
        .when(~F.coalesce(c("forced"), F.lit(False)) & ~P.lease_expired(c("lease_expires_at"), now), "lease_not_expired")
        .when(F.coalesce(c("forced"), F.lit(False)) & (c("verdict").isNull() | c("incident_id").isNull()), "evidence_missing")
    )
    joined = requests.join(jobs, "job_id", "left").withColumn("rejected", reason)
    accepted = c("rejected").isNull()
    return joined.select(
        "job_id", "rejected",
        F.when(accepted, F.when(c("status") == "CLAIMED", "PENDING").otherwise("UNCERTAIN")).alias("new_status"),
        F.when(accepted, c("fencing_token") + 1).alias("new_token"),
    )


def lease_state(events: DataFrame) -> DataFrame:
    """The lease of each job as the last claim, renewal, release or reclaim leaves it.

    ``events (seq, event_type, job_id, worker_id, lease_expires_at)``.
    """
    kinds = ("job.claimed", "lease.renewed", "lease.released", "job.lease_reclaimed")
    last = latest_per_key(events.where(F.col("event_type").isin(*kinds)), ["job_id"], ["seq"])
    held = F.col("event_type").isin("job.claimed", "lease.renewed")
    return last.select(
        "job_id", "seq", F.when(held, F.col("worker_id")).alias("owner_worker_id"), F.when(held, F.col("lease_expires_at")).alias("lease_expires_at")
    )


# ---------------------------------------------------------------- processes


def unreaped_spawns(spawns: DataFrame, reaps: DataFrame) -> DataFrame:
    """Spawns whose (worker, process) was never reaped; null keys match null keys."""
    return without(spawns, reaps, ["worker_id", "proc_id"])


def latest_generation(spawns: DataFrame, reaps: DataFrame) -> DataFrame:
    """Each worker's newest spawn and, if there is one, its first reap."""
    last = latest_per_key(spawns.select("worker_id", "proc_id", "seq", "ts"), ["worker_id"], ["seq"])
    ended = reaps.groupBy(F.col("worker_id").alias("_w"), F.col("proc_id").alias("_p")).agg(F.min("seq").alias("reap_seq"))
    same = F.col("worker_id").eqNullSafe(F.col("_w")) & F.col("proc_id").eqNullSafe(F.col("_p"))
    return last.join(ended, same, "left").select(
        "worker_id", "proc_id", F.col("seq").alias("spawn_seq"), F.col("ts").alias("spawn_ts"), "reap_seq"
    )


def process_class(pid: Column, exists: Column, zombie: Column, pgid: Column, jiffies: Column, seen_jiffies: Column, wall_start: Column, spawn_ts: Column, readable: Column) -> Column:
    """dead, reuse, live_match or unverifiable, from what was observed of a process."""
    return (
        F.when(pid.isNull(), "unverifiable")
        .when(~exists, "dead")
        .when(zombie, "dead")
        .when(~readable, "unverifiable")
        .when(pgid != pid, "reuse")
        .when(jiffies.isNotNull() & (jiffies != seen_jiffies), "reuse")
        .when(jiffies.isNotNull(), "live_match")
        .when(wall_start > spawn_ts + 60 * P.SECOND, "reuse")
        .otherwise("live_match")
    )


def death_evidence(workers: DataFrame, open_spawns: DataFrame, generations: DataFrame) -> DataFrame:
    """``(worker_id, worker_status, death)``: why a worker is known to be dead, or null.

    ``open_spawns`` are unreaped, with the class observed in ``observation``.
    """
    newest = latest_per_key(open_spawns.select("worker_id", "seq", "observation"), ["worker_id"], ["seq"])
    newest = newest.select("worker_id", F.col("seq").alias("_open"), "observation")
    ended = generations.select("worker_id", "reap_seq")
    death = (
        F.when(F.col("status").isin(*P.TERMINAL_WORKER), "worker_terminal")
        .when(F.col("_open").isNotNull(), F.when(F.col("observation").isin("dead", "reuse"), "process_identity_dead"))
        .when(F.col("reap_seq").isNotNull(), "process_reaped")
    )
    return workers.join(newest, "worker_id", "left").join(ended, "worker_id", "left").select(
        "worker_id", F.col("status").alias("worker_status"), death.alias("death")
    )


def watchdog_verdicts(jobs: DataFrame, deaths: DataFrame, beats: DataFrame, prior: DataFrame, now: int, progress_stale: int) -> DataFrame:
    """HEALTHY, STALLED or DEAD for every owned active job whose worker is known.

    Dead once for a (job, token) is dead for ever; then evidence of death, an expired lease and
    progress older than the threshold decide in this order.  The age of the last heartbeat is
    reported, and decides nothing.
    """
    c = F.col
    last_beat = beats.groupBy(c("worker_id").alias("owner_worker_id")).agg(F.max("ts").alias("last_beat"))
    last = latest_per_key(prior.select("job_id", "fencing_token", "verdict", "evaluated_at", "verdict_id"), ["job_id", "fencing_token"], ["evaluated_at", "verdict_id"])
    last = last.select("job_id", "fencing_token", c("verdict").alias("previous"))
    baseline = F.coalesce(c("progress_updated_at"), latest_of(c("lease_acquired_at"), c("created_at")))
    verdict = (
        F.when(c("previous") == "DEAD", "DEAD")
        .when(c("death").isNotNull(), "DEAD")
        .when(P.lease_expired(c("lease_expires_at"), now), "STALLED")
        .when(P.is_stale(baseline, progress_stale, now), "STALLED")
        .otherwise("HEALTHY")
    )
    return (
        owned_active(jobs)
        .join(deaths.withColumnRenamed("worker_id", "owner_worker_id"), "owner_worker_id")
        .join(last_beat, "owner_worker_id", "left")
        .join(last, ["job_id", "fencing_token"], "left")
        .select(
            "job_id", "owner_worker_id", "fencing_token", "status", "previous", "death",
            (F.lit(now) - c("last_beat")).alias("heartbeat_age"),
            (F.lit(now) - baseline).alias("progress_age"),
            verdict.alias("verdict"),
        )
    )


def revocations(spawns: DataFrame, authority: DataFrame) -> DataFrame:
    """For each spawn ``(worker_id, proc_id, job_id, ts)``: the first event after it that revokes its job.

    ``authority (seq, event_type, job_id, worker_id, prev_owner, ts)`` has claims and reclaims.  A
    revocation is a reclaim from this worker, a claim by another, or this worker's second claim, whichever has
    the smallest number among the events with a later time.

    Spawns and events of a job stand in one order, newest first, and running minima go along it: over
    the reclaims from a worker, over the claims of a worker, over all claims.  So each row is met once
    however many spawns and events a job has.
    """
    c = F.col
    kind = c("event_type")
    none = F.lit(None)
    spawn_rows = spawns.select(
        "job_id", "ts", c("worker_id").alias("who"), c("seq").alias("spawn_seq"), "proc_id",
        *[none.cast("struct<seq:bigint,ts:bigint>").alias(x) for x in ("claim", "reclaim")], none.cast("struct<seq:bigint,who:bigint>").alias("claimer"),
    )
    at = F.struct(c("seq").cast("bigint").alias("seq"), c("ts").cast("bigint").alias("ts"))
    events = authority.where(kind.isin("job.claimed", "job.lease_reclaimed"))
    event_rows = events.select(
        "job_id", "ts", F.when(kind == "job.claimed", c("worker_id")).otherwise(c("prev_owner")).alias("who"), none.cast("bigint").alias("spawn_seq"), none.alias("proc_id"),
        F.when(kind == "job.claimed", at).alias("claim"), F.when(kind == "job.lease_reclaimed", at).alias("reclaim"),
        F.when(kind == "job.claimed", F.struct(c("seq").cast("bigint").alias("seq"), c("worker_id").alias("who"))).alias("claimer"),
    )
    who = dict(spawns.dtypes)["worker_id"]
    rows = spawn_rows.withColumn("claimer", none.cast(f"struct<seq:bigint,who:{who}>")).unionByName(event_rows.withColumn("proc_id", none.cast(dict(spawns.dtypes)["proc_id"])))
    own = Window.partitionBy("job_id", "who").orderBy(F.desc("ts"))
    every = Window.partitionBy("job_id").orderBy(F.desc("ts"))
    later = lambda w: w.rangeBetween(Window.unboundedPreceding, -1)
    before = lambda w: w.orderBy(F.desc("ts"), "claimer").rowsBetween(Window.unboundedPreceding, -1)

    # The second smallest of a set is the least of max(x, smallest before x), in any order.
    first_own, first_any = F.min("claim").over(before(Window.partitionBy("job_id", "who"))), F.min("claimer").over(before(Window.partitionBy("job_id")))
    second = F.when(c("claim").isNotNull() & c("_own").isNotNull(), F.greatest("claim", "_own"))
    other = F.when(c("claim").isNotNull() & c("_any").isNotNull() & ~c("_any.who").eqNullSafe(c("who")), F.greatest(c("claim.seq"), c("_any.seq")))
    marked = rows.withColumn("_own", first_own).withColumn("_any", first_any).withColumn("_second", second).withColumn("_other", other)
    found = marked.select(
        "job_id", "ts", "who", "proc_id", "spawn_seq",
        F.min("reclaim").over(later(own)).alias("reclaimed"), F.min("_second").over(later(own)).alias("again"),
        F.min("claimer").over(later(every)).alias("first_claim"), F.min("_other").over(later(every)).alias("other_claim"),
    ).where(c("spawn_seq").isNotNull())
    by_other = F.when(~c("first_claim.who").eqNullSafe(c("who")), c("first_claim.seq")).otherwise(c("other_claim"))
    best = F.least(c("reclaimed.seq"), F.when(c("first_claim").isNotNull(), by_other), c("again.seq"))
    why = F.when(best == c("reclaimed.seq"), "reclaimed").when(best == c("again.seq"), "claimed_again").when(best.isNotNull(), "claimed_by_other")
    times = events.select(c("seq").alias("revoked_seq"), c("ts").alias("revoked_ts"))
    return (
        found.select(c("who").alias("worker_id"), "proc_id", "job_id", "spawn_seq", c("ts").alias("spawn_ts"), best.alias("revoked_seq"), why.alias("revoked_by"))
        .join(times, "revoked_seq", "left")
        .select("worker_id", "proc_id", "job_id", "spawn_seq", "spawn_ts", "revoked_seq", "revoked_ts", "revoked_by")
    )


def fence_timing(revoked: DataFrame, deaths: DataFrame, bound: int) -> DataFrame:
    """Time from a revocation to the observed death ``(spawn_seq, death_ts)``, against a bound."""
    took = F.col("death_ts") - F.col("revoked_ts")
    return revoked.where(F.col("revoked_ts").isNotNull()).join(deaths, "spawn_seq").select(
        "spawn_seq", F.greatest(took, F.lit(0)).alias("consumed"), (took <= bound).alias("within_bound")
    )


def boot_dispositions(open_spawns: DataFrame, workers: DataFrame, jobs: DataFrame, revoked: DataFrame, now: int) -> DataFrame:
    """What to do with each unreaped process at start: adopt it only if its authority is fully current."""
    c = F.col
    w = workers.select("worker_id", c("status").alias("worker_status"))
    j = jobs.select("job_id", c("owner_worker_id").alias("owner"), c("lease_expires_at").alias("lease"), c("status").alias("job_status"))
    r = revoked.select(c("spawn_seq").alias("seq"), "revoked_seq")
    reasons = F.array_compact(
        F.array(
            F.when(~c("owner").eqNullSafe(c("worker_id")), "owner_mismatch"),
            F.when(c("revoked_seq").isNotNull(), "authority_revoked_after_spawn"),
            F.when(~P.lease_live(c("lease"), now), "lease_not_live"),
            F.when(~P.is_active(c("job_status")), "job_not_active"),
        )
    )
    orphan = (
        F.when(c("observation") == "unverifiable", "process_identity_unverifiable")
        .when(c("worker_status").isNull(), "no_authoritative_worker_row")
        .when(c("worker_status").isin(*P.TERMINAL_WORKER), "worker_identity_terminal")
        .when(c("job_id").isNull(), "spawn_has_no_job_binding")
        .when(c("job_status").isNull(), "job_row_missing")
    )
    disposition = (
        F.when(c("observation") == "dead", "ALREADY_DEAD")
        .when(c("observation") == "reuse", "PID_REUSE")
        .when(orphan.isNotNull(), "ORPHAN")
        .when(F.size(reasons) == 0, "ADOPT")
        .otherwise("FENCE")
    )
    return (
        open_spawns.join(w, "worker_id", "left").join(j, "job_id", "left").join(r, "seq", "left")
        .select(
            "seq", "worker_id", "proc_id", "job_id", disposition.alias("disposition"),
            F.when(disposition == "FENCE", F.array_join(reasons, ",")).when(disposition == "ORPHAN", orphan).otherwise("").alias("reasons"),
        )
    )


def live_claims(beats: DataFrame, stale_after: int, now: int) -> DataFrame:
    """``(worker_id, last_beat, alive)``: the claim beat that each worker's last row leaves, and whether it is fresh.

    ``beats (worker_id, seq, ts, kind)``; a withdrawal or clearing leaves none.
    """
    last = latest_per_key(beats.select("worker_id", "seq", "ts", "kind"), ["worker_id"], ["seq"])
    beat = F.when(F.col("kind") == "beat", F.col("ts"))
    return last.select("worker_id", beat.alias("last_beat"), P.beat_live(beat, stale_after, now).alias("alive"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def fenced(tracked: DataFrame, jobs: DataFrame, revoked: DataFrame) -> DataFrame:
    """Processes ``(seq, worker_id, job_id, epoch)`` that lost their authority.

    The owner is another, or the token is another than the learned epoch; without an epoch, a
    revocation after the spawn decides.  A missing job fences nothing.
    """
    c = F.col
    j = jobs.select("job_id", c("owner_worker_id").alias("_owner"), c("fencing_token").alias("_token"))
    r = revoked.select(c("spawn_seq").alias("seq"), "revoked_seq")
    lost = F.when(c("epoch").isNotNull(), ~c("epoch").eqNullSafe(c("_token"))).otherwise(c("revoked_seq").isNotNull())
    why = F.when(~c("_owner").eqNullSafe(c("worker_id")), "owner_changed").when(lost, "authority_revoked")
    return tracked.join(j, "job_id").join(r, "seq", "left").select("seq", "worker_id", "job_id", why.alias("fenced_by")).where(c("fenced_by").isNotNull())
