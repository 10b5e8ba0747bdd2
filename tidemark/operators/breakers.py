"""Circuit breakers: signals, windows, trips, denials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.operators.keyed import anchored_window

#: Fixed values, in seconds and counts.
WINDOW_S, THRESHOLD, GLOBAL_THRESHOLD, COOLDOWN_S, PROBES, PRESSURE = 300, 3, 10, 60, 1, 5
#: The order in which the scopes of a claim are asked.
CLAIM_ORDER = ("GLOBAL", "TASK", "DESIRED", "JOB")


def fan_out(failures: DataFrame) -> DataFrame:
    """One row for each scope that a failure ``(job_id, task_id, ...)`` counts against: job, task if any, global."""
    def scope(kind: str, ident: Column) -> Column:
        return F.struct(F.lit(kind).alias("scope_type"), ident.cast("string").alias("scope_id"))

    scopes = F.array_compact(
        F.array(scope("JOB", F.col("job_id")), F.when(F.col("task_id").isNotNull(), scope("TASK", F.col("task_id"))), scope("GLOBAL", F.lit("GLOBAL")))
    )
    return failures.where(F.col("job_id").isNotNull()).withColumn("_s", F.explode(scopes)).select("_s.*", *failures.columns)


def signals(failures: DataFrame, now: int, window: int) -> DataFrame:
    """Signals of failures ``(failure_kind, incident_id, attempt_id, job_id, task_id, observed_at, windowed)``, each once.

    Failures older than the window and a second are left out, unless ``windowed`` is false.
    """
    c = F.col
    recent = failures.where(~c("windowed") | (c("observed_at") >= now - window - P.SECOND))
    key = F.concat_ws(":", "scope_type", "scope_id", "failure_kind", F.coalesce(c("incident_id").cast("string"), F.lit("-")), F.coalesce(c("attempt_id").cast("string"), F.lit("-")))
    named = fan_out(recent).withColumn("signal_id", key)
    return named.groupBy("signal_id", "scope_type", "scope_id", "failure_kind").agg(F.min("observed_at").alias("observed_at"))


def touched(signal_rows: DataFrame) -> DataFrame:
    """Signals and distinct kinds of each scope."""
    return signal_rows.groupBy("scope_type", "scope_id").agg(
        F.count(F.lit(1)).alias("signals"), F.array_join(F.array_sort(F.collect_set("failure_kind")), ",").alias("kinds")
    )


def windows(signal_rows: DataFrame, window: int) -> DataFrame:
    """The state of each scope's anchored window."""
    return anchored_window(signal_rows, ["scope_type", "scope_id"], "observed_at", window)


def trips(window_rows: DataFrame, now: int, window: int, threshold: int = THRESHOLD, global_threshold: int = GLOBAL_THRESHOLD) -> DataFrame:
    """Scopes whose count reached the threshold in a window that is not over."""
    need = F.when(F.col("scope_type") == "GLOBAL", global_threshold).otherwise(threshold)
    return window_rows.where((F.col("failure_count") >= need) & ~P.window_over(now, F.col("window_started_at"), window))


def pressure(open_attempts: DataFrame, failed_attempts: DataFrame, escalations: DataFrame, now: int, window: int, threshold: int = PRESSURE) -> DataFrame:
    """One row: recent attempts, failures and escalations together, and whether they are pressure.

    Each input has ``ts``; the bucket names the signal, so it counts once in each calendar window.
    """
    every = open_attempts.select("ts").unionByName(failed_attempts.select("ts")).unionByName(escalations.select("ts"))
    n = F.count_if(F.col("ts") >= now - window)
    return every.agg(n.alias("pressure"), (n >= threshold).alias("signalled"), F.lit(now // window).cast("long").alias("bucket"))


def next_state(state: Column, tripped: Column, cooldown_until: Column, probe: Column, now: int) -> Column:
    """The state after one pass: closed trips, open cools down, half-open follows its probe."""
    return (
        F.when((state == "CLOSED") & tripped, "OPEN")
        .when((state == "OPEN") & P.cooldown_over(cooldown_until, now), "HALF_OPEN")
        .when((state == "HALF_OPEN") & (probe == "success"), "CLOSED")
        .when((state == "HALF_OPEN") & probe.isin("failure", "corrupt"), "OPEN")
        .otherwise(state)
    )


def probe_outcome(job_status: Column, progress: Column, baseline: Column, failed_after: Column) -> Column:
    """success, failure, inflight, or corrupt where the probe cannot be judged."""
    return (
        F.when(job_status.isNull() | baseline.isNull() | F.isnan(baseline.cast("double")), "corrupt")
        .when(job_status == "COMPLETE", "success")
        .when(F.coalesce(progress > baseline, F.lit(False)), "success")
        .when(F.coalesce(failed_after, F.lit(False)), "failure")
        .otherwise("inflight")
    )


def listed(breakers: DataFrame) -> DataFrame:
    """Breakers in the order of their scopes."""
    return breakers.orderBy("scope_type", "scope_id")


def with_denials(jobs: DataFrame, breakers: DataFrame, scopes: DataFrame, probes: int = PROBES) -> DataFrame:
    """Adds ``denied_by``: the first scope, in the order of a claim, whose breaker is open or corrupt.

    ``scopes (job_id, scope_type, scope_id)`` are the scopes of the jobs; a scope without a breaker allows.
    ``probe_scope`` names the first half-open one of a job that is not denied, if its probes are used up
    the job is denied by it.
    """
    c = F.col
    order = F.array_position(F.array(*map(F.lit, CLAIM_ORDER)), c("scope_type"))
    asked = scopes.join(breakers, ["scope_type", "scope_id"]).withColumn(
        "class", P.breaker_class(c("state"), c("version"), c("half_open_probes_used"))
    )
    name = F.concat_ws(":", "scope_type", "scope_id")
    spent = (c("class") == "half_open") & (c("half_open_probes_used") >= probes)
    denies = c("class").isin("open", "corrupt") | spent
    verdicts = asked.groupBy("job_id").agg(
        F.min_by(F.when(denies, name), F.when(denies, order)).alias("denied_by"),
        F.min_by(F.when((c("class") == "half_open") & ~denies, name), F.when((c("class") == "half_open") & ~denies, order)).alias("probe_scope"),
    )
    return jobs.join(verdicts, "job_id", "left")


def relevant(breakers: DataFrame, scopes: DataFrame) -> DataFrame:
    """Breakers of the given scopes."""
    return breakers.join(scopes.select("scope_type", "scope_id").distinct(), ["scope_type", "scope_id"], "left_semi")
