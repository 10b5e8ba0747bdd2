"""The logical tables as projections of the star-schema test tables.

Only the columns that a query asks for are read: each view selects them before anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: 1998-06-01 and 2024-01-31, in epoch microseconds.
NOW_ORDERS = 896_659_200_000_000
NOW_EVENTS = 1_706_659_200_000_000
OWNERS = 150

PRIORITY_STATUS = {"1-URGENT": "RUNNING", "2-HIGH": "CLAIMED", "3-MEDIUM": "COMMITTING", "4-NOT SPECIFIED": "FAILED", "5-LOW": "UNCERTAIN"}
EVENT_KINDS = {
    "signup": "worker.proc_spawned", "purchase": "worker.proc_reaped", "view": "job.claimed", "click": "heartbeat", "error": "failure",
}


#: Budgets of a recovery policy's rungs, readable and not.
RUNG_TEXTS = ['{"1":2,"2":2}', '{"6":1}', '{"1":-1}', '{"1":true}', "[1]", "nope", None, '{"1":2.5}', '{"1":"2"}', "{}", '{"3":0}', "", '{"5":1,"0":1}']


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def micros(ts: str | Column) -> Column:
    """Epoch microseconds of a time without a zone, whatever the session's zone is."""
    t = F.col(ts) if isinstance(ts, str) else ts
    clock = F.hour(t) * 3600 + F.minute(t) * 60
    return (F.unix_date(t.cast("date")).cast("long") * DAY + clock.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")).cast("long")


def mapped(column: str, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in names.items():
        out = F.when(F.col(column) == name, value).otherwise(out)
    return out


def jobs(spark: SparkSession, sf_dir: str, progress: bool = False) -> DataFrame:
    """Orders as jobs; with ``progress`` also their lines' progress."""
    c = F.col
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    status = F.when(c("o_orderstatus") == "F", "COMPLETE").when(c("o_orderstatus") == "P", "PENDING").otherwise(mapped("o_orderpriority", PRIORITY_STATUS))
    active = c("status").isin("RUNNING", "CLAIMED", "COMMITTING")
    out = orders.select(
        c("o_orderkey").alias("job_id"), c("o_custkey").alias("task_id"), status.alias("status"), micros("o_orderdate").alias("created_at")
    ).select(
        "job_id", "task_id", "status",
        F.when(active, c("task_id") % OWNERS).alias("owner_worker_id"),
        (c("job_id") % 3 + 1).alias("fencing_token"),
        F.when(active, c("created_at")).alias("lease_acquired_at"),
        (c("created_at") + (c("job_id") % 30 + 1) * DAY).alias("lease_expires_at"),
        "created_at",
    )
    if not progress:
        return out
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus", "l_shipdate")
    finished = c("l_linestatus") == "F"
    done = lines.groupBy(c("l_orderkey").alias("job_id")).agg(
        F.count_if(finished).alias("progress_done"), F.count(F.lit(1)).alias("progress_total"), F.max(F.when(finished, micros("l_shipdate"))).alias("progress_updated_at")
    )
    return out.join(done, "job_id", "left")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tasks; one segment waits for a human, and every 97th is missing."""
    c = F.col
    return table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").where(c("c_custkey") % 97 != 0).select(
        c("c_custkey").alias("task_id"), F.when(c("c_mktsegment") == "MACHINERY", "PAUSED_FOR_HUMAN").otherwise("EXECUTING").alias("status")
    )


def workers(spark: SparkSession) -> DataFrame:
    """Workers 0 to 149 but for every 23rd; some are dead or retired."""
    i = F.col("id")
    return spark.range(OWNERS).where(i % 23 != 5).select(
        i.alias("worker_id"), F.when(i % 17 == 0, "DEAD").when(i % 19 == 0, "RETIRED").otherwise("RUNNING").alias("status")
    )


def ledger(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Events as a log; the kinds are pushed to the scan before any JSON is read."""
    c = F.col
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    if kinds:
        names = [name for name, kind in EVENT_KINDS.items() if kind in kinds]
        events = events.where(c("event_type").isin(*names))
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        (c("event_id") + 1).alias("seq"), mapped("event_type", EVENT_KINDS).alias("event_type"), c("user_id").alias("worker_id"),
        k.alias("proc_id"), k.alias("job_id"), micros("ts").alias("ts"),
    )


def observed(spawns: DataFrame) -> DataFrame:
    """Spawns with the class that a look at their process would give."""
    n = (F.col("worker_id") * 7 + F.col("proc_id")) % 5
    return spawns.withColumn("observation", F.when(n == 0, "dead").when(n == 1, "reuse").when(n == 2, "unverifiable").otherwise("live_match"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as recovery attempts of their order's incident, numbered by a total order of all columns."""
    from tidemark.operators.keyed import numbered

    c = F.col
    names = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", *names)
    state = F.when(c("l_returnflag") == "R", "FAILED").when(c("l_returnflag") == "N", "BLOCKED").otherwise("SUCCEEDED")
    return numbered(lines, ["l_orderkey"], names).select(
        c("l_orderkey").alias("incident_id"), "attempt_number", state.alias("attempt_state"),
        F.when(c("l_returnflag") == "A", c("l_quantity")).otherwise(0.0).alias("progress_delta"),
        (c("l_suppkey") % 5 + 1).cast("int").alias("rung"), micros("l_shipdate").alias("ts"),
    )


def staged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as staged content: the artifact is named by its hash."""
    c = F.col
    return table(spark, sf_dir, "documents", "doc_id", "text", "source").select(
        F.sha2(F.coalesce(c("text"), F.lit("")), 256).alias("artifact_id"), c("doc_id").alias("job_id"),
        F.octet_length(F.coalesce(c("text"), F.lit(""))).cast("long").alias("size"), c("source").alias("task_id"), (c("doc_id") % 50).alias("staged_at"),
    )


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as receipts for the content of their document."""
    c = F.col
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    docs = staged_documents(spark, sf_dir).select("job_id", "artifact_id")
    return labels.join(docs, c("doc_id") == c("job_id")).select(
        c("doc_id").alias("validation_id"), "artifact_id", F.lit("structural").alias("validator_id"), (c("doc_id") % 2).alias("validator_version"),
        F.when(c("quality") == 1, "PASS").otherwise("FAIL").alias("result"), (c("toxic") == 1).alias("quarantined"),
        c("artifact_id").alias("content_hash"), (c("doc_id") % 50).alias("validated_at"),
    )


def artifact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts with a state that depends on their smallest stager."""
    from tidemark.operators.artifacts import artifacts

    n = F.col("job_id") % 4
    return artifacts(staged_documents(spark, sf_dir)).select(
        "artifact_id", "job_id", "size", F.col("artifact_id").alias("content_hash"),
        F.when(n == 0, "STAGING").when(n == 1, "RELEASED").otherwise("VALIDATED").alias("status"),
        pick(F.col("job_id"), ["{}", "bad", None, "[1]", *['{"worker": 1}'] * 9]).alias("producer"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes that are staged for each artifact: lost for some, changed for others."""
    c = F.col
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(c("doc_id").alias("job_id"), F.when(c("doc_id") % 16 == 5, F.concat(text, F.lit("!"))).otherwise(text).alias("content"))
    return artifact_rows(spark, sf_dir).select("artifact_id", "job_id").where(c("job_id") % 16 != 3).join(docs, "job_id").select("artifact_id", c("content").cast("binary").alias("content"))


def open_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt of every third order's incident, in every state."""
    k = F.col("o_orderkey")
    states = ["CREATED", "RUNNING", "VERIFYING", "UNCERTAIN", "SUCCEEDED", "FAILED", "BLOCKED"]
    return table(spark, sf_dir, "orders", "o_orderkey").where(k % 3 == 0).select(
        F.concat(F.lit("t"), k.cast("string")).alias("attempt_id"), k.alias("incident_id"), pick(k, states).alias("attempt_state")
    )


def release_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with the result that they name; some are blocked or being verified."""
    c = F.col
    k = c("job_id")
    named = F.when(k % 12 != 0, F.concat(F.lit("r"), k.cast("string")))
    return jobs(spark, sf_dir).select(
        "job_id", "task_id", F.when(k % 41 == 0, "BLOCKED").when(k % 41 == 1, "VERIFYING").otherwise(c("status")).alias("status"),
        named.alias("result_artifact_id"), F.when(k % 7 != 0, F.sha2(F.concat(F.lit("c"), k.cast("string")), 256)).alias("content_hash"),
    )


def release_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artifacts that jobs name, with what is known of their bytes and receipts; each flaw is in some."""
    k = F.col("o_orderkey")
    own = F.sha2(F.concat(F.lit("c"), k.cast("string")), 256)
    return table(spark, sf_dir, "orders", "o_orderkey").where((k % 12 != 0) & (k % 13 != 0)).select(
        F.concat(F.lit("r"), k.cast("string")).alias("artifact_id"), (k + F.when(k % 17 == 0, 1).otherwise(0)).alias("job_id"),
        F.when(k % 19 == 0, "x").otherwise(own).alias("content_hash"), F.when(k % 23 == 0, "STAGING").otherwise("RELEASED").alias("status"),
        F.when(k % 29 == 0, F.lit(None)).when(k % 31 == 0, "y").otherwise(own).alias("bytes_hash"),
        F.when(k % 37 != 0, F.create_map(F.lit("structural/1"), F.when(k % 47 == 0, "z").otherwise(own))).alias("passed"),
    )


def release_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakers of tasks, jobs, declared items and of everything."""
    k = F.col("o_orderkey")
    columns = ["scope_type", "scope_id", "state", "version", "half_open_probes_used"]
    more = table(spark, sf_dir, "orders", "o_orderkey").where((k % 97 == 0) | (k % 101 == 0)).select(
        F.when(k % 97 == 0, "JOB").otherwise("DESIRED").alias("scope_type"), k.cast("string").alias("scope_id"),
        pick(k, ["OPEN", "HALF_OPEN", "CLOSED", "ODD"]).alias("state"), F.lit(1).cast("long").alias("version"), F.lit(0).cast("long").alias("half_open_probes_used"),
    )
    whole = spark.createDataFrame([("GLOBAL", "global", "OPEN", 1, 0), ("GLOBAL", "other", "OPEN", 1, 0), ("TASK", "release", "HALF_OPEN", 1, 0)], "scope_type string, scope_id string, state string, version long, half_open_probes_used long")
    return breakers(spark, sf_dir).select(*columns).unionByName(more).unionByName(whole)


#: Release checkpoints: manifest, whether it names the row, task, state, whether and how it is attested.
RELEASE_CHECKPOINTS = [
    ("m1", True, "release", "VERIFIED", "own"), ("m2", True, "release", "VERIFIED", "none"), ("m3", True, "release", "VERIFIED", "foreign"), ("m4", True, "release", "VERIFIED", "no json"),
    ("m5", True, "release", "CORRUPT", "none"), ("m6", True, "release", "UNVERIFIED", "none"), ("m7", True, "elsewhere", "UNVERIFIED", "none"), ("m8", False, "release", "UNVERIFIED", "none"),
]


def release_checkpoints(spark: SparkSession) -> DataFrame:
    c = F.col
    rows = spark.createDataFrame(RELEASE_CHECKPOINTS, "canonical_manifest string, named boolean, task_id string, verification_status string, how string")
    rows = rows.withColumn("checkpoint_id", F.when(c("named"), F.sha2("canonical_manifest", 256)).otherwise(c("canonical_manifest")))
    receipt = lambda ident: F.to_json(F.struct(F.lit(True).alias("release"), ident.alias("checkpoint_id")))
    how = F.when(c("how") == "own", receipt(c("checkpoint_id"))).when(c("how") == "foreign", receipt(F.lit("m"))).when(c("how") == "no json", "?")
    return rows.select("checkpoint_id", "task_id", "canonical_manifest", "verification_status", how.alias("receipt"))


def breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as breaker rows of their task, in every state, some of them corrupt."""
    c = F.col
    n = c("c_custkey") % 11
    return table(spark, sf_dir, "customer", "c_custkey").where(n < 6).select(
        F.lit("TASK").alias("scope_type"), c("c_custkey").cast("string").alias("scope_id"),
        F.when(n <= 1, "OPEN").when(n == 2, "HALF_OPEN").when(n == 3, "BROKEN").otherwise("CLOSED").alias("state"),
        F.when(n != 4, F.lit(1).cast("long")).alias("version"), (c("c_custkey") % 2).alias("half_open_probes_used"),
        (F.lit(NOW_ORDERS) + (c("c_custkey") % 3 - 1) * 60_000_000).alias("cooldown_until"), (c("c_custkey") % 7 == 0).alias("tripped"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as incidents of their own job."""
    c = F.col
    k = c("o_orderkey")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(
        k.alias("incident_id"), k.alias("job_id"), F.when(k % 5 == 0, "recovery").otherwise("other").alias("scope"),
        F.when(k % 7 == 0, "success").when(k % 7 == 1, "stopped").when(k % 7 == 2, "superseded").alias("outcome"),
        F.when(k % 13 == 0, "human").alias("escalated_to"), F.concat(F.lit("sig-"), (k % 500).cast("string")).alias("signature"), micros("o_orderdate").alias("created_at"),
    )


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery policies of every incident; some rows break a rule."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders", "o_orderkey").select(
        k.alias("incident_id"), (k % 6).cast("int").alias("current_rung"), (k % 10).alias("version"),
        F.lit(7).cast("long").alias("incident_budget"), (F.lit(7) - k % 8).alias("remaining_budget"), (k % 8 + F.when(k % 31 == 0, 1).otherwise(0)).alias("attempt_count"),
        (k % 3).alias("consumed_attempt_number"), (k % 3 - F.when(k % 29 == 0, 1).otherwise(0)).alias("result_consumed_attempt_number"),
        (k % 4).alias("zero_progress_count"), F.when(k % 9 == 0, "RECOVERY_COMPLETE").when(k % 43 == 1, "FINISHED").alias("terminal_state"),
        pick(k, RUNG_TEXTS).alias("per_rung_budgets"), pick(k, ["[]", "x", None, "", *['{"1": 1}'] * 7]).alias("per_rung_attempts"),
        F.when(k % 37 == 0, "").when(k % 37 != 1, "v1").alias("policy_version"),
    )


def pick(k: Column, texts: list[str | None]) -> Column:
    """The text at place ``k`` modulo their number."""
    return F.get(F.array(*[F.lit(t).cast("string") for t in texts]), F.pmod(k, F.lit(len(texts))).cast("int"))


def desired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as declared items; every tenth is retired."""
    c = F.col
    k = c("o_orderkey")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").select(
        k.alias("desired_work_id"), k.alias("canonical_job_id"), c("o_custkey").alias("task_id"), F.sha2(c("o_orderpriority"), 256).alias("spec_hash"),
        (k % 10 == 0).alias("retired"), (k % 3 + 1).alias("version"),
    )


def actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines as the jobs that exist."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").groupBy(c("l_orderkey").alias("job_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("l_returnflag").alias("flag")
    )
    status = (
        F.when(c("n") % 9 == 0, "QUARANTINED").when(c("flag") == "A", "PENDING").when(c("n") % 5 == 0, "RUNNING").when(c("n") % 5 == 1, "COMPLETE")
        .when(c("n") % 5 == 2, "FAILED").when(c("n") % 5 == 3, "BLOCKED").otherwise("UNCERTAIN")
    )
    return lines.select("job_id", status.alias("status"))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map from items to jobs: missing for some, stale for others; it follows the jobs that exist."""
    c = F.col
    k = c("o_orderkey")
    stale = F.when(k % 17 == 3, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(c("o_orderpriority"), 256))
    return (
        table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").where(k % 19 != 4)
        .join(table(spark, sf_dir, "lineitem", "l_orderkey").distinct(), k == c("l_orderkey"), "left_semi")
        .select(k.alias("desired_work_id"), F.when(k % 23 == 7, k + 1).otherwise(k).alias("job_id"), stale.alias("spec_hash"))
    )
