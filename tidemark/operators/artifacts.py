"""Content-addressed artifacts, receipts, checkpoints, release blockers and manifests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.operators.breakers import relevant
from tidemark.operators.keyed import digest, latest_per_key

VERIFIED = ("VALIDATED", "RELEASED")


def stagings(staged: DataFrame) -> DataFrame:
    """Provenance: every (artifact, job) once, with its first staging."""
    return staged.groupBy("artifact_id", "job_id").agg(F.min("staged_at").alias("staged_at"))


def artifacts(staged: DataFrame) -> DataFrame:
    """One row for each content: that of its first stager; ties go to the smallest job."""
    picked = staged.groupBy("artifact_id").agg(
        F.min_by(F.struct("job_id", "size"), F.struct("staged_at", "job_id")).alias("r"), F.count_distinct("job_id").alias("stagers")
    )
    return picked.select("artifact_id", F.col("r.job_id").alias("job_id"), F.col("r.size").alias("size"), "stagers")


def observed_bytes(contents: DataFrame) -> DataFrame:
    """``(artifact_id, bytes_hash, byte_len)`` of staged contents ``(artifact_id, content)``, recomputed from the bytes."""
    seen = contents.where(F.col("content").isNotNull()).select("artifact_id", F.sha2(F.col("content").cast("binary"), 256).alias("bytes_hash"), F.octet_length("content").cast("long").alias("byte_len"))
    return seen.groupBy("artifact_id").agg(F.min("bytes_hash").alias("bytes_hash"), F.min("byte_len").alias("byte_len"))


def _names(*problems: Column) -> Column:
    return F.array_compact(F.array(*problems))


def _not(ok: Column, name: str) -> Column:
    """``name`` unless ``ok`` is known to hold."""
    return F.when(~F.coalesce(ok, F.lit(False)), name)


def structural_check(table: DataFrame, held: DataFrame) -> DataFrame:
    """``(artifact_id, problems)``: bytes, recomputed hash against record and identity, size, provenance.

    ``table (artifact_id, content_hash, size, producer)``; ``held`` as ``observed_bytes`` gives it.  A size or hash that
    is not recorded is no problem; the producer must be a JSON object with entries.
    """
    c = F.col
    expected = F.coalesce("content_hash", "artifact_id")
    producer = F.schema_of_variant(F.try_parse_json("producer"))
    found = _names(
        _not(c("bytes_hash") == expected, "hash_mismatch"),
        _not(c("bytes_hash") == c("artifact_id"), "identity_mismatch"),
        _not(c("size").isNull() | (c("size") == c("byte_len")), "size_mismatch"),
        _not(producer.startswith("OBJECT<") & (producer != "OBJECT<>"), "no_provenance"),
    )
    problems = F.when(c("bytes_hash").isNull(), F.array(F.lit("bytes_missing"))).otherwise(found)
    return table.join(held, "artifact_id", "left").select("artifact_id", problems.alias("problems"))


def receipts(validations: DataFrame, quarantined: DataFrame | None = None) -> DataFrame:
    """The latest PASS receipt of each artifact and validator that is not quarantined.

    ``quarantined (validator_id, validator_version)`` takes out every receipt of a validator's version.
    """
    good = validations.where((F.col("result") == "PASS") & ~F.col("quarantined"))
    if quarantined is not None:
        good = good.join(quarantined, ["validator_id", "validator_version"], "left_anti")
    return latest_per_key(
        good.select("artifact_id", "validator_id", "validator_version", "content_hash", "validated_at", "validation_id"),
        ["artifact_id", "validator_id", "validator_version"], ["validated_at", "validation_id"],
    )


def verified_artifacts(table: DataFrame, passes: DataFrame) -> DataFrame:
    """Artifacts whose newest receipt is for exactly their content and whose state is verified."""
    hashes = passes.select("artifact_id", F.col("content_hash").alias("_for"))
    return (
        table.where(F.col("status").isin(*VERIFIED))
        .join(hashes, "artifact_id")
        .where(F.col("_for") == F.col("content_hash"))
        .drop("_for")
    )


def candidate_artifacts(staged: DataFrame, legacy: DataFrame) -> DataFrame:
    """A job's artifacts by staging, then by the row's own job; the first row of each wins."""
    both = staged.withColumn("_o", F.lit(0)).unionByName(legacy.withColumn("_o", F.lit(1)))
    w = Window.partitionBy("job_id", "artifact_id").orderBy("_o")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_o")


#: The validators, as (id, version), whose PASS an artifact needs.
REQUIRED = (("structural", 1),)


def with_evidence(table: DataFrame, held: DataFrame, passes: DataFrame, required=REQUIRED) -> DataFrame:
    """Artifact rows with what is known of them: ``bytes_hash``, ``byte_len``, ``passed`` (hashes by validator).

    ``passes`` has the latest PASS receipt of each artifact, validator and version.  Only required validators
    are kept, so ``passed`` is as long as ``required`` at most.
    """
    wanted = F.lit(False)
    for validator, version in required:
        wanted = wanted | ((F.col("validator_id") == validator) & (F.col("validator_version") == version))
    key = F.concat_ws("/", "validator_id", F.col("validator_version").cast("string"))
    passed = passes.where(wanted).groupBy("artifact_id").agg(F.map_from_entries(F.collect_set(F.struct(key, F.col("content_hash")))).alias("passed"))
    return table.join(held, "artifact_id", "left").join(passed, "artifact_id", "left")


def lacking_receipts(passed: Column, expected: Column, required=REQUIRED) -> list[Column]:
    """For each required validator ``receipt:id/version`` unless it passed exactly the expected content."""
    return [_not(passed[f"{v}/{n}"] == expected, f"receipt:{v}/{n}") for v, n in required]


def verified_rows(known: DataFrame, required=REQUIRED) -> DataFrame:
    """Rows of ``with_evidence`` in a verified state whose bytes and receipts are those of their content."""
    expected = F.coalesce("content_hash", "artifact_id")
    lacking = F.size(_names(*lacking_receipts(F.col("passed"), expected, required)))
    return known.where(F.col("status").isin(*VERIFIED) & (F.col("bytes_hash") == expected) & (lacking == 0))


def completion(jobs: DataFrame, known: DataFrame, candidates: DataFrame, required=REQUIRED) -> DataFrame:
    """``(job_id, status, completion, problems, adoptable)`` of each job.

    ``jobs (job_id, status, result_artifact_id, content_hash)``; ``known`` as ``with_evidence`` gives it;
    ``candidates (job_id, artifact_id)``.  A complete job is COMMITTED without problems, else UNCERTAIN.  Any other
    is UNCERTAIN if it has a verified candidate, which could be adopted, else NOT_COMMITTED.
    """
    c = F.col
    row = known.select(
        c("artifact_id").alias("result_artifact_id"), F.coalesce("content_hash", "artifact_id").alias("_expected"), c("bytes_hash").alias("_bytes"), "passed"
    )
    found = candidates.join(verified_rows(known, required).select("artifact_id"), "artifact_id", "left_semi")
    n = found.groupBy("job_id").agg(F.count_distinct("artifact_id").alias("adoptable"))
    done = c("status") == "COMPLETE"
    has_row = c("_expected").isNotNull()
    integrity = _names(
        _not(c("content_hash").isNotNull(), "no_content_hash"),
        _not(has_row, "artifact_missing"),
        F.when(has_row & c("content_hash").isNotNull(), _not(c("content_hash") == c("_expected"), "content_hash_differs")),
        F.when(has_row, F.when(c("_bytes").isNull(), "bytes_missing").when(c("_bytes") != c("_expected"), "bytes_differ")),
        *[F.when(has_row, problem) for problem in lacking_receipts(c("passed"), c("_expected"), required)],
    )
    problems = F.when(~done, F.array().cast("array<string>")).when(c("result_artifact_id").isNull(), F.array(F.lit("no_artifact"))).otherwise(integrity)
    joined = jobs.join(row, "result_artifact_id", "left").join(n, "job_id", "left").withColumn("problems", problems)
    adoptable = F.when(done, 0).otherwise(F.coalesce("adoptable", F.lit(0))).cast("long")
    outcome = (
        F.when(done, F.when(F.size("problems") == 0, "COMMITTED").otherwise("UNCERTAIN")).when(adoptable > 0, "UNCERTAIN").otherwise("NOT_COMMITTED")
    )
    return joined.select("job_id", "status", outcome.alias("completion"), F.array_join("problems", ",").alias("problems"), adoptable.alias("adoptable"))


def adoptable(staged: DataFrame, jobs: DataFrame) -> DataFrame:
    """Stagings that an uncertain ownerless job may adopt: made under an older token of it."""
    j = jobs.where((F.col("status") == "UNCERTAIN") & F.col("owner_worker_id").isNull()).select("job_id", F.col("fencing_token").alias("_token"))
    return staged.join(j, "job_id").where(F.col("fencing_token") < F.col("_token")).drop("_token")


# ---------------------------------------------------------------- checkpoints


def manifests(entries: DataFrame) -> DataFrame:
    """``(task_id, checkpoint_id, entries)``: the digest of each task's distinct ``(artifact_id, content_hash)``."""
    every = entries.select("task_id", "artifact_id", "content_hash").distinct()
    return digest(every, ["task_id"], F.col("artifact_id"), F.concat_ws(":", "artifact_id", "content_hash")).withColumnRenamed("digest", "checkpoint_id")


#: What may be wrong with an entry of a checkpoint.
ENTRY_PROBLEMS = ("missing", "not_verified", "hash_mismatch", "bytes_missing", "bytes_mismatch", "size_mismatch", "no_receipt")


def verify_checkpoints(checkpoints: DataFrame, entries: DataFrame, known: DataFrame, tip: DataFrame, required=REQUIRED) -> DataFrame:
    """VERIFIED or CORRUPT for each ``(checkpoint_id, task_id)``, with the entries that have each problem.

    ``entries (checkpoint_id, artifact_id, content_hash)`` are the manifests, ``known`` is as ``with_evidence`` gives it, and
    ``tip`` is the one row of ``integrity.tip``.  Every entry needs its artifact in a verified state, with the content
    of the manifest, bytes that hash to it, the recorded size, and the receipts; the id must be the manifest's
    digest, and the log without a gap.
    """
    c = F.col
    entries = entries.select("checkpoint_id", "artifact_id", "content_hash").distinct()  # a manifest is a set
    rows = known.select("artifact_id", c("status").alias("_status"), F.coalesce("content_hash", "artifact_id").alias("_hash"), c("size").alias("_size"), "bytes_hash", "byte_len", "passed")
    judged = entries.join(rows, "artifact_id", "left")
    exists, held = c("_status").isNotNull(), c("bytes_hash").isNotNull()
    wrong = {
        "missing": ~exists,
        "not_verified": exists & ~c("_status").isin(*VERIFIED),
        "hash_mismatch": exists & (c("_hash") != c("content_hash")),
        "bytes_missing": exists & ~held,
        "bytes_mismatch": exists & held & (c("bytes_hash") != c("content_hash")),
        "size_mismatch": exists & held & F.coalesce(c("_size") != c("byte_len"), F.lit(False)),
        "no_receipt": exists & (F.size(_names(*lacking_receipts(c("passed"), c("content_hash"), required))) > 0),
    }
    counts = judged.groupBy("checkpoint_id").agg(F.count(F.lit(1)).alias("entries"), *[F.count_if(wrong[name]).alias(name) for name in ENTRY_PROBLEMS])
    made = digest(entries, ["checkpoint_id"], c("artifact_id"), F.concat_ws(":", "artifact_id", "content_hash")).select("checkpoint_id", c("digest").alias("_made"))
    empty = F.sha2(F.lit(""), 256)
    joined = checkpoints.join(counts, "checkpoint_id", "left").join(made, "checkpoint_id", "left").crossJoin(F.broadcast(tip.select("contiguous")))  # one row
    total = lambda name: F.coalesce(name, F.lit(0)).cast("long")
    id_holds = c("checkpoint_id") == F.coalesce("_made", empty)
    fine = id_holds & c("contiguous")
    for name in ENTRY_PROBLEMS:
        fine = fine & (total(name) == 0)
    return joined.select(
        "checkpoint_id", "task_id", total("entries").alias("entries"), *[total(name).alias(name) for name in ENTRY_PROBLEMS],
        id_holds.alias("id_holds"), c("contiguous").alias("ledger_contiguous"), F.when(fine, "VERIFIED").otherwise("CORRUPT").alias("verification_status"),
    )


def latest_known_good(checkpoints: DataFrame, pointers: DataFrame) -> DataFrame:
    """The pointed-to checkpoint of each task if it is still verified; a pointer never falls back."""
    good = checkpoints.where(F.col("verification_status") == "VERIFIED")
    return pointers.join(good, "checkpoint_id")


def all_pointers(checkpoints: DataFrame, pointers: DataFrame) -> DataFrame:
    """Every pointer with its checkpoint's status, null where it dangles."""
    return pointers.join(checkpoints.select("checkpoint_id", "verification_status"), "checkpoint_id", "left")


# ---------------------------------------------------------------- release

#: States of a task that waits for a human, and categories of what may block a release.
WAITING_TASKS = ("PAUSED_FOR_HUMAN", "MANUAL_REVIEW")
CATEGORIES = (
    "DESIRED_WORK_UNSATISFIED", "ACTIVE_EXECUTION", "UNCERTAIN_EXECUTION", "ACTIVE_RECOVERY", "OPEN_BREAKER", "HUMAN_GATE",
    "MISSING_ARTIFACT", "INVALID_ARTIFACT", "INVALID_CHECKPOINT", "STALE_GENERATION", "CONTRADICTORY_STATE", "CORRUPT_AUTHORITY",
)


Rule = tuple[Column, str, Column, "Column | str"]  # condition, category, identity, detail


def ruled(df: DataFrame, rules: list[Rule], first: int = 0) -> DataFrame:
    """``(category, identity, detail, ord)``: what the rules say of each row, in one pass; ``first`` numbers the first rule."""
    said = []
    for i, (holds, category, identity, detail) in enumerate(rules):
        if category not in CATEGORIES:
            raise ValueError(f"unknown blocker category {category!r}")
        text = detail if isinstance(detail, Column) else F.lit(detail)
        found = F.struct(F.lit(category).alias("category"), identity.cast("string").alias("identity"), text.alias("detail"), F.lit(first + i).alias("ord"))
        said.append(F.when(F.coalesce(holds, F.lit(False)), found))
    return df.select(F.explode(F.array_compact(F.array(*said))).alias("b")).select("b.*")


def blockers(found: list[DataFrame]) -> DataFrame:
    """The union of what rules said, one row for each (category, identity): the first rule's detail wins."""
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.groupBy("category", "identity").agg(F.min_by("detail", F.struct("ord", "detail")).alias("detail"))


@dataclass
class Evidence:
    """What a release is judged by.  Ids are strings or of one type throughout; the one-row tables have one row."""

    generation: str  #: the release's name
    version: int  #: of the declared state that the release is pinned to
    task_id: str  #: the release's own task
    head: DataFrame  #: (version), one row
    items: DataFrame  #: (desired_work_id), none of them retired
    mapping: DataFrame  #: (desired_work_id, job_id)
    jobs: DataFrame  #: (job_id, task_id, status, result_artifact_id, content_hash), all jobs
    tasks: DataFrame  #: (task_id, status)
    artifacts: DataFrame  #: as ``with_evidence`` gives them, with job_id
    spawns: DataFrame  #: (worker_id, proc_id), not reaped
    incidents: DataFrame  #: (incident_id, failure_class), open
    attempts: DataFrame  #: (attempt_id, attempt_state), open
    escalated: DataFrame  #: (incident_id, terminal_state), with the policy's end
    unconsumed: DataFrame  #: (incident_id), with an outcome and a policy that has not ended
    breakers: DataFrame  #: (scope_type, scope_id, state, version, half_open_probes_used)
    checkpoints: DataFrame  #: (checkpoint_id, task_id, canonical_manifest, verification_status, receipt), of the release
    required: tuple = REQUIRED


def relevant_scopes(e: Evidence, work: DataFrame) -> DataFrame:
    """Scopes whose breakers matter: the global one, the release's task, and the items, their jobs and tasks."""
    scope = lambda kind, ident: F.when(F.col(ident).isNotNull(), F.struct(F.lit(kind).alias("scope_type"), F.col(ident).cast("string").alias("scope_id")))
    fixed = e.head.sparkSession.createDataFrame([("GLOBAL", "global"), ("TASK", str(e.task_id))], "scope_type string, scope_id string")
    own = F.array_compact(F.array(scope("DESIRED", "desired_work_id"), scope("JOB", "job_id"), scope("TASK", "task_id")))
    return fixed.unionByName(work.select(F.explode(own).alias("s")).select("s.*")).distinct()


def release_blockers(e: Evidence) -> DataFrame:
    """``(category, identity, detail)`` of all that blocks a release; it is ready if there is nothing."""
    c = F.col
    job = e.jobs.select("job_id", "task_id", c("status").alias("job_status"), "result_artifact_id", c("content_hash").alias("job_hash"), F.lit(True).alias("has_job"))
    task = e.tasks.select("task_id", c("status").alias("task_status"), F.lit(True).alias("has_task"))
    art = e.artifacts.select(
        c("artifact_id").alias("result_artifact_id"), c("job_id").alias("staged_for"), c("content_hash").alias("art_hash"), c("status").alias("art_status"),
        "bytes_hash", "passed", F.lit(True).alias("has_art"),
    )
    mapped = e.items.select("desired_work_id").join(e.mapping.select("desired_work_id", "job_id"), "desired_work_id", "left")
    work = mapped.join(job, "job_id", "left").join(task, "task_id", "left").join(art, "result_artifact_id", "left")
    has = lambda name: F.coalesce(c(name), F.lit(False))
    done = c("job_status") == "COMPLETE"
    says = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    expected = F.coalesce("job_hash", "result_artifact_id")
    flaws = _names(
        _not(c("staged_for") == c("job_id"), "staged for another job"),
        _not(c("art_hash") == expected, "content hash differs from the job's"),
        _not(c("art_status").isin(*VERIFIED), "not verified"),
        F.when(c("bytes_hash").isNull(), "bytes missing").when(c("bytes_hash") != expected, "bytes differ"),
        *lacking_receipts(c("passed"), expected, e.required),
    )
    known = has("has_job")
    cls = P.breaker_class(c("state"), c("version"), c("half_open_probes_used"))
    near = relevant(e.breakers, relevant_scopes(e, work)).withColumn("class", cls).withColumn("scope", F.concat_ws(":", "scope_type", "scope_id"))
    receipt = F.from_json("receipt", "release boolean, checkpoint_id string")
    attested = has("r.release") & F.coalesce(c("r.checkpoint_id") == c("checkpoint_id"), F.lit(False))
    empty = e.items.agg(F.count(F.lit(1)).alias("n"))
    text = lambda name: F.coalesce(c(name).cast("string"), F.lit("-"))
    return blockers([
        ruled(e.head, [(~c("version").eqNullSafe(F.lit(e.version)), "STALE_GENERATION", F.lit(e.generation), says("declared state is at version ", c("version")))]),
        ruled(empty, [(c("n") == 0, "DESIRED_WORK_UNSATISFIED", F.lit(e.generation), "nothing to release")], 1),
        ruled(work.withColumn("flaws", F.when(known & done & has("has_art"), flaws)), [
            (c("job_id").isNull(), "DESIRED_WORK_UNSATISFIED", c("desired_work_id"), "unmapped"),
            (c("job_id").isNotNull() & ~known, "CONTRADICTORY_STATE", c("desired_work_id"), "mapped job is missing"),
            (known & ~done, "DESIRED_WORK_UNSATISFIED", c("job_id"), says("job is ", c("job_status"))),
            (known & (c("job_status") == "BLOCKED"), "HUMAN_GATE", c("job_id"), "job waits for a human"),
            (known & ~has("has_task"), "CONTRADICTORY_STATE", c("job_id"), "task is missing"),
            (known & c("task_status").isin(*WAITING_TASKS), "HUMAN_GATE", c("task_id"), says("task is ", c("task_status"))),
            (known & done & ~has("has_art"), "MISSING_ARTIFACT", c("job_id"), "complete without an artifact"),
            (F.size("flaws") > 0, "INVALID_ARTIFACT", c("result_artifact_id"), F.array_join("flaws", "; ")),
        ], 2),
        ruled(e.jobs, [
            (c("status").isin(*P.ACTIVE, "VERIFYING"), "ACTIVE_EXECUTION", c("job_id"), says("job is ", c("status"))),
            (c("status") == "UNCERTAIN", "UNCERTAIN_EXECUTION", c("job_id"), "job is UNCERTAIN"),
        ], 10),
        ruled(e.spawns, [(F.lit(True), "ACTIVE_EXECUTION", says("spawn:", text("worker_id"), ":", text("proc_id")), "process was never reaped")], 12),
        ruled(e.incidents, [(F.lit(True), "ACTIVE_RECOVERY", c("incident_id"), says("open incident: ", text("failure_class")))], 13),
        ruled(e.attempts, [
            (c("attempt_state").isin("RUNNING", "VERIFYING", "UNCERTAIN"), "ACTIVE_RECOVERY", c("attempt_id"), says("attempt is ", c("attempt_state"))),
            (c("attempt_state") == "UNCERTAIN", "UNCERTAIN_EXECUTION", c("attempt_id"), "attempt is UNCERTAIN"),
        ], 14),
        ruled(e.escalated, [(c("terminal_state").isNull(), "ACTIVE_RECOVERY", c("incident_id"), "escalated, and its policy has not ended")], 16),
        ruled(e.unconsumed, [(F.lit(True), "ACTIVE_RECOVERY", c("incident_id"), "has an outcome, and its policy has not ended")], 17),
        ruled(near, [
            (c("class").isin("open", "half_open"), "OPEN_BREAKER", c("scope"), c("class")),
            (c("class") == "corrupt", "CORRUPT_AUTHORITY", says("breaker:", c("scope")), "breaker cannot be read"),
        ], 18),
        ruled(e.checkpoints.withColumn("r", receipt), [
            (~c("task_id").eqNullSafe(F.lit(e.task_id)), "CONTRADICTORY_STATE", c("checkpoint_id"), "checkpoint belongs to another task"),
            (F.sha2(F.coalesce("canonical_manifest", F.lit("")), 256) != c("checkpoint_id"), "CONTRADICTORY_STATE", c("checkpoint_id"), "checkpoint is not named by its manifest"),
            (c("verification_status") == "CORRUPT", "INVALID_CHECKPOINT", c("checkpoint_id"), "checkpoint is corrupt"),
            ((c("verification_status") == "VERIFIED") & ~attested, "INVALID_CHECKPOINT", c("checkpoint_id"), "verified without attestation"),
        ], 20),
    ])


def manifest_hash(entries: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the digest of a release manifest's entries, and their number."""
    return digest(entries, [], F.col(key), F.concat_ws("=", F.col(key).cast("string"), F.col(value))).withColumnRenamed("digest", "manifest_hash")


def progress_evidence(jobs: DataFrame, table: DataFrame, good: DataFrame) -> DataFrame:
    """Durable progress of each job: its counters, its task's verified artifacts and known-good checkpoint.

    ``table (artifact_id, task_id, status)``; verified means VALIDATED or RELEASED.
    """
    n = table.where(F.col("status").isin(*VERIFIED)).groupBy("task_id").agg(F.count(F.lit(1)).alias("verified_artifacts"))
    known = good.select("task_id", F.col("checkpoint_id").alias("latest_known_good"))
    return jobs.join(n, "task_id", "left").join(known, "task_id", "left").withColumn(
        "verified_artifacts", F.coalesce("verified_artifacts", F.lit(0).cast("long"))
    )


def newest_verified(checkpoints: DataFrame) -> DataFrame:
    """The newest verified checkpoint of each task."""
    good = checkpoints.where(F.col("verification_status") == "VERIFIED")
    return latest_per_key(good.select("task_id", "checkpoint_id", "created_at"), ["task_id"], ["created_at", "checkpoint_id"])


def manifest_drift(pinned: DataFrame, current: DataFrame) -> DataFrame:
    """Entries ``(key, digest)`` that were added, removed or changed since a manifest was pinned."""
    a = pinned.select("key", F.col("digest").alias("_was"), F.lit(True).alias("_in"))
    b = current.select("key", F.col("digest").alias("_is"), F.lit(True).alias("_out"))
    kind = F.when(F.col("_in").isNull(), "added").when(F.col("_out").isNull(), "removed").when(~F.col("_was").eqNullSafe(F.col("_is")), "changed")
    return a.join(b, "key", "full").select("key", kind.alias("drift")).where(F.col("drift").isNotNull())
