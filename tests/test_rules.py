"""Decision rules row by row, and the scalable forms against plain Python."""

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.operators import artifacts as A
from tidemark.operators import breakers as B
from tidemark.operators import execution as E
from tidemark.operators import integrity as I
from tidemark.operators import keyed as K
from tidemark.operators import reconcile as C
from tidemark.operators import workload as W
from tidemark.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DATA = "/root/testdata/sf0.01"

#: What every rule of a release says; each has rows in the test tables but for the one of an empty release.
SAYS = {
    "STALE_GENERATION": ["declared state is at version 5"],
    "DESIRED_WORK_UNSATISFIED": ["unmapped", "job is PENDING", "job is BLOCKED", "job is FAILED"],
    "CONTRADICTORY_STATE": ["mapped job is missing", "task is missing", "checkpoint belongs to another task", "checkpoint is not named by its manifest"],
    "HUMAN_GATE": ["job waits for a human", "task is PAUSED_FOR_HUMAN", "task is MANUAL_REVIEW"],
    "MISSING_ARTIFACT": ["complete without an artifact"],
    "INVALID_ARTIFACT": ["staged for another job", "content hash differs from the job's", "not verified", "bytes missing", "bytes differ", "receipt:structural/1"],
    "ACTIVE_EXECUTION": ["job is CLAIMED", "job is RUNNING", "job is COMMITTING", "job is VERIFYING", "process was never reaped"],
    "UNCERTAIN_EXECUTION": ["job is UNCERTAIN", "attempt is UNCERTAIN"],
    "ACTIVE_RECOVERY": ["open incident: ", "attempt is RUNNING", "attempt is VERIFYING", "escalated, and its policy has not ended", "has an outcome, and its policy has not ended"],
    "OPEN_BREAKER": ["open", "half_open"],
    "CORRUPT_AUTHORITY": ["breaker cannot be read"],
    "INVALID_CHECKPOINT": ["checkpoint is corrupt", "verified without attestation"],
}


def test_every_release_rule_has_rows(spark):
    rows = QUERIES["finalization_blockers"](spark, DATA).collect()
    assert set(SAYS) == set(A.CATEGORIES)
    for category, details in SAYS.items():
        own = [r["detail"] for r in rows if r["category"] == category]
        for detail in details:
            assert any(detail in d for d in own), (category, detail)
    assert not any(r["detail"] == "attempt is CREATED" for r in rows)
    assert {r["identity"] for r in rows if r["category"] == "OPEN_BREAKER"}.isdisjoint({"GLOBAL:other"})
    assert len(rows) == len({(r["category"], r["identity"]) for r in rows})


def test_an_empty_release_is_blocked_and_a_clean_one_is_not(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    good = hashlib.sha256(b"c").hexdigest()
    e = A.Evidence(
        generation="g", version=1, task_id="rel", head=frame([(1,)], "version long"), items=frame([("d",)], "desired_work_id string"), mapping=frame([("d", "j")], "desired_work_id string, job_id string"),
        jobs=frame([("j", "t", "COMPLETE", "a", good)], "job_id string, task_id string, status string, result_artifact_id string, content_hash string"), tasks=frame([("t", "FINALIZED")], "task_id string, status string"),
        artifacts=frame([("a", "j", good, "RELEASED", good, {"structural/1": good})], "artifact_id string, job_id string, content_hash string, status string, bytes_hash string, passed map<string,string>"),
        spawns=frame([], "worker_id string, proc_id string"), incidents=frame([], "incident_id string, failure_class string"), attempts=frame([("x", "CREATED")], "attempt_id string, attempt_state string"),
        escalated=frame([("i", "R5_TERMINAL")], "incident_id string, terminal_state string"), unconsumed=frame([], "incident_id string"),
        breakers=frame([("JOB", "other", "OPEN", 1, 0)], "scope_type string, scope_id string, state string, version long, half_open_probes_used long"),
        checkpoints=frame([], "checkpoint_id string, task_id string, canonical_manifest string, verification_status string, receipt string"),
    )
    assert A.release_blockers(e).collect() == []
    e.items = e.items.limit(0)
    assert [tuple(r) for r in A.release_blockers(e).collect()] == [("DESIRED_WORK_UNSATISFIED", "g", "nothing to release")]


def test_checkpoints_show_every_problem(spark):
    rows = QUERIES["checkpoint_verify"](spark, DATA)
    sums = rows.agg(*[F.sum(name).alias(name) for name in A.ENTRY_PROBLEMS], F.count_if(~F.col("id_holds")).alias("id")).first()
    assert all(sums[name] > 0 for name in (*A.ENTRY_PROBLEMS, "id")) and rows.where("verification_status = 'VERIFIED'").count() > 0


def test_a_gap_in_the_log_makes_every_checkpoint_corrupt(spark):
    good = hashlib.sha256(b"c").hexdigest()
    entries = spark.createDataFrame([("t", "a", good)], "task_id string, artifact_id string, content_hash string")
    names = A.manifests(entries).select("task_id", "checkpoint_id")
    known = spark.createDataFrame([("a", "VALIDATED", good, 1, good, 1, {"structural/1": good})], "artifact_id string, status string, content_hash string, size long, bytes_hash string, byte_len long, passed map<string,string>")
    listed = entries.join(names, "task_id").select("checkpoint_id", "artifact_id", "content_hash")
    for seqs, status in (([1, 2, 3], "VERIFIED"), ([1, 3], "CORRUPT"), ([], "VERIFIED")):
        tip = I.tip(spark.createDataFrame([(s,) for s in seqs], "seq long"))
        assert [r["verification_status"] for r in A.verify_checkpoints(names, listed, known, tip).collect()] == [status]
    empty = spark.createDataFrame([("t", hashlib.sha256(b"").hexdigest())], "task_id string, checkpoint_id string")
    assert A.verify_checkpoints(empty, listed.limit(0), known, tip).first()["verification_status"] == "VERIFIED"


def test_completion_shows_every_outcome(spark):
    rows = QUERIES["completion_inspection"](spark, DATA).collect()
    assert {r["completion"] for r in rows if r["status"] == "COMPLETE"} == {"COMMITTED", "UNCERTAIN"}
    assert {r["completion"] for r in rows if r["status"] != "COMPLETE"} == {"UNCERTAIN", "NOT_COMMITTED"}
    said = {p for r in rows for p in r["problems"].split(",")}
    assert said == {"", "no_artifact", "no_content_hash", "artifact_missing", "content_hash_differs", "bytes_missing", "bytes_differ", "receipt:structural/1"}
    found = {p for r in QUERIES["structural_check"](spark, DATA).collect() for p in r["problems"].split(",")}
    assert found == {"", "bytes_missing", "hash_mismatch", "identity_mismatch", "size_mismatch", "no_provenance"}


@pytest.mark.parametrize("text, fine", [('{"1":2}', True), ("{}", True), ('{" 2 ":0}', True), ('{"0":1}', False), ('{"a":1}', False), ('{"1":-1}', False), ('{"1":true}', False), ('{"1":"2"}', False), ('{"1":1.5}', False), ('{"1":null}', False), ("[]", False), ("1", False), ('{"1":2', False), (None, False)])
def test_rung_maps(spark, text, fine):
    assert spark.createDataFrame([(text,)], "t string").select(P.rung_map(F.col("t"))).first()[0] is fine


def revoked(spawn, events):
    """The plain form: events of the job with a later time, in the order of their numbers."""
    own = 0
    for seq, kind, job, worker, prev, ts in sorted(events):
        if job != spawn["job"] or ts <= spawn["ts"]:
            continue
        if kind == "job.lease_reclaimed":
            if prev == spawn["worker"]:
                return seq, "reclaimed"
        elif worker != spawn["worker"]:
            return seq, "claimed_by_other"
        else:
            own += 1
            if own == 2:
                return seq, "claimed_again"
    return None, None


def test_revocations_against_a_loop(spark):
    rng = random.Random(31)
    spawns = [(i, rng.choice([1, 2, 3, None]), rng.randrange(4), rng.randrange(6), rng.randrange(40)) for i in range(300)]
    events = []
    for seq in range(400):  # times don't follow the numbers, and come more than once
        reclaim = rng.random() < 0.2
        who = rng.choice([1, 1, 2, 3, None])
        events.append((seq, "job.lease_reclaimed" if reclaim else "job.claimed", rng.randrange(6), None if reclaim else who, who if reclaim else None, rng.randrange(40)))
    a = spark.createDataFrame(spawns, "seq long, worker_id long, proc_id long, job_id long, ts long")
    b = spark.createDataFrame(events, "seq long, event_type string, job_id long, worker_id long, prev_owner long, ts long")
    got = {r["spawn_seq"]: (r["revoked_seq"], r["revoked_by"], r["revoked_ts"]) for r in E.revocations(a, b).collect()}
    times = {e[0]: e[5] for e in events}
    for seq, worker, _, job, ts in spawns:
        found, why = revoked({"worker": worker, "job": job, "ts": ts}, events)
        assert got[seq] == (found, why, times.get(found))


def test_anchored_windows_against_a_loop(spark):
    rng = random.Random(32)
    rows = [("GLOBAL", None, rng.randrange(100_000)) for _ in range(3000)] + [(rng.choice("ab"), str(rng.randrange(5)), rng.choice([None, rng.randrange(5000)])) for _ in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r["k"], r["s"]): (r["window_started_at"], r["failure_count"], r["peak"]) for r in K.anchored_window(spark.createDataFrame(rows, "k string, s string, ts long"), ["k", "s"], "ts", 300).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key in {r[:2] for r in rows}:
        times = sorted(r[2] for r in rows if r[:2] == key and r[2] is not None)
        start, n, peak = None, 0, 0
        for t in times:
            if start is None or t - start > 300:
                start, n = t, 0
            n += 1
            peak = max(peak, n)
        if times:
            want[key] = (start, n, peak)
    assert got == want
    assert K.anchored_window(spark.createDataFrame([], "k string, ts long"), ["k"], "ts", 5).collect() == []


def test_digests_don_t_depend_on_order(spark):
    rows = [(str(i), f"v{i}") for i in range(500)] + [("7", "v7")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ranges = {}
    for k, h in sorted((sha(k), sha(v)) for k, v in rows):
        ranges.setdefault(k[:1], []).append(h)
    want = sha("".join(sha("".join(ranges[r])) for r in sorted(ranges)))
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        found = K.digest(spark.createDataFrame(rows, "k string, v string").repartition(seed + 1), [], F.col("k"), F.col("v"), digits=1).first()
        assert (found["digest"], found["entries"]) == (want, 501)
    none = K.digest(spark.createDataFrame([], "k string, v string"), [], F.col("k"), F.col("v")).first()
    assert (none["digest"], none["entries"]) == (sha(""), 0)


def test_admission_against_a_loop(spark):
    rng = random.Random(33)
    names = [("TASK", "a"), ("TASK", "b"), ("JOB", "c"), ("DESIRED", "d"), ("GLOBAL", "e"), ("TASK", "f")]
    state = dict(zip(names, ["HALF_OPEN", "HALF_OPEN", "HALF_OPEN", "OPEN", "CLOSED", "HALF_OPEN"], strict=True))
    used = {n: int(n[1] == "f") for n in names}
    jobs = [(i, rng.randrange(30)) for i in range(80)]
    scopes = [(i, *s) for i, _ in jobs for s in rng.sample(names, rng.choice([0, 0, 1, 2, 3]))]
    breakers = spark.createDataFrame([(*n, state[n], 1, used[n]) for n in names], "scope_type string, scope_id string, state string, version long, half_open_probes_used long")
    for room, probes in ((80, 1), (80, 3), (12, 2), (3, 1), (0, 1)):
        taken, want = dict(used), []
        for i, at in sorted(jobs, key=lambda j: (j[1], j[0])):
            own = [(t, s) for j, t, s in scopes if j == i]
            half = [n for n in own if state[n] == "HALF_OPEN"]
            if len(want) < room and all(state[n] != "OPEN" for n in own) and all(taken[n] < probes for n in half):
                for n in half:
                    taken[n] += 1
                want.append(i)
        got = C.admissions(spark.createDataFrame(jobs, "job_id long, created_at long"), breakers, spark.createDataFrame(scopes, "job_id long, scope_type string, scope_id string"), 0, room, 100, probes)
        assert [r["job_id"] for r in got.orderBy("rank").collect()] == want


def test_readiness(spark):
    frame = spark.range(3)
    assert W.when_ready({"boot": lambda: True}, lambda: frame).count() == 3
    with pytest.raises(W.NotReady) as why:
        W.when_ready({"boot": lambda: True, "lease": lambda: False, "odd": lambda: 1, "broken": lambda: 1 / 0}, lambda: frame)
    assert why.value.reasons == ["lease", "odd", "broken (division by zero)"]


def test_adapter(spark):
    claimed = spark.createDataFrame([(1, 3, "x"), (2, 4, "y")], "job_id long, fencing_token long, payload string")

    def upper(part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(payload=part["payload"].str.upper())

    made = W.adapted(claimed, upper, "job_id long, fencing_token long, payload string")
    now = spark.createDataFrame([(1, 3), (2, 5)], "job_id long, fencing_token long")
    assert [tuple(r) for r in W.committable(made, now).collect()] == [(1, 3, "X")]


def test_behaviours(spark):
    rows = spark.createDataFrame([(1, "success_delayed", 2), (2, "controlled_failure", 4), (3, "wedged", 9)], "job_id long, kind string, steps int")
    got = {}
    for r in W.behaviour_log(spark, rows).orderBy("job_id", "n").collect():
        got.setdefault(r["job_id"], []).append(r["event"])
    assert got == {1: ["claimed", "heartbeat", "progress", "heartbeat", "progress", "committed"], 2: ["claimed", *["heartbeat", "progress"] * 3, "failed"], 3: ["claimed", "heartbeat"]}
    for bad in ((1, "odd", 2), (1, "crash", 0), (1, None, 1)):
        with pytest.raises(Exception, match="no such behaviour"):
            W.behaviour_log(spark, spark.createDataFrame([bad], "job_id long, kind string, steps int")).collect()


def test_listed_breakers_are_in_order(spark):
    rows = spark.createDataFrame([("TASK", "2"), ("JOB", "9"), ("TASK", "10")], "scope_type string, scope_id string")
    assert [tuple(r) for r in B.listed(rows).collect()] == [("JOB", "9"), ("TASK", "10"), ("TASK", "2")]
