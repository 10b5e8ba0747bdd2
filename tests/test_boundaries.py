"""Boundary rules at one tick below, at, and above; nulls; folds against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
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
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

NOW = 1_000_000


def column(spark, values, kind="long"):
    return spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}")


def values(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize(
    ("rule", "expected"),
    [
        (lambda v: P.lease_expired(v, NOW), [True, True, False, False]),
        (lambda v: P.lease_live(v, NOW), [False, False, True, False]),
        (lambda v: P.may_renew(v, NOW), [False, False, True, True]),
        (lambda v: P.cooldown_over(v, NOW), [True, True, False, False]),
        (lambda v: P.still_observing(v, NOW), [False, False, True, False]),
        (lambda v: P.is_stale(v - 10, 10, NOW), [True, False, False, False]),
        (lambda v: P.beat_live(v - 10, 10, NOW), [False, True, True, False]),
        (lambda v: P.window_over(NOW, v - 10, 10), [True, False, False, True]),
        (lambda v: P.claim_is_stale(v - 10, 10, NOW), [True, False, False, True]),
    ],
)
def test_boundaries(spark, rule, expected):
    assert values(column(spark, [NOW - 1, NOW, NOW + 1, None]), rule(F.col("v"))) == expected


@pytest.mark.parametrize("bad", [0, -1, float("nan"), True, "5", None])
def test_durations_are_checked(bad):
    with pytest.raises(ValueError):
        P.seconds(bad)
    assert P.seconds(1.5) == 1_500_000


def test_fence_failure_precedence(spark):
    rows = spark.createDataFrame([(0, 1, 5, NOW + 1), (1, 2, 5, NOW + 1), (2, 1, 4, NOW), (3, 1, 5, NOW), (4, None, 5, NOW + 1)], "i long, o long, t long, l long")
    assert values(rows, P.fence_failure(F.col("o"), F.col("t"), F.col("l"), 1, 5, NOW)) == [None, "not_owner", "stale_token", "lease_expired", "not_owner"]


def test_breaker_class(spark):
    rows = spark.createDataFrame([(0, "OPEN", 1, 0), (1, "HALF_OPEN", 1, 0), (2, "CLOSED", 1, 0), (3, "X", 1, 0), (4, "OPEN", None, 0), (5, None, 1, 0)], "i long, s string, v long, p long")
    assert values(rows, P.breaker_class(F.col("s"), F.col("v"), F.col("p"))) == ["open", "half_open", "closed", "corrupt", "corrupt", "corrupt"]


def test_probe_parts_and_first_set(spark):
    rows = column(spark, ["w:j", "w", "w:", ":j", "a:b:c", None], "string")
    assert values(rows, S.probe_parts(F.col("v"))["job_id"]) == ["j", None, None, None, None, None]
    assert values(column(spark, [0, 5, None]), S.first_set(F.col("v"), F.lit(7))) == [7, 5, 7]


def test_anchored_window_edges(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 10, 11, 21, 22)] + [("b", 5)], "k string, t long")
    got = {r["k"]: (r["window_started_at"], r["failure_count"], r["peak"]) for r in K.anchored_window(rows, ["k"], "t", 10).collect()}
    assert got == {"a": (22, 1, 2), "b": (5, 1, 1)}


def test_folds_equal_python(spark):
    rng, rows, runs, zeros = random.Random(3), [], {}, {}
    for key in range(200):
        numbers = sorted(rng.sample(range(1, 12), rng.randint(1, 8)))
        history = [(n, rng.choice(["FAILED", "BLOCKED", "SUCCEEDED"]), rng.choice([0.0, 1.0, -1.0])) for n in numbers]
        rows += [(key, *h) for h in history]
        by, n, run = {h[0]: h for h in history}, max(numbers), 0
        while n in by and by[n][1] != "SUCCEEDED":
            run, n = run + 1, n - 1
        zero = 0
        for _, _, d in history:
            zero = 0 if d > 0 else zero + 1
        runs[key], zeros[key] = run, zero
    df = spark.createDataFrame(rows, "k long, n long, s string, d double")
    assert {r["k"]: r["run"] for r in K.trailing_run(df, "k", "n", F.col("s").isin("FAILED", "BLOCKED")).collect()} == runs
    assert {r["k"]: r["zero_progress"] for r in K.since_progress(df, "k", "n", "d").collect()} == zeros


def test_heartbeats_in_order(spark):
    rows = spark.createDataFrame([(0, "w", 1), (1, "w", 2), (2, "w", 2), (3, "w", 1), (4, "w", 3)], "i long, w string, h long")
    assert values(K.increasing_only(rows, ["w"], "h", ["i"]), F.col("accepted")) == [True, True, False, False, True]


def test_without_matches_nulls(spark):
    left = spark.createDataFrame([(1, None), (2, 1)], "a long, b long")
    right = spark.createDataFrame([(1, None)], "a long, b long")
    assert [r["a"] for r in K.without(left, right, ["a", "b"]).collect()] == [2]


def test_rung_ladder(spark):
    names = "rung attempts_at_rung attempts zero available contradictory blocked executable".split()
    cases = [
        ((5, 0, 0, 0, True, False, False, True), (5, "R5_TERMINAL", False)),
        ((1, 0, 0, 0, False, True, False, True), (5, "BLOCKED_STATE_UNAVAILABLE", True)),
        ((1, 0, 0, 0, True, True, False, True), (5, "BLOCKED_CONTRADICTORY", True)),
        ((1, 0, 7, 0, True, False, False, True), (5, "BUDGET_EXHAUSTED", True)),
        ((1, 0, 2, 2, True, False, False, True), (2, None, True)),
        ((3, 3, 3, 0, True, False, False, True), (4, None, True)),
        ((4, 0, 3, 0, True, False, False, True), (5, "R5_TERMINAL", True)),
        ((2, 0, 3, 0, True, False, True, False), (3, None, True)),
        ((2, 0, 3, 0, True, False, True, True), (2, None, False)),
    ]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i long, rung int, attempts_at_rung long, attempts long, zero long, available boolean, contradictory boolean, blocked boolean, executable boolean")
    got = values(df, R.rung_decision(*[F.col(n) for n in names]))
    assert [(g["rung"], g["terminal"], g["advanced"]) for g in got] == [c[1] for c in cases]


def _chain(spark, n=40):
    bodies = spark.range(1, n + 1).select(F.col("id").alias("seq"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("body"))
    return I.build_chain(bodies)


def test_chain_attacks(spark):
    log = _chain(spark)
    assert I.first_failure(log).count() == 0
    changed = log.withColumn("body", F.when(F.col("seq") == 9, "x").otherwise(F.col("body")))
    assert I.first_failure(changed).first().asDict() == {"seq": 9, "problem": "hash_mismatch"}
    cut = log.where("seq <> 9")
    assert I.first_failure(cut).first().asDict() == {"seq": 10, "problem": "prev_hash_mismatch"}
    swapped = log.withColumn("seq", F.when(F.col("seq") == 9, 10).when(F.col("seq") == 10, 9).otherwise(F.col("seq")))
    assert I.first_failure(swapped).first()["seq"] == 9
    assert I.first_failure(log.where("seq < 30")).count() == 0  # a cut tail cannot be seen
    assert I.first_failure(log.where("seq > 1")).first().asDict() == {"seq": 2, "problem": "prev_hash_mismatch"}
    assert I.tip(log).first()["tip_seq"] == 40 and I.tip(cut).first()["contiguous"] is False


def test_diff_verdicts(spark):
    desired = spark.createDataFrame(
        [(1, 1, 1, "h", True), (2, 2, 9, "h", False), (3, 3, 1, "h", False), (4, 4, 1, "h", False), (5, 5, 1, "h", False), (6, 6, 1, None, False), (7, 7, 1, "h", False), (8, 8, 1, "h", False), (9, 9, 1, "h", False)],
        "desired_work_id long, canonical_job_id long, task_id long, spec_hash string, retired boolean",
    )
    mapping = spark.createDataFrame([(3, 3, "h"), (5, 6, "h"), (6, 6, "h"), (7, 7, "old"), (8, 8, "h"), (9, 9, "h")], "desired_work_id long, job_id long, spec_hash string")
    jobs = spark.createDataFrame([(4, "PENDING"), (5, "PENDING"), (6, "PENDING"), (7, "PENDING"), (8, "QUARANTINED"), (9, "UNCERTAIN")], "job_id long, status string")
    tasks = spark.createDataFrame([(1,)], "task_id long")
    got = {r["desired_work_id"]: r["verdict"] for r in C.diff(desired, mapping, jobs, tasks).collect()}
    assert got == {1: "OBSOLETE", **dict.fromkeys((2, 3, 4, 5, 6, 7, 8), "CONTRADICTORY"), 9: "DESIRED_UNCERTAIN"}


def test_admission_probes(spark):
    jobs = spark.createDataFrame([(1, 7, 10), (2, 7, 11), (3, 8, 12), (4, 9, 13), (5, 6, 14)], "job_id long, task_id long, created_at long")
    breakers = spark.createDataFrame([("TASK", "7", "HALF_OPEN", 1, 0), ("TASK", "8", "OPEN", 1, 0), ("TASK", "9", "X", 1, 0)], "scope_type string, scope_id string, state string, version long, half_open_probes_used long")
    scopes = jobs.select("job_id", F.lit("TASK").alias("scope_type"), F.col("task_id").cast("string").alias("scope_id"))
    assert [r["job_id"] for r in C.admissions(jobs, breakers, scopes, 0, 10, 10).orderBy("rank").collect()] == [1, 5]
    assert C.admissions(jobs, breakers, scopes, 10, 10, 10).count() == 0


def test_admission_fold(spark):
    jobs = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, 13)], "job_id long, created_at long")
    breakers = spark.createDataFrame([("TASK", "a", "HALF_OPEN", 1, 0), ("JOB", "b", "HALF_OPEN", 1, 0)], "scope_type string, scope_id string, state string, version long, half_open_probes_used long")
    scopes = spark.createDataFrame([(1, "TASK", "a"), (2, "TASK", "a"), (2, "JOB", "b"), (3, "JOB", "b"), (4, "TASK", "z")], "job_id long, scope_type string, scope_id string")
    got = C.admissions(jobs, breakers, scopes, 0, 10, 10).orderBy("rank").collect()
    assert [r["job_id"] for r in got] == [1, 3, 4]
    assert [r["job_id"] for r in C.admissions(jobs, breakers, scopes, 8, 10, 10).collect()] == [1, 3]


def test_migrate(spark):
    old = spark.createDataFrame([("w", "IDLE")], "name string, status string")
    upgrades = {(0, "workers"): lambda df: df.withColumnRenamed("name", "worker_id")}
    assert D.migrate(old, "workers", 0, upgrades, 1).first().asDict() == {"worker_id": "w", "status": "IDLE", "last_seen_at": None}
    with pytest.raises(ValueError):
        D.migrate(old, "workers", 1, upgrades, 1)


def test_blockers_first_detail_wins(spark):
    one = spark.createDataFrame([("1",)], "x string")
    yes = F.lit(True)
    got = A.blockers([A.ruled(one, [(yes, "HUMAN_GATE", F.col("x"), "second")], 1), A.ruled(one, [(yes, "HUMAN_GATE", F.col("x"), "first")])]).collect()
    assert [tuple(r) for r in got] == [("HUMAN_GATE", "1", "first")]
    with pytest.raises(ValueError):
        A.ruled(one, [(yes, "NO_SUCH", F.col("x"), "")])


def test_receipts_rules(spark):
    rows = spark.createDataFrame(
        [(1, "a", "v", "1", "PASS", False, "h", 5), (2, "a", "v", "1", "FAIL", False, "h", 9), (3, "b", "v", "1", "PASS", True, "h", 5), (4, "c", "v", "2", "PASS", False, "other", 5)],
        "validation_id long, artifact_id string, validator_id string, validator_version string, result string, quarantined boolean, content_hash string, validated_at long",
    )
    passes = A.receipts(rows)
    assert {r["artifact_id"] for r in passes.collect()} == {"a", "c"}
    table = spark.createDataFrame([("a", "VALIDATED", "h"), ("c", "RELEASED", "h")], "artifact_id string, status string, content_hash string")
    assert [r["artifact_id"] for r in A.verified_artifacts(table, passes).collect()] == ["a"]


def test_shortest_path(spark):
    assert G.shortest_path(spark, "worker", "PROVISIONING", "DEAD") == ["PROVISIONING", "DEAD"]
    assert G.shortest_path(spark, "worker", "IDLE", "DEAD") == ["IDLE", "ASSIGNED", "SUSPECT", "DEAD"]
    assert G.shortest_path(spark, "worker", "DEAD", "IDLE") is None
    assert G.shortest_path(spark, "worker", "IDLE", "IDLE") == ["IDLE"]


def test_lingering_generation(spark):
    spawns = spark.createDataFrame([(1, "w", "p", 1), (5, "w", "q", 5)], "seq long, worker_id string, proc_id string, ts long")
    reaps = spark.createDataFrame([(3, "w", "p", 3)], "seq long, worker_id string, proc_id string, ts long")
    assert E.latest_generation(spawns, reaps).first()["reap_seq"] is None
    assert [r["proc_id"] for r in E.unreaped_spawns(spawns, reaps).collect()] == ["q"]


def test_signals_fan_out_once(spark):
    rows = spark.createDataFrame([("R7_DEAD", 1, None, 1, None, 10, True), ("R7_DEAD", 1, None, 1, None, 12, True), ("R7_DEAD", 2, None, None, 3, 10, True)], "failure_kind string, incident_id long, attempt_id long, job_id long, task_id long, observed_at long, windowed boolean")
    got = sorted(r["signal_id"] for r in B.signals(rows, 20, 100).collect())
    assert got == ["GLOBAL:GLOBAL:R7_DEAD:1:-", "JOB:1:R7_DEAD:1:-"]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "job_id long, task_id long, status string, owner_worker_id long, fencing_token long, lease_acquired_at long, lease_expires_at long, created_at long")
    assert E.expired_leases(empty, NOW).count() == 0 and E.capacity(empty, 5).first()["free"] == 5
    assert E.jobs_in(empty, []).count() == 0 and E.pending(empty, 0).count() == 0


@pytest.mark.parametrize("ids", [[], [4], range(50), range(70), range(90), range(110), range(1010), [None, 3, None, 1], [None, *range(89)]], ids=len)
def test_sample_size_and_null_ids_as_in_sql(spark, tmp_path, ids):
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(QUERIES["seeded_sample"](spark, str(tmp_path)), ORACLES["seeded_sample"], tmp_path)


@pytest.mark.parametrize(("n", "rate", "k"), [(10, 0.05, 1), (30, 0.05, 2), (50, 0.29, 15), (5, 1.0, 5), (5, 3.0, 5), (9, 0.05, 1)])
def test_sample_size_rounds_halves_up(spark, n, rate, k):
    assert S.seeded_sample(spark.range(n), "id", rate, "s").count() == k
