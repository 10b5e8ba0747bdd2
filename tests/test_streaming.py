"""Streams give what the batch forms give."""

import os
import random

from pyspark.sql import functions as F

from tidemark.operators import execution as E
from tidemark.operators import keyed as K
from tidemark.streaming import stateful as T


def feed(spark, tmp_path, rows, schema, batches=4):
    size, seen = -(-len(rows) // batches), set()
    for i in range(batches):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for path in (tmp_path / "in").glob("part-*"):
            if path not in seen:  # the source takes files by their times
                os.utime(path, (1_700_000_000 + 10 * i,) * 2)
                seen.add(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(stream, name, mode, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_heartbeats(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(5), i, rng.randrange(30)) for i in range(200)]
    schema = "worker_id long, seq long, hb_seq long"
    got = drain(T.accepted_heartbeats(feed(spark, tmp_path, rows, schema)), "hb", "append", tmp_path)
    want = K.increasing_only(spark.createDataFrame(rows, schema), ["worker_id"], "hb_seq", ["seq"])
    assert sorted(map(tuple, got.select("seq", "accepted").collect())) == sorted(map(tuple, want.select("seq", "accepted").collect()))


def test_anchored_windows(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((("JOB", str(rng.randrange(4)), rng.randrange(1000)) for _ in range(120)), key=lambda r: r[2])
    schema = "scope_type string, scope_id string, observed_at long"
    got = drain(T.anchored_windows(feed(spark, tmp_path, rows, schema), 50), "aw", "update", tmp_path)
    last = {r["scope_id"]: (r["s"], r["n"]) for r in got.groupBy("scope_id").agg(F.max("window_started_at").alias("s"), F.max_by("failure_count", F.struct("window_started_at", "failure_count")).alias("n")).collect()}
    want = K.anchored_window(spark.createDataFrame(rows, schema), ["scope_type", "scope_id"], "observed_at", 50)
    assert last == {r["scope_id"]: (r["window_started_at"], r["failure_count"]) for r in want.collect()}


def test_breaker_machine(spark, tmp_path):
    kinds = [(0, "failure"), (1, "failure"), (2, "failure"), (5, "failure"), (11, "tick"), (12, "tick"), (13, "probe_failure"), (14, "tick"), (15, "probe_success"), (16, "failure")]
    rows = [("JOB", "1", t, k) for t, k in kinds]
    got = drain(T.breaker_machine(feed(spark, tmp_path, rows, "scope_type string, scope_id string, observed_at long, kind string"), 100, 10, 3), "bm", "append", tmp_path)
    assert {r["event"] for r in got.collect()} == {"transition"}
    steps = [(r["at"], r["src"], r["dst"]) for r in got.orderBy("at").collect()]
    assert steps == [(2, "CLOSED", "OPEN"), (12, "OPEN", "HALF_OPEN"), (13, "HALF_OPEN", "OPEN"), (14, "OPEN", "HALF_OPEN"), (15, "HALF_OPEN", "CLOSED")]


def test_stalls(spark, tmp_path):
    schema = "job_id long, t long"
    rows = [(1, 0), (2, 0), (2, 50), (3, 100), (2, 100), (4, 300), (2, 300), (4, 301)]
    stream = feed(spark, tmp_path, rows, schema).select("job_id", F.timestamp_seconds(F.col("t") + 1000).alias("ts"))
    got = drain(T.stalls(stream, "0 seconds", 60_000), "st", "append", tmp_path)
    # Job 2 went on in time, job 4 is still within its threshold when the stream ends.
    assert {(r["job_id"], r["last_progress"]) for r in got.collect()} == {(1, 1_000_000), (3, 1_100_000)}


def test_once_and_buckets(spark, tmp_path):
    rows = [(f"s{i % 5}", i) for i in range(20)]
    stream = feed(spark, tmp_path, rows, "signal_id string, t long").select("signal_id", F.timestamp_seconds("t").alias("ts"))
    got = [r["signal_id"] for r in drain(T.once(stream, "1 hour"), "once", "append", tmp_path).collect()]
    assert sorted(got) == sorted(r["signal_id"] for r in spark.createDataFrame(rows, "signal_id string, t long").select("signal_id").distinct().collect())


def test_probes_are_budgeted(spark, tmp_path):
    kinds = [(0, "probe_request"), (1, "failure"), (2, "failure"), (3, "probe_request"), (13, "probe_request"), (14, "probe_request"), (15, "probe_request"), (16, "probe_failure"), (17, "probe_request"), (18, "probe_success"), (19, "probe_request")]
    rows = [("JOB", "1", t, k) for t, k in kinds]
    got = drain(T.breaker_machine(feed(spark, tmp_path, rows, "scope_type string, scope_id string, observed_at long, kind string"), 100, 10, 2, probes=2), "bp", "append", tmp_path)
    told = [(r["at"], r["event"]) for r in got.where("event <> 'transition'").orderBy("at").collect()]
    assert told == [(0, "allowed"), (3, "denied"), (13, "probe_granted"), (14, "probe_granted"), (15, "denied"), (17, "probe_granted"), (19, "allowed")]


def test_heartbeat_ingest(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), rng.randrange(2), rng.choice([None, 1, 2, 9]), rng.choice([None, 1, 2]), rng.randrange(40)) for i in range(300)]
    schema = "seq long, worker_id long, proc_id long, job_id long, fencing_token long, hb_seq long"
    jobs = spark.createDataFrame([(1, 1, 0), (2, 2, 1)], "job_id long, fencing_token long, owner_worker_id long")
    got = drain(T.ingested_heartbeats(feed(spark, tmp_path, rows, schema), jobs), "hi", "append", tmp_path)
    want = K.ingested(spark.createDataFrame(rows, schema), jobs)
    names = ["seq", "worker_id", "proc_id", "hb_seq", "outcome"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    assert {r["outcome"] for r in got.collect()} == {"fenced", "late", "accepted"}


def test_claim_beats(spark, tmp_path):
    rows = [(1, 0, 0, "beat"), (2, 1, 0, "beat"), (1, 2, 50, "beat"), (2, 3, 50, "withdraw"), (3, 4, 60, "beat"), (3, 5, 60, "clear"), (4, 6, 200, "beat"), (1, 7, 210, "beat"), (5, 8, 500, "beat"), (5, 9, 501, "beat")]
    schema = "worker_id long, seq long, t long, kind string"
    stream = feed(spark, tmp_path, rows, schema, 5).select("worker_id", "seq", F.timestamp_seconds(F.col("t") + 1000).alias("ts"), "kind")
    got = drain(T.claim_beats(stream, "0 seconds", 100_000), "cb", "update", tmp_path).collect()
    last = {}
    for r in got:  # updates come in order for a worker
        last[r["worker_id"]] = r["alive"]
    batch = spark.createDataFrame(rows, schema).select("worker_id", "seq", (F.col("t") * 1_000_000).alias("ts"), "kind")
    want = {r["worker_id"]: r["alive"] for r in E.live_claims(batch, 100_000_000, 501_000_000).collect()}
    assert last == want == {1: False, 2: False, 3: False, 4: False, 5: True}
    assert any(r["worker_id"] == 1 and r["alive"] for r in got)


def test_pressure_buckets_and_late_rows(spark, tmp_path):
    rows = [(i * 2,) for i in range(30)] + [(200,), (201,), (202,), (203,), (204,), (5,), (400,), (401,), (402,), (403,)]  # 5 comes after its window was closed
    stream = feed(spark, tmp_path, rows, "t long", 7).select(F.timestamp_seconds("t").alias("ts"))
    got = drain(T.pressure_buckets(stream, "10 seconds", "30 seconds", 3), "pb", "append", tmp_path)
    counts = {r["bucket"].timestamp() % 86_400: r["pressure"] for r in got.collect()}
    want = {}
    for (t,) in rows[:30]:
        want[t // 30 * 30] = want.get(t // 30 * 30, 0) + 1
    assert want == {0: 15, 30: 15} and sorted(counts.values()) == [5, 15, 15]  # the last window is still open


def test_two_sinks(spark, tmp_path):
    rows = [(i % 2, i, i % 5) for i in range(40)]
    beats = T.accepted_heartbeats(feed(spark, tmp_path, rows, "worker_id long, seq long, hb_seq long"))
    sink = T.split_sink(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "good")), lambda df, _: df.write.mode("append").parquet(str(tmp_path / "bad")))
    beats.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination(120)
    want = {r["seq"]: r["accepted"] for r in K.increasing_only(spark.createDataFrame(rows, "worker_id long, seq long, hb_seq long"), ["worker_id"], "hb_seq", ["seq"]).collect()}
    good, bad = ({r["seq"] for r in spark.read.parquet(str(tmp_path / name)).collect()} for name in ("good", "bad"))
    assert good == {s for s, ok in want.items() if ok} and bad == {s for s, ok in want.items() if not ok}
