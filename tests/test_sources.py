import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical_json, canonical_text, link_hash
from tidemark.functions.scalar import readable_json, sha256_hex, tagged_id
from tidemark.operators.integrity import orphan_files
from tidemark.sources.catalog import Store
from tidemark.operators.integrity import build_chain, chain_failures, tip
from tidemark.sources.staging import append, append_events, blobs, event_body, read, read_blob, read_graphs, staged_files, write_blobs

SMALL = "/root/testdata/sf0.001"


def test_store(spark, tmp_path):
    store = Store.open(spark, SMALL)
    assert "orders" in store.tables()
    assert store.query("SELECT count(*) AS n FROM nation WHERE n_regionkey = :r", r=1).first()["n"] == 5
    assert store.get("region", "r_regionkey", 0)["r_regionkey"] == 0
    with pytest.raises(KeyError):
        store.get("region", "r_regionkey", -1)
    with pytest.raises(ValueError):
        store.query("DROP TABLE nation")
    store.snapshot(str(tmp_path), ["region"])
    assert spark.read.parquet(f"{tmp_path}/region.parquet").count() == store.table("region").count()


def test_staged_files(spark, tmp_path):
    for name in ("t1/j1/1/aaa", "t1/j2/1/bbb"):
        path = tmp_path / name
        path.parent.mkdir(parents=True)
        path.write_bytes(b"content")
    files = staged_files(spark, str(tmp_path))
    assert {(r["job_id"], r["content_hash"], r["size"]) for r in files.collect()} == {("j1", "aaa", 7), ("j2", "bbb", 7)}
    known = spark.createDataFrame([("aaa",)], "artifact_id string")
    assert [r["content_hash"] for r in orphan_files(files, known).collect()] == ["bbb"]


def test_append_and_read(spark, tmp_path):
    rows = spark.createDataFrame([("w1", "RUNNING")], "worker_id string, status string")
    append(rows, str(tmp_path), "workers")
    append(rows, str(tmp_path), "workers")
    assert read(spark, str(tmp_path), "workers").count() == 2
    with pytest.raises(ValueError):
        append(rows.drop("status"), str(tmp_path), "workers")


def test_graph_file(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"x": {"A": ["B", "C"], "B": []}}))
    assert sorted(map(tuple, read_graphs(spark, str(path)).collect())) == [("x", "A", "B"), ("x", "A", "C")]


def test_canonical(spark):
    texts = ['{"b": 1, "a": [1.5, null, 1700000000.123]}', "{bad", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, v string")
    got = [r[0] for r in df.orderBy("i").select(canonical_json("v")).collect()]
    assert got == ['{"a":[1.5,null,1700000000.123],"b":1}', None, None]
    assert canonical_text({"b": 1, "a": None}) == '{"a":null,"b":1}'
    assert [r[0] for r in df.orderBy("i").select(readable_json(F.col("v"))).collect()] == [True, False, False]
    one = spark.range(1).select(sha256_hex(F.lit("a:b")), tagged_id("p-", "t:", F.lit("1"))).first()
    assert one[0] == link_hash("a", "b") and one[1].startswith("p-") and len(one[1]) == 34


def test_blobs(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),), (None,)], "content binary")
    write_blobs(rows, root)
    write_blobs(spark.createDataFrame([(bytearray(b"two"),), (bytearray(b""),)], "content binary"), root)
    held = {r["content_hash"]: (bytes(r["content"]), r["size"]) for r in blobs(spark, root).collect()}
    assert blobs(spark, root).count() == 3 and {v for v in held.values()} == {(b"one", 3), (b"two", 3), (b"", 0)}
    assert all(read_blob(spark, root, h) == content for h, (content, _) in held.items())
    with pytest.raises(KeyError):
        read_blob(spark, root, "0" * 64)


def test_appended_events_are_chained(spark, tmp_path):
    root = str(tmp_path)
    schema = "event_type string, payload string, actor string, ts long"
    append_events(spark.createDataFrame([("a", "{}", "x", 3), ("b", None, "x", 1), ("c", "{}", "y", 2)], schema).repartition(3), root, ["ts"])
    append_events(spark.createDataFrame([], schema), root, ["ts"])
    append_events(spark.createDataFrame([("d", "{}", "x", 9), ("e", "{}", "x", 8)], schema), root, ["ts"])
    log = read(spark, root, "ledger").withColumn("body", event_body())
    assert [r["event_type"] for r in log.orderBy("seq").collect()] == list("bcaed")
    assert chain_failures(log).count() == 0 and tip(log).first()["contiguous"] and tip(log).first()["tip_seq"] == 5
    assert build_chain(log.select("seq", "body")).where("seq = 5").first()["hash"] == tip(log).first()["tip_hash"]
    assert chain_failures(log.withColumn("body", F.when(F.col("seq") == 2, "x").otherwise(F.col("body")))).count() == 1
