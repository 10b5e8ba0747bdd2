"""Staged bytes on a file store, and an append-only log of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canonical import GENESIS
from tidemark.functions.scalar import staged_path
from tidemark.operators.integrity import build_chain
from tidemark.schemas import SCHEMA_VERSION, TABLES


def staged_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """``(path, size, task_id, job_id, attempt, content_hash[, content])`` below ``root/task/job/attempt/hash``.

    Without ``content`` the bytes are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    columns = ["path", F.col("length").alias("size"), staged_path(F.col("path")).alias("_p")]
    return files.select(*columns, *["content"] * content).select("path", "size", "_p.*", *["content"] * content)


def append(rows: DataFrame, root: str, table: str) -> None:
    """Append rows to a logical table, with exactly its columns and types."""
    schema = TABLES[table]
    missing = [f.name for f in schema if not f.nullable and f.name not in rows.columns]
    if missing:
        raise ValueError(f"{table}: columns are missing: {missing}")
    cast = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    rows.select(*cast).write.mode("append").parquet(f"{root}/v{SCHEMA_VERSION}/{table}")


def write_blobs(contents: DataFrame, root: str) -> None:
    """Store contents ``(content)`` under their hashes, each once; those that are there already are left alone.

    A blob is a row of the table ``blobs (content_hash, size, content)``, written by Spark's committer: a job that
    fails leaves nothing that a reader sees.
    """
    spark = contents.sparkSession
    rows = contents.where(F.col("content").isNotNull()).select(F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), F.col("content").cast("binary").alias("content"))
    rows = rows.dropDuplicates(["content_hash"]).select("content_hash", F.octet_length("content").cast("long").alias("size"), "content")
    if _exists(spark, f"{root}/blobs"):
        rows = rows.join(blobs(spark, root).select("content_hash"), "content_hash", "left_anti")
    rows.write.mode("append").parquet(f"{root}/blobs")


def blobs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("content_hash string, size long, content binary").parquet(f"{root}/blobs")


def read_blob(spark: SparkSession, root: str, content_hash: str) -> bytes:
    """The bytes of a hash; missing or changed bytes are an error."""
    row = blobs(spark, root).where(F.col("content_hash") == content_hash).select("content", F.sha2("content", 256).alias("is")).first()
    if row is None or row["is"] != content_hash:
        raise KeyError(f"no intact blob {content_hash}")
    return bytes(row["content"])


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_events(events: DataFrame, root: str, order: list[str]) -> None:
    """Append ``(event_type, payload, actor, ts)`` to the ledger, numbered and chained after its stored tip.

    One writer at a time.  The rows of one call are chained in one task, for each hash needs the one before; the
    hash covers the number, the type, the payload, the actor and the time.
    """
    spark = events.sparkSession
    last = None
    if _exists(spark, f"{root}/v{SCHEMA_VERSION}/ledger"):
        last = read(spark, root, "ledger").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash")).first()
    begin, tip = (last["seq"], last["hash"]) if last and last["seq"] is not None else (0, GENESIS)
    numbered = events.repartition(1).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id() + begin + 1)
    rows = build_chain(numbered.withColumn("body", event_body()), after=tip)
    append(rows.drop("body"), root, "ledger")


def event_body() -> Column:
    """The text that a ledger row's hash covers."""
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("seq", "event_type", "payload", "actor", "ts")]
    return F.concat_ws("|", *[F.concat(F.length(p).cast("string"), F.lit(" "), p) for p in parts])


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{root}/v{SCHEMA_VERSION}/{table}")


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """``(entity, src, dst)`` of a JSON file ``{entity: {state: [states after]}}``."""
    kind = "map<string,map<string,array<string>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    by_entity = text.select(F.explode("m").alias("entity", "graph"))
    by_state = by_entity.select("entity", F.explode("graph").alias("src", "after"))
    return by_state.select("entity", "src", F.explode("after").alias("dst"))
