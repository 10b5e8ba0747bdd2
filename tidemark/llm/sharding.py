"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts are a group.  Groups are items with a vector (bytes, tokens, rows); items
are taken by falling size, and each goes to the shard where the dot product of its vector with
the shard's residual capacity is highest.  Tokens are those of a public vocabulary.

A cluster holds more groups than one machine can place one by one, so groups share an item by
the hash of their text; a group with more than 1/``items`` of all bytes or rows is an item of its
own.  Every group stays whole that a shard can hold; a larger one is dealt over as few items as
it fills shards.  The number of items is bounded by ``items`` whatever the data: only they come to the
driver, and only the map from units to shards goes back.  Rows of an item are numbered in units
of about 1/``items`` of all rows, so no task numbers a large group alone.  Texts are read once and never
shuffled.

Defined results
---------------
* null text: 0 bytes and so size 1, checksum 0; null texts are one group, apart from the empty text
* null ids, equal ids: rows of their own
* empty table: empty result
* other columns are not read
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship, staged
from tidemark.llm.packing import count_ids, tokenizer_path, word_ids

SHARDS = 16
#: Items that groups share; there are fewer than twice as many groups with an item of their own.
ITEMS = 16384


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item: highest dot product with what the shards have left.

    Items are taken by falling largest share of a dimension.  Capacities are equal shares of
    the whole; a shard that is over its share in a dimension has a negative residual there.
    """
    whole = vectors.sum(axis=0).astype(float)
    shares = vectors / np.where(whole > 0, whole, 1)
    left = np.full((shards, shares.shape[1]), 1.0 / shards)
    out = np.empty(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -shares.max(axis=1))):
        out[i] = k = int(np.argmax(left @ shares[i]))
        left[k] -= shares[i]
    return out


ROWS = "id long, size long, text_crc32 long, g1 long, g2 long, tokens long"


def _measured(docs: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """Each row's size, checksum, token count and the hashes of its text, with a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            tokens = [count_ids(text.as_py(), words) for text in batch.column(5)]
            yield pa.record_batch([*batch.columns[:5], pa.array(tokens, pa.int64())], [c.split()[0] for c in ROWS.split(", ")])

    ship(docs.sparkSession)
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")),
        F.xxhash64(text, text.isNull()),
        F.xxhash64(F.lit(7), text, text.isNull()),
        text.cast("binary"),
    )
    return staged(rows.mapInArrow(run, ROWS).withColumn("row", F.monotonically_increasing_id()), "rows")


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, items: int = ITEMS, tokenizer: str | None = None
) -> DataFrame:
    """``(id, size, text_crc32, tokens, shard, slot)`` of every row; slots count from 0 in each shard."""
    spark = docs.sparkSession
    rows = _measured(docs, id_col, text_col, tokenizer or tokenizer_path())
    whole = rows.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not whole["n"]:
        return rows.select("id", "size", "text_crc32", "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    # Groups with more than 1/items of all bytes or rows: fewer than 2 * items.
    large = (
        rows.groupBy("g1", "g2")
        .agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
        .where((F.col("b") > whole["b"] / items) | (F.col("n") > whole["n"] / items))
        .collect()
    )
    own, item_of, unit = [], list(range(items)), items
    for r in sorted(large, key=lambda r: (r["g1"], r["g2"])):
        parts = min(r["n"], math.ceil(shards * max(r["b"] / whole["b"], r["n"] / whole["n"])))
        each = math.ceil(r["n"] * items / (whole["n"] * parts))
        own.append((r["g1"], r["g2"], unit, parts * each))
        first = item_of[-1] + 1
        item_of += [first + k // each for k in range(parts * each)]
        unit += parts * each
    where = spark.createDataFrame(own, "g1 long, g2 long, first long, units long")
    spread = F.col("first") + F.pmod(F.xxhash64("row"), F.col("units"))
    dealt = staged(
        rows.join(F.broadcast(where), ["g1", "g2"], "left").select(
            "id", "size", "text_crc32", "tokens", "row", F.coalesce(spread, F.pmod(F.col("g1"), F.lit(items))).alias("unit")
        ),
        "dealt",
    )
    sums = dealt.groupBy("unit").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).orderBy("unit").collect()  # at most 6 * items rows
    vectors = np.zeros((item_of[-1] + 1, 3))
    np.add.at(vectors, [item_of[r["unit"]] for r in sums], [[r["b"], r["t"], r["n"]] for r in sums])
    shard = place(vectors, shards).tolist()
    offsets, at = [], [0] * shards
    for r in sums:
        k = shard[item_of[r["unit"]]]
        offsets.append((r["unit"], k, at[k]))
        at[k] += r["n"]
    place_of = spark.createDataFrame(offsets, "unit long, shard int, first long")
    return (
        dealt.join(F.broadcast(place_of), "unit")
        .withColumn("slot", F.col("first") + F.row_number().over(Window.partitionBy("unit").orderBy("row")) - 1)
        .select("id", "size", "text_crc32", "tokens", "shard", "slot")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
