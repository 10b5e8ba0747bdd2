"""Connected components of an edge table by alternating large-star and small-star steps.

Up to ``LOCAL_EDGES`` edges, which are counted, one task holds them all and finds the same components in memory.
Beyond that every step is a grouped minimum (combined before the shuffle) and a join back to the edges; both
sides of that join are plain tables in the shared folder, so hot nodes can be split.  Nothing
but a change flag reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint_root, delete_path, scratch_path, shuffle_width, ship

#: Steps before giving up; large-star/small-star needs a logarithmic number of them.
MAX_ROUNDS = 60
#: Edges that one file of a step table is meant to hold: few edges make few files and tasks.
FILE_EDGES = 20_000
#: Edges that one task may hold: 16 bytes each, and about ten times that at work.
LOCAL_EDGES = 250_000


class _Tables:
    """Writes step tables and removes those that the next step no longer reads."""

    def __init__(self, spark):
        self.spark, self.paths, self.files = spark, [], shuffle_width(spark)
        checkpoint_root(spark)

    def put(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "star")
        df.coalesce(self.files).write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but(self, last: int) -> None:
        gone, self.paths = self.paths[:-last], self.paths[-last:]
        for path in gone:
            delete_path(self.spark, path)


def _star(edges: DataFrame, large: bool, tables: _Tables) -> DataFrame:
    """One star step on edges (a, b) with a > b."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    low = tables.put(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")))
    linked = both.join(low, "a")
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        out = out.unionByName(low.where(F.col("low") < F.col("a")).select("a", F.col("low").alias("b")))
    else:
        out = linked.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        out = out.unionByName(low.select("a", F.col("low").alias("b")))
    return tables.put(out.where(F.col("a") != F.col("b")).distinct())


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends.reshape(2, -1)
    above = np.arange(len(nodes))
    while True:
        low = np.minimum(above[x], above[y])
        before = above.copy()
        for end in (x, y):  # hook the roots, and then the ends themselves, to the smallest seen
            np.minimum.at(above, above[end], low)
            np.minimum.at(above, end, low)
        while (above != above[above]).any():
            above = above[above]
        if (above == before).all():
            return nodes, nodes[above]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of a counted, small number of edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if parts:
            found = smallest_reached(*map(np.concatenate, zip(*parts, strict=True)))
            yield pa.record_batch([pa.array(c) for c in found], ["node", "component"])

    ship(edges.sparkSession)
    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a long, b long)``.

    The component is its smallest node.  Null ends and loops are ignored; direction and
    repetition don't matter; an empty table gives an empty result.
    """
    tables = _Tables(edges.sparkSession)
    current = tables.put(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    n = current.count()
    if n <= local_edges:
        return _in_one_task(current)
    tables.files = min(tables.files, 1 + n // FILE_EDGES)
    for _ in range(MAX_ROUNDS):
        # A forest of stars: no smaller end of an edge is the larger end of another, and each
        # larger end has one edge.
        state = current.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        many = state.where("n > 1").limit(1).count()
        inner = many or current.join(current.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not inner:
            break
        current = _star(_star(current, True, tables), False, tables)
        tables.drop_all_but(1)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
