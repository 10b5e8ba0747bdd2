"""A data directory as a read-only store: views, SQL text with parameters, point lookups, snapshots."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class Store:
    """Tables of a folder as temporary views; nothing here writes to the folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, path: str, names: list[str] | None = None) -> Store:
        store = cls(spark, path)
        for name in names if names is not None else store.tables():
            store.table(name).createOrReplaceTempView(name)
        return store

    def tables(self) -> list[str]:
        """Names of the parquet tables that the folder holds, by Hadoop's file system."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [status.getPath().getName() for status in system.listStatus(folder)]
        return sorted(os.path.splitext(n)[0] for n in found if n.endswith(".parquet"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def query(self, sql: str, **parameters) -> DataFrame:
        """A SELECT (or WITH) over the views; parameters are named ``:name`` in the text."""
        if sql.lstrip().split(None, 1)[0].upper() not in ("SELECT", "WITH", "VALUES", "FROM", "TABLE"):
            raise ValueError("the store is read-only: only queries are accepted")
        return self.spark.sql(sql, args=parameters)

    def get(self, name: str, column: str, key) -> dict:
        """The one row of a key; a missing row is an error."""
        row = self.table(name).where(F.col(column) == F.lit(key)).first()
        if row is None:
            raise KeyError(f"{name}.{column} = {key!r}")
        return row.asDict(recursive=True)

    def snapshot(self, target: str, names: list[str] | None = None) -> None:
        """Copy tables to another folder; a table that is there already is an error."""
        for name in names if names is not None else self.tables():
            self.table(name).write.mode("errorifexists").parquet(f"{target}/{name}.parquet")
