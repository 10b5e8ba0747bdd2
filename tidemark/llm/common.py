"""Helpers that the operators share: staged tables, let-bindings, shared folders."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where no folder is named and the master is local, as in tests; removed at exit.
FALLBACK_DIR = f"/tmp/checkpoints/tidemark-{os.getpid()}"

#: Scratch paths that this process made.
_PATHS: list[str] = []

#: The six ASCII white-space characters, x20 and x09 to x0D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Stands in for a null id wherever ids are ordered, so that a null id comes last.
LAST_ID = 9223372036854775807


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, one of its own if all runs in one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = FALLBACK_DIR
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    _PATHS.append(f"{checkpoint_root(spark)}/tidemark-{label}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def staged(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """The place in the list of scratch paths, for ``settled``."""
    return len(_PATHS)


def settled(df: DataFrame, label: str, since: int) -> DataFrame:
    """``staged``, and then remove what only led to it: scratch paths made since the mark, and their shuffle files.

    Spark removes shuffle files once the driver's garbage collector finds their plans gone, so it is called.
    """
    out = staged(df, label)
    spark = df.sparkSession
    for path in _PATHS[since:-1]:
        delete_path(spark, path)
    del _PATHS[since:-1]
    spark.sparkContext._jvm.System.gc()
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the plans made meanwhile."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch path of this process; results that were not written yet are lost."""
    while _PATHS:
        delete_path(spark, _PATHS.pop())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    A lambda variable is never inlined, whereas a projected expression that a lambda uses
    may be evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]


#: Elements that one inner fold appends to; an append copies its list, so lists are kept this short.
FOLD_BLOCK = 256


def fold_map(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """One output for each element of an array, by a running fold, in time that grows with its length.

    ``step(state, item)`` gives a struct ``(state, out)``; ``kind`` is the SQL type of ``out``.  The array is
    folded in blocks, so that outputs are appended to short lists only.
    """

    def over(values: Column, state: Column, advance: Callable[[Column, Column], Column], none: Column) -> Column:
        def put(acc: Column, x: Column) -> Column:
            return let(advance(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

        return F.aggregate(values, F.struct(state.alias("state"), none.alias("out")), put)

    one, many = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    last = F.ceil(F.size(items) / FOLD_BLOCK).cast("int") - 1
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * FOLD_BLOCK + 1, FOLD_BLOCK))
    whole = over(blocks, zero, lambda state, block: over(block, state, step, one), many)["out"]
    return F.when(F.size(items) > 0, F.flatten(whole)).otherwise(one)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are; plain ASCII takes the quick path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def carried(docs: DataFrame, row: str, outputs: list[str]) -> list[Column]:
    """The columns of ``docs`` out of the struct ``row``, but for those that ``outputs`` replace."""
    taken = {name.lower() for name in outputs}
    return [F.col(row)[c].alias(c) for c in docs.columns if c.lower() not in taken]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that Python workers anywhere can import it."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tidemark-")  # read by this driver alone, which serves it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/tidemark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, f"tidemark/{source.relative_to(package)}")
    context.addPyFile(archive)
    context._tidemark_shipped = True
