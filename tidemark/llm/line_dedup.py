"""Line dedup by levelled sorted runs of line hashes.

An index of line keys is kept as *runs*: bucketed tables of ``(h1, h2, first)``, sorted by hash
within each bucket, where ``first`` is the smallest document id that holds the key.  Batches of
documents arrive in the order of their ids.  The keys of a batch are anti-joined with every run
by a merge join (equal bucketing on both sides, so no run is shuffled again); what is left is
new and becomes a run of level 0.  When a level holds ``fanout`` runs they are merged, bucket by
bucket and without a shuffle, into one run of the next level, so a key is rewritten a logarithmic
number of times.  An index kept at a ``root`` meets the batches of later calls.

A line is dropped if the run index says that a smaller id holds its key.

Defined results
---------------
* null or empty text: one empty line, never dropped (its key is shorter than ``min_key``)
* null id: ranks after every other id
* equal ids: rows of one id are one document; none of them drops the other's lines
* empty table: empty result
* other columns pass through ``dedup_lines`` untouched; one named like an output gives way to it
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LAST_ID, SPACE_CHARS, ascii_lower, carried, delete_path, let, path_exists, scratch_path, setting, shuffle_width, staged

#: Keys with fewer code points are never dropped.
MIN_KEY = 10
#: Batches that one call makes of its documents.
BATCHES = 4
#: Runs that a level holds before they are merged into one of the next level.
FANOUT = 2


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


#: Lets a scan of a run with one file a bucket say that it is sorted, so that joins don't sort it again.
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """The levelled index: ``levels[i]`` lists the tables of level ``i``, oldest first.

    With ``root`` the runs are kept there, and ``LineRuns.open`` finds them again in another session.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT, root: str | None = None):
        self.spark, self.fanout, self.root = spark, fanout, root
        self.buckets = buckets or shuffle_width(spark)
        self.levels: list[list[tuple[str, str]]] = [[]]

    @classmethod
    def open(cls, spark: SparkSession, root: str, buckets: int | None = None, fanout: int = FANOUT) -> LineRuns:
        """The index that was kept at ``root``, or an empty one if there is none."""
        runs = cls(spark, buckets, fanout, root)
        if not path_exists(spark, f"{root}/levels"):
            return runs
        rows = spark.read.parquet(f"{root}/levels").orderBy("level", "place").collect()  # a few names a level
        for r in rows:
            runs.buckets = r["buckets"]
            while len(runs.levels) <= r["level"]:
                runs.levels.append([])
            if r["name"]:
                spark.sql(
                    f"CREATE TABLE IF NOT EXISTS {r['name']} (h1 BIGINT, h2 BIGINT, first BIGINT) USING parquet "
                    f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {r['buckets']} BUCKETS LOCATION '{r['path']}'"
                )
                runs.levels[r["level"]].append((r["name"], r["path"]))
        return runs

    def keep(self) -> None:
        """Write down which runs there are; needs a ``root``."""
        rows = [(i, k, name, path, self.buckets) for i, level in enumerate(self.levels) for k, (name, path) in enumerate(level or [("", "")])]
        self.spark.createDataFrame(rows, "level int, place int, name string, path string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/levels")

    def _write(self, keys: DataFrame) -> tuple[str, str]:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}" if self.root else scratch_path(self.spark, "run")
        (
            keys.write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", path)
            .format("parquet")
            .saveAsTable(name)
        )
        return name, path

    def ingest(self, keys: DataFrame) -> None:
        """Add a batch of ``(h1, h2, first)`` with distinct hashes; known keys fall out."""
        with setting(self.spark, SORTED_SCANS, "true"):
            for level in self.levels:
                for name, _ in level:
                    keys = keys.join(self.spark.table(name).hint("merge"), ["h1", "h2"], "left_anti")
            self.levels[0].append(self._write(keys.repartition(self.buckets, "h1", "h2")))
            self._compact(0)

    def _compact(self, i: int) -> None:
        """Merge the runs of a full level, bucket by bucket: their keys differ, so a full merge join interleaves them."""
        while i < len(self.levels) and len(self.levels[i]) >= self.fanout:
            old, self.levels[i] = self.levels[i], []
            merged = self.spark.table(old[0][0])
            for name, _ in old[1:]:
                other = self.spark.table(name).withColumnRenamed("first", "_first")
                merged = merged.hint("merge").join(other, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("first", "_first").alias("first"))
            run = self._write(merged)
            for name, path in old:
                self.spark.sql(f"DROP TABLE {name}")
                delete_path(self.spark, path)
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(run)
            i += 1

    def index(self) -> DataFrame:
        """Every known key once, read as plain files: a later join may split hot partitions."""
        paths = [path for level in self.levels for _, path in level]
        return self.spark.read.schema("h1 long, h2 long, first long").parquet(*paths)

    def forget_names(self) -> None:
        """Take the tables out of the catalog; their files stay for readers of ``index``."""
        for level in self.levels:
            for name, _ in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _line_ledger(rows: DataFrame, min_key: int) -> DataFrame:
    """(rank, thash, pos, h1, h2) of every line whose key is long enough."""
    key = line_key(F.col("line"))
    return (
        rows.select("_rank", "_thash", F.posexplode(F.split("_body", "\n")).alias("pos", "line"))
        .select("_rank", "_thash", "pos", key.alias("key"))
        .where(F.length("key") >= min_key)
        .select("_rank", "_thash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )


def _batch_of(rank: Column, edges: list[float]) -> Column:
    out = F.lit(0)
    for edge in edges:
        out = out + F.when(rank > F.lit(int(edge)), 1).otherwise(0)
    return out


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_key: int = MIN_KEY,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    index: LineRuns | None = None,
) -> DataFrame:
    """All columns of ``docs`` plus ``_n_lines``, ``_n_dropped`` and ``_kept`` (the text left).

    Without ``index`` the documents are all there are.  With one they are a further batch: lines that it knows from
    documents of smaller ids go too, their own are added to it, and it is kept.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct("*").alias("_row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_rank"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_body"),
    ).withColumn("_thash", F.xxhash64("_body"))

    edges = rows.select(F.percentile_approx("_rank", [i / batches for i in range(1, batches)], 1000).alias("e")).first()
    edges = sorted(set((edges and edges["e"]) or []))
    ledger = staged(
        _line_ledger(rows, min_key).withColumn("batch", _batch_of(F.col("_rank"), edges)), "lines", ["batch"]
    )
    runs = index or LineRuns(spark, fanout=fanout)
    for i in range(len(edges) + 1):
        batch = ledger.where(F.col("batch") == i).groupBy("h1", "h2").agg(F.min("_rank").alias("first"))
        runs.ingest(batch)
    if runs.root:
        runs.keep()
    if index is None:
        runs.forget_names()

    known = runs.index()
    drops = (
        ledger.join(known, ["h1", "h2"])
        .where(F.col("_rank") > F.col("first"))
        .groupBy("_rank", "_thash")
        .agg(F.collect_set("pos").alias("_gone"))
    )
    kept = let(
        F.struct(F.split("_body", "\n").alias("lines"), F.col("_gone").alias("gone")),
        lambda s: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]),
                lambda i: F.get(s["lines"], i),
            ),
            "\n",
        ),
    )
    return rows.join(drops, ["_rank", "_thash"], "left").select(
        *carried(docs, "_row", ["_n_lines", "_n_dropped", "_kept"]),
        (F.length("_body") - F.length(F.replace("_body", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("_n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("_n_dropped"),
        F.when(F.col("_gone").isNull(), F.col("_body")).otherwise(kept).alias("_kept"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, UNNEST(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT keyed.doc_id, pos, line, coalesce(keyed.doc_id > first_doc, false) AS gone
  FROM keyed LEFT JOIN firsts ON keyed.k = firsts.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
