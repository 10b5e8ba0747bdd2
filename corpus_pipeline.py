"""A training corpus from raw documents: filter, dedup, near-dedup, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage gets it as it was
written and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import staged

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: The last stage cuts documents by their token ids, which SQL has no function for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order, each on what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
