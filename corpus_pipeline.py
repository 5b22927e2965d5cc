"""A corpus from documents: language ID, line dedup, near duplicates, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import langid, lines, mixing, neardup, packing
from quern.llm.common import written

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language id", langid.stage),
    ("line dedup", lines.stage),
    ("near duplicates", neardup.stage),
    ("source mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can't express language ID, line dedup, MinHash or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each reading what the one before wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
