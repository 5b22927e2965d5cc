"""The live documents of a log as a stream: new commits are read as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import GONE


def tail(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "commit-*") -> DataFrame:
    """A streaming frame of log records under path; schema holds _seq, _op, _id and the documents' columns."""
    return spark.readStream.schema(schema).parquet(f"{path}/{pattern}")


def latest(log: DataFrame, seq: str = "_seq", op: str = "_op", id_col: str = "_id") -> DataFrame:
    """Of a streaming log the last record of each id, tombstones left out: state is one row an id. For output modes complete and update."""
    rest = [c for c in log.columns if c != id_col]
    last = log.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return last.where(F.col(f"_last.{op}") != GONE).select(id_col, *[F.col("_last")[c].alias(c) for c in rest])


def run_once(frame: DataFrame, name: str, mode: str = "complete") -> None:
    """Brings the in-memory table name up to date with what is there."""
    frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
