"""What both vector searches share: which rows take part, and queries in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, written

#: queries that reach the driver and are sent to workers at once
BLOCK = 8192


def usable(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(id, vec) with vectors of doubles. Rows with a null id, and vectors that are null, empty or hold null or non-finite components, or only zeros unless zero, are left out.

    So are vectors of another length than most (ties: the shortest), as no measure is defined between lengths.
    """
    v = col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    if not zero:
        fine = fine & F.exists(v, lambda x: x != 0)
    d = df.where(col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine).select(col(id_col).alias("id"), v.cast("array<double>").alias("vec"))
    most = d.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return d.where(F.size("vec") == (most[0]["n"] if most else 0))


def blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of at most size queries at a time. Of a repeated id the least vector asks."""
    ids, vecs = [], []
    for r in queries.groupBy("id").agg(F.min("vec").alias("vec")).toLocalIterator():
        ids.append(r["id"])
        vecs.append(r["vec"])
        if len(ids) == size:
            yield np.array(ids), np.array(vecs)
            ids, vecs = [], []
    if ids:
        yield np.array(ids), np.array(vecs)


def matrix(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch of (id, vec), vec holding doubles of one length."""
    ids = b.column(0).to_numpy(zero_copy_only=False)
    return ids, b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))


def best(found: DataFrame, k: int, score: str, descending: bool) -> DataFrame:
    """The k best rows of each query, from what the partitions found (k each at most), with their rank from 1; ties: the smaller id."""
    order = W.partitionBy("query_id").orderBy(F.desc(score) if descending else F.asc(score), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)


def search(vectors: DataFrame, queries: DataFrame, one: Callable[[np.ndarray, np.ndarray], DataFrame], empty: str, size: int = BLOCK) -> DataFrame:
    """one(ids, vectors) for each block of queries against all rows; beyond one block each block's result is written before the next begins."""
    out = None
    held = None
    for block in blocks(queries, size):
        if held is not None:
            part = written(one(*held), "block")
            out = part if out is None else out.unionByName(part)
        held = block
    if held is None:
        return vectors.sparkSession.createDataFrame([], empty)
    last = one(*held)
    return last if out is None else out.unionByName(last)
