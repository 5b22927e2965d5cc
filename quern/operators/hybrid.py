"""Reciprocal rank fusion of a text and a vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import text_search
from .vector import vector_search

RRF_K = 60


def hybrid_search(df: DataFrame, text_field: str, vector_field: str, text: str, vector: list[float], limit: int | None = 10, id_col: str = "_id", where: Column | None = None, analyzer: str = "english", index=None) -> DataFrame:
    """df's rows with score, the sum of 1 / (60 + rank) over both searches' first max(5 * limit, 50) rows; best first, ties by id.

    Only ids and ranks of the two pools are fused; the documents are joined to the winners. index: a TextIndex of the
    text field. Without a limit both rankings are over all hits, which one task numbers.
    """
    pool = None if limit is None else max(5 * limit, 50)
    rows = df if where is None else df.where(where)
    legs = []
    said = index.hits(text, pool, id_col, None if where is None else rows.select(id_col), analyzer) if index is not None else text_search(df, text_field, text, pool, id_col, where, analyzer)
    near = vector_search(rows, vector_field, vector, pool, id_col) if vector_field in df.columns else df.limit(0).withColumn("score", F.lit(0.0))
    for hits in (said, near):
        order = W.orderBy(F.desc("score"), F.asc(id_col))
        legs.append(hits.select(id_col, (1.0 / (RRF_K + F.row_number().over(order))).alias("score")))
    fused = legs[0].unionByName(legs[1]).groupBy(id_col).agg(F.sum("score").alias("score")).orderBy(F.desc("score"), F.asc(id_col))
    fused = fused if limit is None else F.broadcast(fused.limit(limit))
    return rows.join(fused, id_col).select(*df.columns, "score").orderBy(F.desc("score"), F.asc(id_col))
