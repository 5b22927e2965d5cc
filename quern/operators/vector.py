"""Exact cosine search over an array column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(c: Column, query: list[float]) -> Column:
    """Of the column's vectors with a vector of the same length; a zero vector has 0."""
    n = math.sqrt(math.fsum(float(x) ** 2 for x in query))
    norm = F.sqrt(dot(c, c))
    return F.when(norm > 0, dot(c, F.array(*[F.lit(float(x)) for x in query])) / (norm * F.lit(n))).otherwise(F.lit(0.0))


def vector_search(df: DataFrame, field: str, query: list[float], limit: int | None = 10, id_col: str = "_id", dim: int | None = None) -> DataFrame:
    """df's rows with score, best first, ties by id. limit None: all rows.

    Rows whose vector is null, holds null or hasn't dim components (the query's number, unless given) are left out.
    A zero query finds nothing; a query of another length than dim raises ValueError. Filter df before: the limit
    counts what is left. With a limit the plan is one scan with a bounded heap a task.
    """
    query = [float(x) for x in query]
    if dim is not None and len(query) != dim:
        raise ValueError(f"the query has {len(query)} components, the field {dim}")
    c = F.col(field)
    rows = df.where(c.isNotNull() & (F.size(c) == len(query)) & F.forall(c, lambda x: x.isNotNull()))
    if not any(query) or limit == 0:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    out = rows.withColumn("score", cosine(c, query)).orderBy(F.desc("score"), F.asc(id_col))
    return out if limit is None else out.limit(limit)
