"""Exact top-k search by distributed histogram selection.

Every row is scored against every query of a block. Global histograms of the scores, one a query, are refined around
the bin that holds the kth value until that bin is one value wide; then the rows that reach it are kept and ties are
broken by id. A pass sends one histogram a partition, never scores, and the driver gets one row a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table
from .vectors import best, matrix, search, usable

BINS, ROWS = 256, 2048
EMPTY = "query_id bigint, rank int, vec_id bigint, score bigint"
LONGS = (-(1 << 63), (1 << 63) - 1)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, which hold it exactly."""
    return np.floor(x * scale)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles while they stay below 2^53, else in Python's numbers, kept within a long."""
    most = (np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0)) * max(q.shape[1], 1)
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    big = np.vectorize(int, otypes=[object])
    s = big(q) @ big(x).T
    return np.clip(s, *LONGS).astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query among (id, vec), its own id left out.

    Ties: the smaller id, also among a third of all rows that tie, as a partition keeps its own first k of those only.
    Fewer than k candidates: all of them. Scores that no long holds count as the nearest long.
    """

    def one(ids: np.ndarray, vecs: np.ndarray) -> DataFrame:
        q = whole(vecs, scale)
        at = np.arange(len(ids))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in batches:
                cand, x = matrix(b)
                for i in range(0, len(cand), ROWS):
                    c = cand[i : i + ROWS]
                    yield c, scores(q, whole(x[i : i + ROWS], scale)), ids[:, None] != c[None]

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lo, hi, n = np.full(len(ids), LONGS[1]), np.full(len(ids), LONGS[0]), np.zeros(len(ids), dtype=np.int64)
            for _, s, other in scored(batches):
                lo = np.minimum(lo, np.where(other, s, LONGS[1]).min(axis=1))
                hi = np.maximum(hi, np.where(other, s, LONGS[0]).max(axis=1))
                n += other.sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lo), pa.array(hi), pa.array(n)], names=["q", "lo", "hi", "n"])

        got = vectors.mapInArrow(ranges, "q long, lo long, hi long, n long").where("n > 0").groupBy("q").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()
        lo, hi, need = np.zeros(len(ids), dtype=object), np.full(len(ids), -1, dtype=object), np.zeros(len(ids), dtype=object)
        for r in got:
            lo[r["q"]], hi[r["q"]], need[r["q"]] = r["lo"], r["hi"], min(k, r["n"])
        while any(h > a for a, h in zip(lo, hi)):
            width = np.array([max(1, -(-(h - a + 1) // BINS)) for a, h in zip(lo, hi)], dtype=object)
            lo_, hi_, width_ = lo.astype(np.int64), hi.astype(np.int64), np.array([min(w, LONGS[1]) for w in width], dtype=np.int64)
            open_ = lo_ < hi_

            def histogram(batches: Iterator[pa.RecordBatch], lo_=lo_, hi_=hi_, width_=width_, open_=open_) -> Iterator[pa.RecordBatch]:
                total = np.zeros((len(ids), BINS + 1), dtype=np.int64)
                live = np.flatnonzero(open_)
                for _, s, other in scored(batches):
                    s, other = s[live], other[live] & (s[live] >= lo_[live, None]) & (s[live] <= hi_[live, None])
                    bin_ = ((s.astype(np.uint64) - lo_[live, None].astype(np.uint64)) // width_[live, None].astype(np.uint64)).astype(np.int64)
                    cell = (live[:, None] * (BINS + 1) + bin_)[other]
                    total += np.bincount(cell, minlength=total.size).reshape(total.shape)
                i, j = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["q", "bin", "n"])

            h = vectors.mapInArrow(histogram, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            h = h.withColumn("above", F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin"))) - F.col("n"))
            needs = vectors.sparkSession.createDataFrame([(int(i), int(need[i])) for i in np.flatnonzero(open_)], "q long, need long")
            for r in h.join(F.broadcast(needs), "q").where("above < need and above + n >= need").collect():  # needs: a row a query of the block
                i = r["q"]
                lo[i] += r["bin"] * width[i]
                hi[i] = min(hi[i], lo[i] + width[i] - 1)
                need[i] -= r["above"]
        kth = lo.astype(np.int64)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]]

            def prune() -> None:
                i, c, s = (np.concatenate(x) for x in out)
                order = np.lexsort((c, -s.astype(object) if len(s) and s.min() == LONGS[0] else -s, i))
                i, c, s = i[order], c[order], s[order]
                first = np.searchsorted(i, i)
                fine = np.arange(len(i)) - first < k
                for x, v in zip(out, (i[fine], c[fine], s[fine])):
                    x[:] = [v]

            held = 0
            for c, s, other in scored(batches):
                i, j = np.nonzero(other & (s >= kth[:, None]))
                for x, v in zip(out, (i, c[j], s[i, j])):
                    x.append(v)
                held += len(i)
                if held > 200_000:
                    prune()
                    held = 0
            prune()
            i, c, s = (x[0] for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i].astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(s)], names=["query_id", "vec_id", "score"])

        return best(vectors.mapInArrow(keep, "query_id bigint, vec_id bigint, score bigint"), k, "score", descending=True)

    return search(vectors, queries, one, EMPTY)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero=True)
    return top_k(v, v.where(F.col("id") % 100 == 0))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
