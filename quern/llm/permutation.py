"""Approximate nearest neighbours by a permutation index.

A vector is represented by its LENGTH nearest pivots in order, which is written once, beside the vector. A segment of
rows is posted in one inverted file a pivot, with the place that the pivot has in the vector's order; a query reads the
files of its own ASKED nearest pivots only, which gives every vector's footrule distance over these (a pivot that a
vector doesn't have counts as place LENGTH). So a query adds up ASKED * LENGTH / PIVOTS places a row, 2, where an exact
scan takes a product of all components. The share RERANK of vectors nearest by footrule is reranked by exact distance,
and the segments' best are merged. Equal vectors of a segment are indexed once, with all their ids, and count as one in
that share; pivots are distinct vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .vectors import best, matrix, search, usable

#: pivots, a sample of so many vectors; pivots that represent a vector, and of a query's those whose files are read; share of distinct vectors, and least number a segment, to rerank
PIVOTS, LENGTH, ASKED, RERANK, LEAST = 1024, 64, 32, 0.08, 64
#: rows whose inverted files are held at once
SEGMENT = 65_536
EMPTY = "query_id bigint, rank int, vec_id bigint, score double"


def order_of(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The numbers of the nearest pivots of each row, nearest first; ties: the smaller number."""
    d = (pivots**2).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :length]


class Files:
    """The inverted files of a segment."""

    def __init__(self, perms: np.ndarray, n_pivots: int):
        self.n, self.length = perms.shape
        flat = perms.ravel()
        order = np.argsort(flat, kind="stable")
        self.rows, self.places = (order // self.length).astype(np.int32), (order % self.length).astype(np.int32)
        self.at = np.searchsorted(flat[order], np.arange(n_pivots + 1))

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Each row's footrule distance to a permutation, or to the beginning of one. It is the most possible less 2 * (length - the later place) a shared pivot."""
        shared = np.zeros(self.n, dtype=np.int64)
        for a, p in enumerate(perm):
            i, j = self.at[p], self.at[p + 1]
            shared[self.rows[i:j]] += self.length - np.maximum(self.places[i:j], a)
        return self.length * (self.length + 1) - 2 * shared


def grouped(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the distinct rows of x, the ids in order of their row's place among these and then by size, and where each place begins and the last ends."""
    x = np.ascontiguousarray(x + 0.0)  # no negative zeros, so that equal rows have equal bytes
    _, first, place = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
    place = place.ravel()
    order = np.lexsort((ids, place))
    return first, ids[order], np.searchsorted(place[order], np.arange(len(first) + 1))


def indexed(vectors: DataFrame, pivots: np.ndarray, length: int = LENGTH) -> DataFrame:
    """(id, vec, perm) of (id, vec), written: perm holds the numbers of a row's nearest pivots, as packed 16-bit numbers. No rows: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b)[1]
                perms = np.concatenate([order_of(x[i : i + 4096], pivots, length) for i in range(0, len(x), 4096)]).astype("<u2")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in perms], pa.binary())], names=["id", "vec", "perm"])

    kind = vectors.schema["id"].dataType.simpleString()
    return written(vectors.select("id", "vec").mapInArrow(run, f"id {kind}, vec array<double>, perm binary"), "permutations")


def knn(vectors: DataFrame, queries: DataFrame, pivots: np.ndarray, k: int = 10, length: int = LENGTH, asked: int = ASKED, rerank: float = RERANK, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among (id, vec); its own id isn't among them.

    Each row is indexed, on the worker that reads it; nothing but the best of each segment is shuffled. Equal
    distances go by the smaller id. Fewer than k candidates: all of them. No vectors or no queries: no rows. Repeated ids
    are candidates each; of a query id that repeats the least vector asks. Other columns aren't read. Fewer rows than
    pivots: all rows are pivots.
    """
    length = min(length, len(pivots))
    asked = min(asked, length)
    rows = indexed(vectors, pivots, length) if length else None

    def one(ids: np.ndarray, vecs: np.ndarray) -> DataFrame:
        perms = order_of(vecs, pivots, asked)

        def segment(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            cand, x, own = (np.concatenate(c) for c in zip(*held))
            first, cand, at = grouped(cand, x)
            x, low, high = x[first], cand[at[:-1]], cand[at[1:] - 1]
            files = Files(own[first], len(pivots))
            n = min(len(x), max(least, k + 1, int(np.ceil(rerank * len(x)))))
            out: list[list] = [[], [], []]
            for q, v, perm in zip(ids, vecs, perms):
                f = files.footrule(perm)
                near = np.flatnonzero(f <= np.partition(f, n - 1)[n - 1])  # ties stay whole
                near = near[(low[near] != q) | (high[near] != q)]
                if not len(near):
                    continue
                d = x[near] - v
                d = np.sqrt((d * d).sum(axis=1))
                fine = d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
                got = [(c := cand[at[g] : at[g + 1]])[c != q][:k] for g in near[fine]]
                got, d = np.concatenate(got), np.repeat(d[fine], [len(c) for c in got])
                top = np.lexsort((got, d))[:k]
                out[0] += [q] * len(top)
                out[1] += got[top].tolist()
                out[2] += d[top].tolist()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for b in batches:
                if b.num_rows:
                    held.append((*matrix(b), np.frombuffer(b"".join(b.column(2).to_pylist()), dtype="<u2").reshape(b.num_rows, -1).astype(np.int64)))
                    n += b.num_rows
                if n >= SEGMENT:
                    yield segment(held)
                    held, n = [], 0
            if n:
                yield segment(held)

        return best(rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double"), k, "score", descending=False)

    return search(vectors, queries, one, EMPTY)


def pivots_of(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """A bounded sample: the n distinct vectors first by their hashes. A task sends n at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            h, first = np.unique(held.column(0).to_numpy(), return_index=True)
            held = held.take(first[:n]).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    rows = vectors.select(F.xxhash64("vec").alias("h"), "vec").mapInArrow(run, "h long, vec array<double>").dropDuplicates(["h"]).orderBy("h").limit(n).collect()
    return np.array([r["vec"] for r in rows]) if rows else np.zeros((0, 1))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero=False)
    return knn(v, v.where(F.col("id") % 100 == 0), pivots_of(v))
