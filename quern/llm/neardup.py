"""n-gram Jaccard join by MinHash banding: near-duplicate documents as classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col, fresh, spread, table, written
from .links import by_rare_grams, resolve, several

N, THRESHOLD, RECALL = 3, 0.5, 0.99
#: words whose hashes a worker keeps, texts that a task remembers, to sign each of them once
CACHE, SEEN = 150_000, 100_000
#: texts, and code points, of a class that are compared with one another in one task's memory; larger classes are cut into such blocks
BLOCK, CHARS = 256, 2_000_000


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and the fewest bands of so many, with which a pair at the threshold shares a band with probability recall, within most hashes."""
    best = None
    for rows in range(1, most + 1):
        b = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if b * rows <= most:
            best = (b, rows)
    if best is None:
        raise ValueError("no bands reach this recall within so many hashes")
    return best


def words(text: str) -> list[str]:
    return text.lower().split()


def grams(w: list[str], n: int = N) -> set[tuple[str, ...]]:
    """The n-grams of words; fewer words than n: all of them as one; none: none."""
    return set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else {tuple(w)} if w else set()


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        if len(self) < CACHE:
            self[w] = h
        return h


_HASHES = _Hashes()


def gram_hashes(text: str, n: int) -> np.ndarray:
    """The text's n-gram set as sorted 64-bit hashes of the grams."""
    w = words(text)
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, w), dtype=np.uint64, count=len(w))
    k = min(n, len(h))
    g = np.full(len(h) - k + 1, len(h) if len(h) < n else n, dtype=np.uint64)  # short texts' one gram isn't another's
    for i in range(k):
        g = (g ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    return np.unique(g)


def signature(text: str, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray | None:
    """The MinHash of the text's n-grams under a * x + b; None without words."""
    g = gram_hashes(text, n)
    if not len(g):
        return None
    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(g), 2048):
        out = np.minimum(out, (g[i : i + 2048, None] * a + b).min(axis=0))
    return out


def _signatures(bands: int, rows: int, n: int):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        no = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i in seen or (s := signature(t, a, b, n)) is None:
                    continue
                if len(seen) < SEEN:
                    seen.add(i)
                s = s.reshape(bands, rows)
                key = no * np.uint64(0xD6E8FEB86659FD93)
                for c in range(rows):
                    key = (key ^ s[:, c]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(32)
                ids.append(i)
                out.append(key.astype(np.int64))
            flat = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(ids, dtype=np.int64), bands))], names=["bucket", "id"])

    return run


def _verify(threshold: float, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out: list[list[int]] = [[], []]
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                if a != last:
                    last, own = a, gram_hashes(ta, n)
                other = gram_hashes(tb, n)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both and both >= threshold * (len(own) + len(other) - both):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return run


def _counts(threshold: float, n: int):
    """(id, n_links) of each run of rows (label, i, j, block, id, text): near texts of a row's in its block if i = j, in the other block else."""

    def count(rows: list[tuple]) -> tuple[list[int], list[int]]:
        m, cross = len(rows), rows[0][1] != rows[0][2]
        sets = [gram_hashes(t, n) for *_, t in rows]
        size, block = np.array([len(x) for x in sets]), np.array([r[3] for r in rows])
        known, gram = np.unique(np.concatenate(sets), return_inverse=True)
        sets = np.split(gram, np.cumsum(size)[:-1])
        order = np.argsort(gram, kind="stable")
        holders, at = np.repeat(np.arange(m), size)[order], np.searchsorted(gram[order], np.arange(len(known) + 1))
        out = []
        for r, x in enumerate(sets):
            k = at[x + 1] - at[x]
            both = np.bincount(holders[np.repeat(at[x] - np.cumsum(k) + k, k) + np.arange(k.sum())], minlength=m)
            near = (both > 0) & (both >= threshold * (size[r] + size - both))
            near[r] = False
            out.append(int((near & (block != block[r])).sum() if cross else near.sum()))
        return [r[4] for r in rows], out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    for o, x in zip(out, count(held)):
                        o += x
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["id", "n_links"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in count(held)], names=["id", "n_links"])

    return run


def n_links(labels: DataFrame, texts: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK, chars: int = CHARS) -> DataFrame:
    """(id, n_links) of texts that have a label: how many different texts of the same class are near. Every pair of a class is compared, on its full sets.

    Near texts always share a label, so nothing else need be compared. A class is cut into blocks by a hash of its ids,
    and each two blocks meet in a task.
    """
    t = texts.join(labels, "id").select("label", "id", "text")
    n_blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum(F.length("text")) / chars)).cast("int")
    t = t.join(t.groupBy("label").agg(n_blocks.alias("n")), "label").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("n")).cast("int"))
    t = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = t.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "text")
    met = t.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(_counts(threshold, n), "id long, n_links long")
    return met.groupBy("id").agg(F.sum("n_links").alias("n_links"))


def text_id(text: str) -> Column:
    return F.xxhash64(col(text))


def classes(docs: DataFrame, text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(labels, texts): (id, label) of texts that have a near text, and (id, text), once each, of those that may have one, by text id.

    A text's id is its 64-bit hash, so copies are one text from the start: a task signs each of them once, and hot
    groups of copies are a row a task before the shuffle. Two texts are near if their n-gram sets have a Jaccard index
    of at least threshold, which is verified on the full sets; pairs at the threshold share a bucket with probability
    recall, nearer ones more. Null texts and texts without words are near nothing.
    """
    bands, rows = bands_for(threshold, recall)
    d = docs.where(col(text_col).isNotNull()).select(text_id(text_col).alias("id"), col(text_col).alias("text"))
    held = Scratch()
    members = held.written(several(held.written(d.mapInArrow(_signatures(bands, rows, n), "bucket long, id long"), "bands")), "buckets")
    texts = written(d.join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "texts")
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(_verify(threshold, n), "a long, b long")

    def refine(open_: DataFrame) -> DataFrame:  # by the rarest of all these texts' grams, whatever bucket they met in
        own = held.written(texts.join(open_.select("id").distinct(), "id", "left_semi").withColumn("buckets", F.array(F.lit(0).cast("long"))), "unlike")
        return by_rare_grams(own, lambda t: gram_hashes(t, n), lambda _, k: k - math.ceil(threshold * k - 1e-9) + 1)

    labels = resolve(members, verify, refine)[1]
    held.drop()
    return labels, texts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, block: int = BLOCK, **how) -> DataFrame:
    """One row a document: doc_id, class_id (the smallest doc_id of its class), class_size (documents), n_links (how many different texts of its class are near its text, each verified), keep.

    A class is a connected component of links, and copies of its texts. keep marks the document that stays: the
    smallest id, nulls last, then the smallest text id; rows that repeat both are one document. Null texts: a class of
    their own each, with no class_id but their doc_id.
    """
    labels, texts = classes(docs, text_col, n=n, threshold=threshold, **how)
    k = docs.select(col(id_col).alias("doc_id"), text_id(text_col).alias("id"), col(text_col).isNull().alias("none"))
    ends = written(n_links(labels, texts, n, threshold, block), "ends")
    known = labels.join(ends, "id", "left")
    k = written(k.join(known, "id", "left").select("doc_id", "id", "none", F.coalesce("label", "id").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "keyed")
    first = k.where("not none").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "id")).alias("f"), F.count(F.lit(1)).alias("class_size"))
    told = k.where("not none").join(first, "label").select("doc_id", F.col("f.doc_id").alias("class_id"), "class_size", "n_links", (F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("id") == F.col("f.id"))).alias("keep"))
    return told.unionByName(k.where("none").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "n_links", F.lit(True).alias("keep")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each class: the one that near_duplicates() keeps, once. All columns stay; rows with null text stay.

    Only the ids of classes with several rows are joined, as what goes; texts are shuffled once at most.
    """
    labels, _ = classes(docs, text_col, **how)
    tid, n, none = fresh(docs, "text_id", "n_rows", "none")
    k = docs.where(col(text_col).isNotNull()).select(col(id_col).alias("doc_id"), text_id(text_col).alias("id"))
    k = k.join(labels, "id", "left").select("doc_id", "id", F.coalesce("label", "id").alias("label"))
    k = written(k.groupBy("label", "id", "doc_id").agg(F.count(F.lit(1)).alias("n")), "keys")
    first = k.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "id")).alias("f"))
    keys = k.join(first, "label").where(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("id") == F.col("f.id")))
    keys = keys.select(F.col("id").alias(tid), F.col("doc_id").alias(none), F.col("n").alias(n))
    got = docs.where(col(text_col).isNotNull()).withColumn(tid, text_id(text_col)).join(keys, tid).where(col(id_col).eqNullSafe(col(none)))
    once = got.where(col(n) == 1).unionByName(got.where(col(n) > 1).dropDuplicates([tid, none]))
    return once.select(*[col(c) for c in docs.columns]).unionByName(docs.where(col(text_col).isNull()))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return deduplicate(docs)
