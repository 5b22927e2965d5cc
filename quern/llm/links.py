"""From buckets of look-alikes to classes: which pairs get verified, and connected components of the links found."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written

#: counters of the sketch that orders grams by how often they come; members up to which a bucket's pairs are all tested, rather than told apart by grams
CELLS, SMALL = 1 << 21, 12
#: links from which on components are found in rounds over all tasks; fewer fit one task, which gives the same labels
FEW = 500_000


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the links, once, and the smallest id that it is connected to: in rounds, larger roots are hung under smaller ones that a link leads to, then all paths are cut short."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while len(over := np.flatnonzero(root[root] != root)):
            root[over] = root[root[over]]
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return ids, ids[root]


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in smallest(*(np.concatenate(x) for x in zip(*got)))], names=["id", "label"])


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(id, label): for each end of a link (a, b) the smallest id that it is connected to.

    Rounds of large-star and small-star, each aggregated before its shuffle and written; their number grows as the
    logarithm of the longest path. From few links on, given or left, one task does the rest: a round is ten jobs, whose
    plans the driver holds. No links: no rows. The result is written, what led to it deleted.
    """
    held, before = Scratch(), None
    e = held.written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        sign = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == before or not sign[0]:
            out = written(e.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()), "labels")
            held.drop()
            return out
        if sign[0] <= few:
            out = written(e.coalesce(1).mapInArrow(_smallest, "id long, label long"), "labels")
            held.drop()
            return out
        before = sign
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = held.written(small, "stars")
        held.drop(e)


def several(members: DataFrame) -> DataFrame:
    """The members (bucket, id) of buckets that hold several ids, each once."""
    some = members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("bucket")
    return members.join(some, "bucket", "left_semi").distinct()


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def by_rare_grams(texts: DataFrame, grams_of: Callable[[str], np.ndarray], kept: Callable[[str, int], int], cells: int = CELLS) -> DataFrame:
    """(bucket, id) of the texts (id, text, buckets): within each of its buckets a text posts the first kept(text, number) of its grams, the rarest there first; only what several texts post.

    That is a prefix filter: with any order of the grams that is the same for all texts of a bucket, two that must share
    more grams than either leaves out share one of those posted. Rarity is read off a sketch of counts of (bucket, gram),
    so what thousands of unlike texts have in common, such as a template or the very segment that made the bucket, is
    posted last and brings nobody together.
    """

    def posts(text: str, buckets: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """A row a bucket: the keys of its (bucket, gram), and their cells."""
        g = grams_of(text)
        k = mixed(g[None] ^ mixed(np.array(buckets, dtype=np.int64).view(np.uint64))[:, None])
        return k, (k % np.uint64(cells)).astype(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, dtype=np.int32)
        for b in batches:
            for t, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                np.add.at(n, posts(t, at)[1].ravel(), 1)
        i = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(n[i], pa.int64())], names=["cell", "n"])

    got = texts.select("text", "buckets").mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(cells, dtype=np.int32)
    n[got["cell"].to_numpy()] = np.minimum(got["n"].to_numpy(), (1 << 31) - 1)
    held = texts.sparkSession.sparkContext.broadcast(n)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = held.value
        for b in batches:
            ids, out = [], []
            for i, t, at in zip(*(c.to_pylist() for c in b.columns)):
                k, cell = posts(t, at)
                if k.shape[1]:
                    first = np.lexsort((k, n[cell]), axis=1)[:, : kept(t, k.shape[1])]
                    k = np.unique(np.take_along_axis(k, first, axis=1))
                    out.append(k.view(np.int64))
                    ids.append(np.full(len(k), i, dtype=np.int64))
            none = np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out or [none])), pa.array(np.concatenate(ids or [none]))], names=["bucket", "id"])

    held_ = Scratch()
    out = written(several(held_.written(texts.select("id", "text", "buckets").mapInArrow(posted, "bucket long, id long"), "rare")), "refined")
    held_.drop()
    held.destroy()
    return out


def _mixed(members: DataFrame, labels: DataFrame, held: Scratch) -> DataFrame:
    """(bucket, id, label, n) of the buckets whose members aren't all connected; n: their number. Written."""
    tagged = members.join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
    mixed = tagged.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("bucket", "n")
    return held.written(tagged.join(mixed, "bucket"), "open")


def resolve(members: DataFrame, verify: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, labels, buckets) of the members (bucket, id): links (a, b) verified so far, components(), and the buckets that hold every pair that may be linked.

    First each member is held against one other, the smallest id that it shares a bucket with: one pair a member, also
    among a third of all rows. A bucket that is one component then is done: further links in it join nothing new. The
    members of the others, unless they are SMALL, are put into the buckets that refine(members) says, if it is given: each
    two members of a bucket that are linked must share one of these. Buckets that are still open have all their members, if
    they are SMALL, else 1, 2, 4, ... of them, drawn by hash, held against all members of other components, no pair
    twice, until the bucket is one component or each member has been drawn; after a round that found no link, four times
    as many are drawn. So classes are exactly those of all pairs that share a bucket. Work is quadratic only in a refined bucket
    whose members are mutually unlike.
    """
    all_, pairs_, open_ = members, Scratch(), Scratch()
    rep = all_.groupBy("bucket").agg(F.min("id").alias("rep"))
    tested = all_.join(rep, "bucket").groupBy("id").agg(F.min("rep").alias("rep")).where("rep < id").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    tested = pairs_.written(tested, "pairs")
    links = written(verify(tested), "verified")
    labels = components(links)
    tagged = _mixed(all_, labels, open_)
    if refine is not None and not tagged.isEmpty():
        large = tagged.where(F.col("n") > SMALL)
        fine = refine(large.select("bucket", "id"))
        all_ = written(all_.join(large.select("bucket").distinct(), "bucket", "left_anti").unionByName(fine), "buckets")
        tagged = tagged.where(F.col("n") <= SMALL).unionByName(_mixed(fine, labels, open_))
    lo, hi = 0, 1
    while not tagged.isEmpty():
        draw = (F.xxhash64("bucket", "id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))) * F.col("n")
        reps = tagged.where((F.col("n") <= SMALL) | (draw >= lo) & (draw < hi)).select("bucket", F.col("id").alias("rep"), F.col("label").alias("own"))
        pairs = tagged.join(reps, "bucket").where("label <> own").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()
        pairs = pairs_.written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        more = written(verify(pairs), "verified")
        found = not more.isEmpty()
        if found:
            links = links.unionByName(more)
            labels = components(links)
        tested = tested.unionByName(pairs)
        before, open_ = open_, Scratch()
        tagged = _mixed(tagged.where(F.col("n") > max(SMALL, hi)).select("bucket", "id"), labels, open_)
        before.drop()
        lo, hi = hi, hi + (hi - lo) * (2 if found else 4)
    open_.drop()
    pairs_.drop()
    return links, labels, all_


def every_link(members: DataFrame, labels: DataFrame, verify: Callable[[DataFrame], DataFrame], block: int = 512) -> DataFrame:
    """(a, b), a < b: the verified pairs of all that share a bucket of the members (bucket, id), each once.

    labels are resolve()'s: members of different components have no link, so they aren't paired. What a bucket holds of
    a component is cut into blocks by a hash of the ids, and each two blocks meet in a join key of their own.
    """
    held = Scratch()
    m = held.written(members.join(labels, "id").select("bucket", "label", "id"), "labelled")
    n = m.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    m = m.join(n, ["bucket", "label"]).withColumn("n", F.ceil(F.col("n") / block).cast("int"))
    m = m.withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    m = held.written(m.select("bucket", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id"), "blocks")
    met = m.withColumnsRenamed({"id": "a", "own": "x"}).join(m.withColumnsRenamed({"id": "b", "own": "y"}), ["bucket", "label", "i", "j"])
    out = written(verify(met.where("a < b AND (i = j OR x <> y)").select("a", "b").distinct()), "every")
    held.drop()
    return out
