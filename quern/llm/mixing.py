"""Mixing sources to target weights: per-source targets by water-filling, floor(rate) copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, fresh, spread, table, written

WEIGHTS, SHARE, CAP, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, "mix-1"
#: sources up to which their table is broadcast; beyond, it is joined with each source cut into SALTS
BROADCAST_SOURCES, SALTS = 100_000, 64


def words(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources in code point order, null last, take the weights in turn. A source stops at cap times its size and its
    excess goes to the others by weight, until none is above; that ends at min(cap * size, weight * level), one level
    for all. The level is found by one ordered pass: sources sorted by cap * size / weight fill up in that order.
    It works on one row a source. A source without words has target 0; if share exceeds cap, all stop at cap.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(cap))
    order = W.orderBy(full / F.col("_weight"), F.col("_rank"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = sizes.withColumn("_rank", rank).withColumn("_weight", weight)
    s = s.select("*", F.coalesce(F.sum(full).over(before), F.lit(0.0)).alias("_done"), F.coalesce(F.sum("_weight").over(before), F.lit(0.0)).alias("_gone"),
                 F.sum("_weight").over(W.partitionBy()).alias("_all"), F.sum("source_size").over(W.partitionBy()).alias("_size"))
    # the level if exactly the sources before this one are full; the true one is the first that doesn't fill this source
    s = s.withColumn("_level", (F.col("_size") * F.lit(float(share)) - F.col("_done")) / (F.col("_all") - F.col("_gone")))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") * F.col("_weight") <= full, F.struct("_gone", "_level"))).over(W.partitionBy())["_level"])
    return s.select("source", "source_size", F.coalesce(F.least(full, F.col("_weight") * F.col("_level")), full).alias("target"))


def chance(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the key and the seed: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def attached(docs: DataFrame, per: DataFrame, source: str, key: str, by: str, broadcast: int = BROADCAST_SOURCES, salts: int = SALTS) -> DataFrame:
    """docs joined to per, a row a source, by null-safe source = key, which goes.

    A per of at most broadcast rows is broadcast, so that no text is shuffled. A larger one is repeated salts times and
    joined by source and salt, a hash of the column by, so that no source, however hot, is one task's.
    """
    per = written(per, "sources")
    if per.count() <= broadcast:
        return docs.join(F.broadcast(per), col(source).eqNullSafe(col(key))).drop(key)
    a, b = fresh(docs, "salt", "salt_of")
    rows = per.withColumn(b, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return docs.withColumn(a, F.pmod(F.xxhash64(col(by)), F.lit(salts)).cast("int")).join(rows, col(source).eqNullSafe(col(key)) & (col(a) == col(b))).drop(a, b, key)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, size_col: str | None = None, **how) -> DataFrame:
    """All rows and columns of docs, and size, source_size, target and copies (the last under free names if those are taken).

    Only one row a source is shuffled, and attached() joins it back. Null text or text without words: size 0. Null
    source: a source of its own, last. Repeated rows of one doc_id draw alike; a null doc_id draws as any other. Very
    long texts are counted whole. No rows: no rows. size_col: a column that holds the sizes, if they are known already.
    """
    size, total, target, copies, src = fresh(docs, "size", "source_size", "target", "copies", "mix_source")
    words_ = words(col(text_col)) if size_col is None else col(size_col)
    per = targets(docs.select(col(source_col).alias("source"), words_.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    per = per.select(F.col("source").alias(src), F.col("source_size").alias(total), F.col("target").alias(target))
    rate = F.when(col(total) > 0, col(target) / col(total)).otherwise(F.lit(0.0))
    return (attached(docs.withColumn(size, words_), per, source_col, src, id_col, **how)
            .withColumn(copies, (F.floor(rate) + F.when(chance(col(id_col), seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")  # texts are counted once
    m = mix(sized.withColumnRenamed("size", "n_words"), size_col="n_words")
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix says; those that get no copy go."""
    (one,) = fresh(docs, "copy")
    m = mix(docs)
    name = m.columns[-1]
    return m.where(col(name) > 0).withColumn(one, F.explode(F.sequence(F.lit(1), col(name).cast("int")))).select(*[col(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size::DOUBLE * 2.0::DOUBLE AS cap FROM r),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0.0::DOUBLE) AS done, coalesce(sum(weight) OVER o, 0.0::DOUBLE) AS gone,
  sum(weight) OVER () AS allw, (sum(source_size) OVER ())::DOUBLE AS alls
  FROM w WINDOW o AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (alls * 1.5::DOUBLE - done) / (allw - gone) AS level FROM c),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, gone) FROM l WHERE level * weight <= cap)), cap) AS target FROM l)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
  (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""
