"""BM25 over a text field, by tokens or by English stems."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stemmer import stem
from ..functions.tokens import flat_text, tokens, tokens_of

K1, B = 1.2, 0.75


def surface_forms(df: DataFrame, field: str, stems: list[str]) -> dict[str, list[str]]:
    """The tokens in the field that have these stems. Only tokens that begin like a stem are stemmed, each once a shuffle partition."""
    begin = {s[0] for s in stems} | ({"d", "l", "t", "s"} & {s[0] for s in stems})
    t = spread(df.select(field)).select(F.explode(F.array_distinct(tokens(flat_text(F.col(field), df.schema[field].dataType)))).alias("t")).where(F.substring("t", 1, 1).isin(sorted(begin))).distinct()

    @F.pandas_udf("string")
    def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(stem)

    out: dict[str, list[str]] = {s: [] for s in stems}
    for r in t.withColumn("s", stemmed("t")).where(F.col("s").isin(stems)).collect():
        out[r["s"]].append(r["t"])
    return out


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores, if their scan has far fewer splits than there are cores, as a small table has."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def text_search(df: DataFrame, field: str, query: str, limit: int | None = 10, id_col: str = "_id", where=None, analyzer: str = "english") -> DataFrame:
    """df's rows with a query term, with score, best first, ties by id. limit None: all; analyzer none: no stems.

    Statistics (documents with a token, their mean length, document frequencies) are of all of df; where, a column,
    filters the ranked rows, before the limit. A term in more than half the documents weighs negatively; a repeated one
    counts as often. Two scans and no shuffle but of one row a task, and of distinct tokens for stems.
    """
    if field not in df.columns:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    said = [stem(t) if analyzer == "english" else t for t in tokens_of(query)]
    empty = df.withColumn("score", F.lit(0.0)).limit(0)
    if not said or limit == 0:
        return empty
    terms = sorted(set(said))
    forms = surface_forms(df, field, terms) if analyzer == "english" else {t: [t] for t in terms}
    forms = {t: sorted(f) for t, f in forms.items() if f}
    t = tokens(flat_text(F.col(field), df.schema[field].dataType))
    names = {s: f"_tf{i}" for i, s in enumerate(forms)}
    if not forms:
        return empty

    def counted(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_tokens", t)
        any_ = sorted({f for fs in forms.values() for f in fs})
        rows = rows.withColumns({"_dl": F.size("_tokens"), "_hits": F.filter("_tokens", lambda x: x.isin(any_))})
        def tf(fs):
            return F.size(F.filter("_hits", lambda x: x.isin(fs)))
        return rows.withColumns({names[s]: tf(fs) for s, fs in forms.items()}).drop("_tokens", "_hits")

    stats = counted(spread(df.select(field))).agg(F.count(F.when(F.col("_dl") > 0, 1)).alias("n"), F.sum("_dl").alias("length"), *[F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in names.values()]).first()
    n = stats["n"]
    if not n:
        return empty
    mean = stats["length"] / n
    score = F.lit(0.0)
    for s in said:
        if s in names and stats[names[s]]:
            df_ = stats[names[s]]
            tf_ = F.col(names[s]).cast("double")
            idf = math.log((n - df_ + 0.5) / (df_ + 0.5))
            score = score + F.lit(idf) * (tf_ * F.lit(K1 + 1)) / (tf_ + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("_dl") / F.lit(mean)))
    rows = df if where is None else df.where(where)
    hit = F.lit(False)
    for c in names.values():
        hit = hit | (F.col(c) > 0)
    out = counted(spread(rows)).where(hit).withColumn("score", score).drop("_dl", *names.values()).orderBy(F.desc("score"), F.asc(id_col))
    return out if limit is None else out.limit(limit)
