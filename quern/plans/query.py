"""The query builder: filter, then group, then sort, then skip, then limit, in whatever order they are called."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.aggregates import Aggregate, avg, collect, count, first, last, max, mean, min, sum  # noqa: A004
from ..operators.hybrid import hybrid_search
from ..operators.text import text_search
from ..operators.vector import vector_search
from .filters import compile_filter

AGGREGATES = {"count": count, "sum": sum, "mean": mean, "avg": avg, "min": min, "max": max, "collect": collect, "first": first, "last": last}


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: rows skipped without a limit, up to which one task finds the last of them; beyond, one task reads all rows
SKIPPED = 100_000


def _without_first(df: DataFrame, n: int, field: str, down: bool, tie: str) -> DataFrame:
    """df in order, without its first n rows. One task sees n rows' sort keys; the rows after the nth's keys are found by a filter, those of the same keys are counted off."""
    new, taken = [], {c.lower() for c in df.columns}
    for name in ("_0", "_1", "_n", "_skip"):
        while name in taken:
            name = "_" + name
        new.append(name)
    if tie in df.columns:
        second = _c(tie)
    else:  # any order of ties will do
        second = F.xxhash64(*[_c(f.name) for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))])
    columns = [_c(field), second]
    order = lambda a, b: [a.desc_nulls_first() if down else a.asc_nulls_last(), b.asc()]
    first = df.select(columns[0].alias(new[0]), columns[1].alias(new[1])).orderBy(*order(_c(new[0]), _c(new[1]))).limit(n)
    w = W.orderBy(*order(_c(new[0]), _c(new[1])))
    nth = first.select("*", F.row_number().over(w).alias(new[2]), (F.lit(n + 1) - F.rank().over(w)).alias(new[3])).where(_c(new[2]) == n)
    (x, a), (y, b) = zip(columns, (_c(new[0]), _c(new[1])), strict=True)
    after = x.isNotNull() & (a.isNull() | (x < a)) if down else a.isNotNull() & (x.isNull() | (x > a))
    later = y.isNotNull() & (b.isNull() | (y > b))
    held = df.crossJoin(F.broadcast(nth))
    same = held.where(x.eqNullSafe(a) & y.eqNullSafe(b)).withColumn(new[2], F.row_number().over(W.partitionBy(_c(new[0]), _c(new[1])).orderBy(_c(new[0])))).where(_c(new[2]) > _c(new[3]))
    out = held.where(after | (x.eqNullSafe(a) & later)).unionByName(same).select(*[_c(c) for c in df.columns])
    return out.orderBy(*order(columns[0], columns[1]))


@dataclass(frozen=True)
class Query:
    """A lazy query over a frame; every call returns a new one. to_dataframe() is the plan, the rest are actions."""

    df: DataFrame
    where: dict | None = None
    id_col: str = "_id"
    order_col: str | None = None
    sort_by: tuple[str, bool] | None = None
    skip_n: int = 0
    limit_n: int | None = None
    group_by: str | None = None
    aggs: tuple[Aggregate, ...] = ()
    embedder: Any = None
    text_index: Any = None

    def sort(self, field: str, descending: bool = False) -> Query:
        """One key; a later call replaces it. Nulls come last, or first if descending; ties go by id, after a group by its key."""
        return replace(self, sort_by=(field, descending))

    def skip(self, n: int) -> Query:
        return replace(self, skip_n=n)

    def limit(self, n: int) -> Query:
        return replace(self, limit_n=n)

    def group(self, field: str) -> Query:
        """Groups by one field; nulls are a group. Without agg: its distinct values."""
        return replace(self, group_by=field)

    def agg(self, *functions: Aggregate) -> Query:
        """Ignored without group."""
        return replace(self, aggs=functions)

    def filtered(self) -> DataFrame:
        return self.df if not self.where else self.df.where(self.predicate())

    def predicate(self) -> Column:
        return compile_filter(self.where, self.df.schema)

    def to_dataframe(self) -> DataFrame:
        out, tie = self.filtered(), self.id_col
        if self.group_by is not None:
            key = _c(self.group_by) if self.group_by in self.df.columns else F.lit(None).cast("string")
            order = _c(self.order_col or self.id_col) if (self.order_col or self.id_col) in self.df.columns else F.monotonically_increasing_id()
            g = out.groupBy(key.alias(self.group_by))
            out = g.agg(*[a.column(self.df.schema, order) for a in self.aggs]) if self.aggs else g.agg(F.lit(1).alias("_one")).drop("_one")
            tie = self.group_by
        if self.sort_by:
            field, down = self.sort_by
            key = _c(field) if field in out.columns else F.lit(None)
            keys = [key.desc_nulls_first() if down else key.asc_nulls_last()]
            if self.skip_n and self.skip_n <= SKIPPED and self.limit_n is None and field in out.columns:
                return _without_first(out, self.skip_n, field, down, tie)
            out = out.orderBy(*keys, *([_c(tie).asc()] if tie in out.columns and tie != field else []))
        if self.skip_n:
            out = out.offset(self.skip_n)
        return out if self.limit_n is None else out.limit(self.limit_n)

    def to_list(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.to_dataframe().collect()]

    def __iter__(self) -> Iterator[dict]:
        return (r.asDict(recursive=True) for r in self.to_dataframe().toLocalIterator())

    def first(self) -> dict | None:
        q = self if self.limit_n == 0 else self.limit(1)
        return next(iter(q.to_list()), None)

    def count(self) -> int:
        return self.to_dataframe().count()

    def exists(self) -> bool:
        return not self.to_dataframe().isEmpty()

    def to_df(self):
        """A pandas frame."""
        return self.to_dataframe().toPandas()

    def vector_search(self, field: str, vector: list[float], limit: int | None = 10, dim: int | None = None) -> Ranked:
        return Ranked(self.df.limit(0).withColumn("score", F.lit(0.0)) if field not in self.df.columns else vector_search(self.filtered(), field, vector, limit, self.id_col, dim))

    def text_search(self, field: str, query: str, limit: int | None = 10, analyzer: str = "english") -> Ranked:
        if self.text_index is not None:
            return Ranked(self.text_index.search(self.df, query, limit, self.id_col, self.predicate() if self.where else None, analyzer))
        return Ranked(text_search(self.df, field, query, limit, self.id_col, self.predicate() if self.where else None, analyzer))

    def hybrid_search(self, text_field: str, vector_field: str, text: str, vector: list[float] | None = None, limit: int | None = 10, analyzer: str = "english") -> Ranked:
        """vector_field may name the source of an embedded field; without a vector the text is embedded."""
        if vector is None:
            if self.embedder is None:
                raise ValueError("a vector is needed, as no embedder is configured")
            vector_field, vector = self.embedder.target_of(vector_field), self.embedder.embed_query(vector_field, text) if vector_field else []
        elif self.embedder is not None:
            vector_field = self.embedder.target_of(vector_field)
        return Ranked(hybrid_search(self.df, text_field, vector_field, text, vector, limit, self.id_col, self.predicate() if self.where else None, analyzer, self.text_index))

    def semantic(self, source: str, text: str, limit: int | None = 10) -> Ranked:
        """Searches the vectors embedded from a source field for a text."""
        if self.embedder is None:
            raise ValueError("no embedder is configured")
        return self.vector_search(self.embedder.target_of(source), self.embedder.embed_query(source, text), limit)


@dataclass(frozen=True)
class Ranked:
    """Ranked rows: the documents' columns and score."""

    df: DataFrame

    def to_dataframe(self) -> DataFrame:
        return self.df

    def to_list(self) -> list[tuple[dict, float]]:
        return [(d, d.pop("score")) for d in (r.asDict(recursive=True) for r in self.df.collect())]

    def first(self) -> tuple[dict, float] | None:
        return next(iter(Ranked(self.df.limit(1)).to_list()), None)


def find(df: DataFrame, where: dict | None = None, id_col: str = "_id", order_col: str | None = None, text_index: Any = None) -> Query:
    """A query over any frame; a wrong filter raises at once. text_index: a TextIndex of the field that text searches name."""
    compile_filter(where, df.schema)
    return Query(df, where, id_col, order_col, text_index=text_index)


def find_ex(df: DataFrame, where: dict | None, options: dict, id_col: str = "_id") -> Query:
    """The options form: sort (a field, or {field, descending}), skip, limit, group, agg ([{func, field}]); any other key is an error."""
    unknown = set(options) - {"sort", "skip", "limit", "group", "agg"}
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    q = find(df, where, id_col)
    if "sort" in options:
        s = options["sort"]
        q = q.sort(s) if isinstance(s, str) else q.sort(s["field"], bool(s.get("descending", False)))
    if "skip" in options:
        q = q.skip(int(options["skip"]))
    if "limit" in options:
        q = q.limit(int(options["limit"]))
    if "group" in options:
        q = q.group(options["group"])
    if "agg" in options:
        q = q.agg(*[AGGREGATES[a["func"]](*([a["field"]] if "field" in a else [])) for a in options["agg"]])
    return q
