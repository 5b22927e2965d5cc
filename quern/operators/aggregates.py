"""The eight aggregates of a group. Nulls and, for sum and mean, values that aren't numbers don't count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Aggregate:
    """func over field; its column is named func_field, or count."""

    func: str
    field: str | None = None

    @property
    def name(self) -> str:
        return self.func if self.field is None else f"{self.func}_{self.field}"

    def column(self, schema: T.StructType, order: Column) -> Column:
        """order says what comes first, for first, last and collect."""
        if self.func == "count":
            return F.count(F.lit(1)).alias("count")
        known = self.field in schema.names
        t = schema[self.field].dataType if known else T.StringType()
        c = F.col("`" + self.field.replace("`", "``") + "`") if known else F.lit(None).cast("string")
        if self.func in ("sum", "mean") and not isinstance(t, T.NumericType):
            c = F.lit(None).cast("double")
        if self.func == "sum":
            out = F.coalesce(F.sum(c), F.lit(0))
        elif self.func == "mean":
            out = F.avg(c)
        elif self.func in ("min", "max"):
            out = getattr(F, self.func)(c)
        elif self.func == "first":
            out = F.min_by(c, F.when(c.isNotNull(), _within(order, c, t)))
        elif self.func == "last":
            out = F.max_by(c, F.when(c.isNotNull(), _within(order, c, t)))
        elif self.func == "collect":
            pairs = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(order.alias("o"), c.alias("v")))))
            out = F.transform(pairs, lambda x: x["v"])
        else:
            raise ValueError(f"unknown aggregate {self.func}")
        return out.alias(self.name)


def _within(order: Column, c: Column, t: T.DataType) -> Column:
    """The order, and where rows tie in it, that of the values; maps have none."""
    return order if "map<" in t.simpleString() or "variant" in t.simpleString() else F.struct(order.alias("o"), c.alias("v"))


def count() -> Aggregate:
    return Aggregate("count")


def sum(field: str) -> Aggregate:  # noqa: A001
    return Aggregate("sum", field)


def mean(field: str) -> Aggregate:
    return Aggregate("mean", field)


avg = mean


def min(field: str) -> Aggregate:  # noqa: A001
    return Aggregate("min", field)


def max(field: str) -> Aggregate:  # noqa: A001
    return Aggregate("max", field)


def collect(field: str) -> Aggregate:
    return Aggregate("collect", field)


def first(field: str) -> Aggregate:
    return Aggregate("first", field)


def last(field: str) -> Aggregate:
    return Aggregate("last", field)
