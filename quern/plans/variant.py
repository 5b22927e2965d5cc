"""Filters, sorts and groups over documents whose fields mix types, kept in one VARIANT column.

A field is read as the class that the literal has, and is absent for it if it holds another; so numbers never match
text. VARIANT can't be compared by Spark: sorts and groups go by (rank of the class, number, text).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import LOGICAL, class_of, is_operators, leaf, validate

TYPES = {"number": T.DoubleType(), "text": T.StringType(), "boolean": T.BooleanType(), "time": T.TimestampNTZType(), "bytes": T.BinaryType()}
KINDS = {"number": "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$", "text": "^STRING$", "boolean": "^BOOLEAN$", "time": "^(TIMESTAMP|TIMESTAMP_NTZ|DATE)$", "bytes": "^BINARY$"}
RANK = ["boolean", "number", "text", "time", "bytes"]


def field(doc: Column, name: str) -> Column:
    """The field as VARIANT; names are literal. No path says a name with both kinds of quotes: such a field is absent."""
    if "'" in name and '"' in name:
        return F.lit(None).cast("variant")
    return F.try_variant_get(doc, f'$["{name}"]' if "'" in name else f"$['{name}']", "variant")


def typed(v: Column, kind: str) -> Column:
    """The value as this class's type, or null if it is of another."""
    return F.when(F.schema_of_variant(v).rlike(KINDS[kind]), F.try_variant_get(v, "$", TYPES[kind].simpleString()))


def there(v: Column) -> Column:
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False))


def variant_leaf(v: Column, op: str, value: Any) -> Column:
    if op == "$ne":
        return ~variant_leaf(v, "$eq", value)
    if op == "$nin":
        return ~variant_leaf(v, "$in", value)
    if op == "$exists":
        return there(v) if value else ~there(v)
    if op == "$in":
        return reduce(lambda a, b: a | b, [variant_leaf(v, "$eq", x) for x in value], F.lit(False))
    if op == "$elemMatch":
        xs = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        if not value:
            return F.coalesce(F.size(xs) > 0, F.lit(False))
        if is_operators(value) and not any(k in LOGICAL for k in value):
            return F.coalesce(F.exists(xs, lambda x: reduce(lambda a, b: a & b, [variant_leaf(x, o, y) for o, y in value.items()])), F.lit(False))
        return F.coalesce(F.exists(xs, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)) & compile_in(value, lambda n: field(x, n))), F.lit(False))
    if value is None:
        return ~there(v) if op == "$eq" else F.lit(False)
    kind = class_of(value)
    if kind in ("list", "document"):
        import json

        return F.coalesce(F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value)))), F.lit(False)) if op == "$eq" else F.lit(False)
    if kind not in TYPES:
        return F.lit(False)
    return leaf(typed(v, kind), TYPES[kind], op, value)


def compile_in(where: dict | None, scope: Callable[[str], Column]) -> Column:
    out = []
    for key, value in (where or {}).items():
        if key == "$and":
            out.append(reduce(lambda a, b: a & b, [compile_in(s, scope) for s in value], F.lit(True)))
        elif key == "$or":
            out.append(reduce(lambda a, b: a | b, [compile_in(s, scope) for s in value], F.lit(False)))
        elif key == "$not":
            out.append(~compile_in(value, scope))
        elif is_operators(value):
            out += [variant_leaf(scope(key), o, x) for o, x in value.items()]
        else:
            out.append(variant_leaf(scope(key), "$eq", value))
    return reduce(lambda a, b: a & b, out, F.lit(True))


def compile_variant(where: dict | None, doc: str = "doc") -> Column:
    """A never-NULL column over frames with a VARIANT column; numbers compare as doubles."""
    validate(where)
    return compile_in(where, lambda n: field(F.col(doc), n))


def sort_key(doc: str, name: str) -> Column:
    """Orders values of mixed classes: by class, then by value; null where the field is absent."""
    v = field(F.col(doc), name)
    rank = reduce(lambda c, k: c.when(F.schema_of_variant(v).rlike(KINDS[k]), F.lit(RANK.index(k))), RANK[1:], F.when(F.schema_of_variant(v).rlike(KINDS[RANK[0]]), F.lit(0))).otherwise(F.lit(len(RANK)))
    return F.when(there(v), F.struct(rank.alias("rank"), typed(v, "number").alias("number"), F.coalesce(typed(v, "text"), F.to_json(v)).alias("text")))


def find_variant(df: DataFrame, where: dict | None, doc: str = "doc") -> DataFrame:
    return df.where(compile_variant(where, doc))


def distinct_values(df: DataFrame, name: str, doc: str = "doc") -> DataFrame:
    """The field's values, one row each as JSON text, with how many documents have it; absent: null."""
    return df.groupBy(sort_key(doc, name).alias("k")).agg(F.first(F.when(there(field(F.col(doc), name)), F.to_json(field(F.col(doc), name))), ignorenulls=True).alias("value"), F.count(F.lit(1)).alias("count")).select("value", "count")
