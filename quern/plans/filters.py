"""Filter documents as boolean columns that are never NULL, so NOT, AND and OR are two-valued and leaves reach the scan.

Values of different classes (number, text, boolean, time, bytes, list, document) never match; null is absence.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidFilterError

LOGICAL = {"$and", "$or", "$not"}
FIELD = {"$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$elemMatch"}
#: name -> (column, type), or None for a field that isn't there
Scope = Callable[[str], "tuple[Column, T.DataType] | None"]


def validate(where: Any) -> None:
    """Raises InvalidFilterError unless where is a filter: unknown operators, operands of a wrong kind, operators mixed with fields."""
    if where is None:
        return
    if not isinstance(where, dict):
        raise InvalidFilterError("a filter is a document")
    for key, value in where.items():
        if not isinstance(key, str):
            raise InvalidFilterError("field names are strings")
        if key in ("$and", "$or"):
            if not isinstance(value, (list, tuple)):
                raise InvalidFilterError(f"{key} takes a list of filters")
            for sub in value:
                if not isinstance(sub, dict):
                    raise InvalidFilterError(f"{key} takes a list of filters")
                validate(sub)
        elif key == "$not":
            if not isinstance(value, dict):
                raise InvalidFilterError("$not takes a filter")
            validate(value)
        elif key.startswith("$"):
            raise InvalidFilterError(f"unknown operator {key}")
        elif is_operators(value):
            validate_operators(value)


def is_operators(value: Any) -> bool:
    return isinstance(value, dict) and any(isinstance(k, str) and k.startswith("$") for k in value)


def validate_operators(value: dict) -> None:
    for op, x in value.items():
        if op not in FIELD:
            raise InvalidFilterError(f"unknown operator {op}")
        if op in ("$in", "$nin") and not isinstance(x, (list, tuple, set, frozenset)):
            raise InvalidFilterError(f"{op} takes a list")
        if op == "$elemMatch":
            if not isinstance(x, dict):
                raise InvalidFilterError("$elemMatch takes a document")
            if is_operators(x) and not any(k in LOGICAL for k in x):
                validate_operators(x)
            else:
                validate(x)


def class_of_type(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    for kind, name in ((T.BooleanType, "boolean"), (T.BinaryType, "bytes"), (T.ArrayType, "list"), (T.StructType, "document")):
        if isinstance(t, kind):
            return name
    return "time" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "other"


def class_of(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float, Decimal)):
        return "number"
    if isinstance(value, str):
        return "text"
    if isinstance(value, (dt.datetime, dt.date)):
        return "time"
    if isinstance(value, (bytes, bytearray)):
        return "bytes"
    if isinstance(value, (list, tuple)):
        return "list"
    return "document" if isinstance(value, dict) else "other"


def literal(value: Any, t: T.DataType) -> Column:
    """A literal of the value, times as the column's own kind, in UTC."""
    if class_of(value) == "time":
        if isinstance(value, dt.datetime):
            if value.tzinfo is not None:
                value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        else:
            value = dt.datetime(value.year, value.month, value.day)
        if isinstance(t, T.TimestampType):
            return F.lit(value.isoformat(" ") + "+00:00").cast("timestamp")
        return F.lit(value.isoformat(" ")).cast("timestamp_ntz")
    if isinstance(value, bytes):
        return F.lit(bytearray(value))
    if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 63:
        return F.lit(float(value))
    return F.lit(value)


def equals(c: Column, t: T.DataType, value: Any) -> Column:
    if value is None:
        return c.isNull()
    kind = class_of_type(t)
    if kind != class_of(value):
        return F.lit(False)
    if kind == "list":
        parts = [equals(F.get(c, i), t.elementType, v) for i, v in enumerate(value)]
        return reduce(lambda a, b: a & b, parts, c.isNotNull() & F.coalesce(F.size(c) == len(value), F.lit(False)))
    if kind == "document":
        if not set(value) <= set(t.names):
            return F.lit(False)
        return reduce(lambda a, b: a & b, [equals(c[f.name], f.dataType, value.get(f.name)) for f in t.fields], c.isNotNull())
    if kind == "other":
        return F.lit(False)
    return c.eqNullSafe(literal(value, t))


def compares(c: Column, t: T.DataType, op: str, value: Any) -> Column:
    kind = class_of_type(t)
    if kind != class_of(value) or kind in ("list", "document", "other"):
        return F.lit(False)
    v = literal(value, t)
    return c.isNotNull() & {"$gt": c > v, "$gte": c >= v, "$lt": c < v, "$lte": c <= v}[op]


def among(c: Column, t: T.DataType, values: Any) -> Column:
    kind = class_of_type(t)
    same = [v for v in values if v is not None and class_of(v) == kind]
    if kind in ("list", "document"):
        hit = reduce(lambda a, b: a | b, [equals(c, t, v) for v in same], F.lit(False))
    else:
        hit = c.isNotNull() & c.isin([literal(v, t) for v in same]) if same and kind != "other" else F.lit(False)
    return hit | c.isNull() if any(v is None for v in values) else hit


def leaf(c: Column, t: T.DataType, op: str, value: Any) -> Column:
    if op == "$eq":
        return equals(c, t, value)
    if op == "$ne":
        return ~equals(c, t, value)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return compares(c, t, op, value)
    if op == "$in":
        return among(c, t, value)
    if op == "$nin":
        return ~among(c, t, value)
    if op == "$exists":
        return c.isNotNull() if value else c.isNull()
    if not isinstance(t, T.ArrayType):
        return F.lit(False)
    inner = t.elementType
    if not value:
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if is_operators(value) and not any(k in LOGICAL for k in value):
        return F.coalesce(F.exists(c, lambda x: operators(x, inner, value)), F.lit(False))
    if not isinstance(inner, T.StructType):
        return F.lit(False)
    types = {f.name: f.dataType for f in inner.fields}
    return F.coalesce(F.exists(c, lambda x: x.isNotNull() & compile_in(value, lambda n: (x[n], types[n]) if n in types else None)), F.lit(False))


def operators(c: Column, t: T.DataType, value: dict) -> Column:
    return reduce(lambda a, b: a & b, [leaf(c, t, op, x) for op, x in value.items()])


def compile_in(where: dict | None, scope: Scope) -> Column:
    out = []
    for key, value in (where or {}).items():
        if key == "$and":
            out.append(reduce(lambda a, b: a & b, [compile_in(s, scope) for s in value], F.lit(True)))
        elif key == "$or":
            out.append(reduce(lambda a, b: a | b, [compile_in(s, scope) for s in value], F.lit(False)))
        elif key == "$not":
            out.append(~compile_in(value, scope))
        else:
            c, t = scope(key) or (F.lit(None).cast("string"), T.StringType())
            out.append(operators(c, t, value) if is_operators(value) else equals(c, t, value))
    return reduce(lambda a, b: a & b, out, F.lit(True))


def compile_filter(where: dict | None, schema: T.StructType) -> Column:
    """A column over frames of this schema. Names are taken literally, there are no paths; a field not in the schema is absent everywhere."""
    validate(where)
    types = {f.name: f.dataType for f in schema.fields}
    return compile_in(where, lambda n: (F.col("`" + n.replace("`", "``") + "`"), types[n]) if n in types else None)


class Field:
    """Builds filters: Field("age") >= 18 is {"age": {"$gte": 18}}."""

    def __init__(self, name: str):
        self.name = name

    def _op(self, op: str, value: Any) -> dict:
        return {self.name: {op: value}}

    def __eq__(self, v):  # type: ignore[override]
        return self._op("$eq", v)

    def __ne__(self, v):  # type: ignore[override]
        return self._op("$ne", v)

    def __gt__(self, v):
        return self._op("$gt", v)

    def __ge__(self, v):
        return self._op("$gte", v)

    def __lt__(self, v):
        return self._op("$lt", v)

    def __le__(self, v):
        return self._op("$lte", v)

    __hash__ = None  # type: ignore[assignment]

    def isin(self, values: list) -> dict:
        return self._op("$in", values)

    def notin(self, values: list) -> dict:
        return self._op("$nin", values)

    def exists(self, there: bool = True) -> dict:
        return self._op("$exists", there)

    def elem_match(self, sub: dict) -> dict:
        return self._op("$elemMatch", sub)


def all_of(*filters: dict) -> dict:
    return {"$and": list(filters)}


def any_of(*filters: dict) -> dict:
    return {"$or": list(filters)}


def none_of(where: dict) -> dict:
    return {"$not": where}
