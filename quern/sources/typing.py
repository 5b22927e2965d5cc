"""Spark types of Python documents."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

from ..errors import InvalidDocumentError


def type_of(value: Any) -> T.DataType:
    """Whole numbers are longs, others doubles; times are without zone, in UTC."""
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, Decimal):
        return T.DecimalType(38, 18)
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, (bytes, bytearray)):
        return T.BinaryType()
    if isinstance(value, dt.datetime):
        return T.TimestampNTZType()
    if isinstance(value, dt.date):
        return T.DateType()
    if isinstance(value, (list, tuple)):
        t: T.DataType = T.NullType()
        for v in value:
            t = unify(t, type_of(v))
        return T.ArrayType(t)
    if isinstance(value, dict):
        return T.StructType([T.StructField(str(k), type_of(v)) for k, v in value.items()])
    raise InvalidDocumentError(f"no type for {type(value).__name__}")


def unify(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both; longs widen to doubles."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(unify(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        types = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            types[f.name] = unify(types.get(f.name, T.NullType()), f.dataType)
        return T.StructType([T.StructField(k, t) for k, t in types.items()])
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    raise InvalidDocumentError(f"a field holds both {a.simpleString()} and {b.simpleString()}")


def settled(t: T.DataType) -> T.DataType:
    """Fields that only ever were null count as text."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(settled(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, settled(f.dataType)) for f in t.fields])
    return t


def fitted(value: Any, t: T.DataType) -> Any:
    """The value as Spark wants it for this type."""
    if value is None:
        return None
    if isinstance(t, T.DoubleType):
        return float(value)
    if isinstance(t, T.ArrayType):
        return [fitted(v, t.elementType) for v in value]
    if isinstance(t, T.StructType):
        return tuple(fitted(value.get(f.name), f.dataType) for f in t.fields)
    if isinstance(t, T.TimestampNTZType) and value.tzinfo is not None:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return bytearray(value) if isinstance(t, T.BinaryType) else value
