"""The tokenizer of text search, as a column and in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATTERN = r"[a-zA-Z0-9]+(?:[._-][a-zA-Z0-9]+)*"


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; one joined by . _ - gives its parts and then itself; single characters are dropped. Null: none."""
    def split(t: Column) -> Column:
        parts = F.filter(F.split(t, "[._-]"), lambda p: F.length(p) > 1)
        return F.when(t.rlike("[._-]"), F.concat(parts, F.array(t))).when(F.length(t) > 1, F.array(t)).otherwise(F.array().cast("array<string>"))

    raw = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.coalesce(F.flatten(F.transform(raw, lambda t: split(F.lower(t)))), F.array().cast("array<string>"))


def tokens_of(text: str) -> list[str]:
    out = []
    for m in re.finditer(PATTERN, text):
        t = m.group().lower()
        parts = re.split("[._-]", t)
        if len(parts) > 1:
            out += [p for p in parts if len(p) > 1] + [t]
        elif len(t) > 1:
            out.append(t)
    return out


def flat_text(c: Column, t: T.DataType) -> Column:
    """What of a field is searched: strings; numbers and booleans as text; lists, flattened, joined by a space."""
    if isinstance(t, T.StringType):
        return c
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, T.ArrayType):
            return flat_text(F.flatten(c), T.ArrayType(t.elementType.elementType))
        if isinstance(t.elementType, (T.StringType, T.NumericType, T.BooleanType)):
            return F.concat_ws(" ", F.transform(c, lambda x: x.cast("string")))
        return F.lit(None).cast("string")
    return c.cast("string") if isinstance(t, (T.NumericType, T.BooleanType)) else F.lit(None).cast("string")
