"""Quantised vectors as columns: codes are arrays of numbers, of packed bits for binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISIONS = ("f32", "int8", "uint8", "binary")


def _doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def quantize(c: Column, precision: str) -> Column:
    """int8: x * 127 over the largest magnitude, rounded (all zeros stay so). uint8: min to max on 0 to 255, rounded (one value: 128). binary: bit i % 8 of byte i / 8 is set if x >= 0. f32: floats."""
    if precision == "f32":
        return F.transform(c, lambda x: x.cast("float"))
    d = _doubles(c)
    if precision == "int8":
        most = F.array_max(F.transform(d, F.abs))
        return F.transform(d, lambda x: F.when(most == 0, F.lit(0)).otherwise(F.greatest(F.least(F.round(x * (F.lit(127.0) / most)), F.lit(127.0)), F.lit(-128.0))).cast("int"))
    if precision == "uint8":
        low, high = F.array_min(d), F.array_max(d)
        return F.transform(d, lambda x: F.when(high == low, F.lit(128)).otherwise(F.greatest(F.least(F.round((x - low) * (F.lit(255.0) / (high - low))), F.lit(255.0)), F.lit(0.0))).cast("int"))
    if precision == "binary":
        bits = F.transform(d, lambda x, i: F.when(x >= 0, F.lit(1)).otherwise(F.lit(0)))
        bytes_ = F.sequence(F.lit(0), F.floor((F.size(d) + 7) / 8).cast("int") - 1)
        return F.transform(bytes_, lambda b: F.aggregate(F.transform(F.slice(bits, b * 8 + 1, F.lit(8)), lambda x, i: (x * F.pow(F.lit(2), i)).cast("int")), F.lit(0), lambda s, x: s + x))
    raise ValueError(f"unknown precision {precision}")


def dequantize(codes: Column, precision: str, dims: int | None = None) -> Column:
    """int8: v / 127. uint8: (v - 128) / 128. binary: 1 or -1, dims of them."""
    if precision == "f32":
        return codes
    if precision == "int8":
        return F.transform(codes, lambda v: v / F.lit(127.0))
    if precision == "uint8":
        return F.transform(codes, lambda v: (v - F.lit(128.0)) / F.lit(128.0))
    if precision == "binary":
        n = F.lit(dims) if dims is not None else F.size(codes) * 8
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.getbit(F.get(codes, F.floor(i / 8).cast("int")), i % 8) == 1, F.lit(1.0)).otherwise(F.lit(-1.0)))
    raise ValueError(f"unknown precision {precision}")


def hamming_cosine(a: Column, b: Column, dims: int) -> Column:
    """Of binary codes: 1 - 2 * differing bits / dims."""
    diff = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.lit(1.0) - F.lit(2.0) * diff / F.lit(float(dims))


def storage_size(dims: int, precision: str) -> int:
    """Bytes a vector."""
    return {"f32": 4 * dims, "int8": dims, "uint8": dims, "binary": (dims + 7) // 8}[precision]


def round_trip(vector: list[float], precision: str) -> list[float]:
    """What a query vector becomes when quantised and read back, on the driver."""
    if precision == "f32" or not vector:
        return [float(x) for x in vector]
    half = lambda x: int(x + 0.5) if x >= 0 else -int(-x + 0.5)
    if precision == "int8":
        most = max(map(abs, vector))
        return [max(-128, min(127, half(x * 127.0 / most))) / 127.0 if most else 0.0 for x in vector]
    if precision == "uint8":
        low, high = min(vector), max(vector)
        return [((max(0, min(255, half((x - low) * 255.0 / (high - low)))) if high > low else 128) - 128) / 128 for x in vector]
    return [1.0 if x >= 0 else -1.0 for x in vector]
