"""The BSON subset of the data model, from its public specification, and the framed log: length, type, document."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EPOCH = dt.datetime(1970, 1, 1)


def encode(doc: dict) -> bytes:
    body = b"".join(_element(str(k), v) for k, v in doc.items())
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def _element(name: str, v) -> bytes:
    kind, data = _value(v)
    return bytes([kind]) + name.encode() + b"\0" + data


def _value(v) -> tuple[int, bytes]:
    if v is None:
        return 0x0A, b""
    if isinstance(v, bool):
        return 0x08, bytes([v])
    if isinstance(v, int):
        return (0x10, struct.pack("<i", v)) if -(1 << 31) <= v < 1 << 31 else (0x12, struct.pack("<q", v))
    if isinstance(v, float):
        return 0x01, struct.pack("<d", v)
    if isinstance(v, str):
        b = v.encode()
        return 0x02, struct.pack("<i", len(b) + 1) + b + b"\0"
    if isinstance(v, (bytes, bytearray)):
        return 0x05, struct.pack("<i", len(v)) + b"\0" + bytes(v)
    if isinstance(v, dt.datetime):
        if v.tzinfo is not None:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return 0x09, struct.pack("<q", round((v - EPOCH) / dt.timedelta(milliseconds=1)))
    if isinstance(v, dict):
        return 0x03, encode(v)
    if isinstance(v, (list, tuple)):
        return 0x04, encode({str(i): x for i, x in enumerate(v)})
    raise TypeError(f"no BSON for {type(v).__name__}")


def decode(b: bytes) -> dict:
    return _document(b, 0)[0]


def _document(b: bytes, at: int) -> tuple[dict, int]:
    end = at + struct.unpack_from("<i", b, at)[0]
    at, out = at + 4, {}
    while b[at]:
        kind, stop = b[at], b.index(b"\0", at + 1)
        name = b[at + 1 : stop].decode()
        out[name], at = _read(b, kind, stop + 1)
    return out, end


def _read(b: bytes, kind: int, at: int):
    if kind == 0x01:
        return struct.unpack_from("<d", b, at)[0], at + 8
    if kind in (0x02, 0x0D):
        n = struct.unpack_from("<i", b, at)[0]
        return b[at + 4 : at + 3 + n].decode(), at + 4 + n
    if kind == 0x03:
        return _document(b, at)
    if kind == 0x04:
        d, at = _document(b, at)
        return list(d.values()), at
    if kind == 0x05:
        n = struct.unpack_from("<i", b, at)[0]
        return b[at + 5 : at + 5 + n], at + 5 + n
    if kind == 0x07:
        return b[at : at + 12].hex(), at + 12
    if kind == 0x08:
        return bool(b[at]), at + 1
    if kind == 0x09:
        return EPOCH + dt.timedelta(milliseconds=struct.unpack_from("<q", b, at)[0]), at + 8
    if kind == 0x0A:
        return None, at
    if kind == 0x10:
        return struct.unpack_from("<i", b, at)[0], at + 4
    if kind == 0x11:
        inc, time = struct.unpack_from("<II", b, at)
        return {"time": time, "inc": inc}, at + 8
    if kind == 0x12:
        return struct.unpack_from("<q", b, at)[0], at + 8
    raise ValueError(f"unknown BSON type {kind}")


def frame(op: int, doc: dict) -> bytes:
    b = encode(doc)
    return struct.pack("<IB", len(b), op) + b


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, type, document) of whole records; a torn tail ends it."""
    at = 0
    while at + 5 <= len(data):
        n, op = struct.unpack_from("<IB", data, at)
        if at + 5 + n > len(data):
            return
        yield at, op, data[at + 5 : at + 5 + n]
        at += 5 + n


def frames_of(path: str) -> Iterator[tuple[int, int, bytes]]:
    """frames() of a file, one record in memory at a time."""
    at = 0
    with open(path, "rb", buffering=1 << 20) as f:
        while len(head := f.read(5)) == 5:
            n, op = struct.unpack("<IB", head)
            b = f.read(n)
            if len(b) < n:
                return
            yield at, op, b
            at += 5 + n


class FramedLog(DataSource):
    """spark.read.format("framedlog").load(file or directory): _seq (the offset), _op, _id, doc as JSON. One file, one partition, streamed: records have no marks by which a file could be split."""

    @classmethod
    def name(cls) -> str:
        return "framedlog"

    def schema(self) -> str:
        return "_seq bigint, _op int, _id string, doc string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file:")

    def partitions(self) -> list[InputPartition]:
        import os

        files = sorted(os.path.join(self.path, f) for f in os.listdir(self.path)) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in files]

    def read(self, partition):
        import json

        for at, op, b in frames_of(partition.value):
            doc = decode(b)
            yield at, op, doc.get("_id"), json.dumps(doc, default=lambda v: v.isoformat() if hasattr(v, "isoformat") else v.hex())
