"""Harmonic packing: lengths fall into reciprocal-capacity classes, and each class's bins take a fixed number of pieces, on every worker by itself."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, spread, table, written

CAPACITY, END_ID, SLACK, CACHE = 2048, 1, 64, 200_000
#: workers whose open bins are filled together, again and again until all are together
FAN_IN = 256


class _Words(dict):
    """Ids, as packed bytes, of a word with the space before it; words that the splitter doesn't end at raise."""

    def __init__(self, core, lead: str):
        self.core, self.lead = core, lead

    def __missing__(self, w: str) -> bytes:
        if not w or w[0].isspace() or w[-1].isspace():
            raise ValueError
        ids = np.array(self.core.encode_ordinary(self.lead + w), dtype="<u4").tobytes()
        if len(self) < CACHE:
            self[w] = ids
        return ids


class Encoder:
    """Byte-level BPE over a rank file that holds the vocabulary of the tokenizer file beside it.

    Its splitter ends a piece before a lone space between two non-spaces and around a lone newline between two
    non-spaces, so words between those are encoded once and kept (CACHE words a worker, others encoded each time).
    Other white space (runs, spaces at line ends, three newlines) has the whole text encoded at once.
    """

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers as P
        import tiktoken

        path = vocabulary or P.path("byte_bpe_50k.json")
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take what stands beside them aren't supported")
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in added}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.core = tiktoken.Encoding("byte_bpe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.rest = _Words(self.core, ""), _Words(self.core, " ")
        self.newline = np.array(self.core.encode_ordinary("\n"), dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The text's ids as packed() gives them, but for added tokens of the file, as "<|endoftext|>", which are an id each."""
        if self.split is None or not any(a in text for a in self.added):
            return self.packed(text)
        return b"".join(self.added[x] if i % 2 else self.packed(x) for i, x in enumerate(self.split.split(text)) if x)

    def packed(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers; added tokens are text as any other."""
        try:
            if "\n\n\n" in text or text.endswith("\n\n"):
                raise ValueError
            first, rest, out = self.first, self.rest, []
            for i, line in enumerate(text.split("\n")):
                if i:
                    out.append(self.newline)
                if line:
                    w = line.split(" ")
                    out.append(first[w[0]])
                    out += map(rest.__getitem__, w[1:])
            return b"".join(out)
        except ValueError:
            return np.array(self.core.encode_ordinary(text), dtype="<u4").tobytes()


_ENCODERS: dict = {}


def encoder(vocabulary: str | None) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def cuts(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens. Class j holds j pieces a bin, each at most capacity / j long.

    Full bins first. A rest within 1/slack of its class's bound stays whole; else its largest reciprocal capacity//j is
    cut off it. So a full bin of any class wastes about 1/slack at most, and a document is cut a few times only.
    """
    out = [(capacity, 1)] * (n // capacity)
    r = n % capacity
    while r:
        j = capacity // r
        if r * j * slack >= capacity * (slack - 1):
            out.append((r, j))
            break
        j = -(-capacity // r)
        out.append((capacity // j, j))
        r -= capacity // j
    return out


def _pieces(vocabulary: str | None, capacity: int, slack: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        from pyspark import TaskContext

        part, made, row = TaskContext.get().partitionId(), 0, -1
        end = np.array([END_ID], dtype="<u4").tobytes()
        held: dict[int, list[tuple]] = {}  # what the open bin of each class holds
        kind = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows)) if rows else [()] * (len(NAMES) - 1 + with_ids)
            return pa.RecordBatch.from_arrays([pa.array(c[0], kind), *(pa.array(x, pa.int64()) for x in c[1:10]), pa.array(c[10], pa.bool_()), *([pa.array(c[11], pa.binary())] if with_ids else [])], names=NAMES[: 11 + with_ids])

        for b in batches:
            kind, out = b.column(0).type, []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.ids(t or "") + end
                n, at, row = len(ids) // 4, 0, row + 1
                for length, j in cuts(n, capacity, slack):
                    mine = held.setdefault(j, [])
                    if not mine:
                        made += 1
                    piece = ids[4 * at : 4 * (at + length)]
                    mine.append((d, at, length, zlib.crc32(piece), n, mine[-1][5] if mine else (part << 40) + made, j, len(mine), mine[-1][8] + mine[-1][2] if mine else 0, (part << 40) + row, False, *([piece] if with_ids else [])))
                    at += length
                    if len(mine) == j:
                        out += mine
                        held[j] = []
            yield batch(out)
        if kind is not None:
            yield batch([(*x[:10], True, *x[11:]) for mine in held.values() for x in mine])

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "class", "slot", "offset", "row_id", "open", "ids"]


def _last_bins(capacity: int):
    """Packs what every worker's open bins hold: by class again, then the open bins of all classes first-fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "bin", "slot"], ascending=[False, True, True], kind="stable")
        room, seq = [], []
        start = 0  # bins before this one are full
        for n in pdf["length"]:
            k = next((k for k in range(start, len(room)) if room[k] >= n), len(room))
            if k == len(room):
                room.append(capacity)
            room[k] -= n
            while start < len(room) and not room[start]:
                start += 1
            seq.append(k)
        pdf["sequence_id"] = -1 - np.array(seq, dtype=np.int64) if len(seq) else np.array([], dtype=np.int64)
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, slack: int = SLACK, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row_id, and ids (packed bytes) if asked for.

    Each worker tokenizes its rows and fills its own bins; nothing is shuffled for those that get full. Of each class a
    worker leaves one open bin at most. The open bins of FAN_IN workers are filled together, by class, then those of
    FAN_IN such groups, and so on: no task gets more than FAN_IN open bins of a class, and in the end one bin a class
    is open, which is packed first-fit. Pieces are written to the shared folder before they are read twice, so tokens
    are made once and a lost executor can't mix two runs' bins.
    Null and empty texts: the end id alone. Repeated rows are packed as often as they come, each
    under a row_id of its own, so (row_id, start) is a key where doc_ids repeat. Very long texts are cut, never left. No rows: no rows.
    The same text gives the same ids wherever it lies; sequence ids depend on how rows lie in files.
    """
    kind = T.StructType([T.StructField("doc_id", docs.select(col(id_col)).schema[0].dataType), *[T.StructField(n, T.LongType()) for n in NAMES[1:10]], T.StructField("open", T.BooleanType()), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    p = written(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(_pieces(vocabulary, capacity, slack, with_ids), kind), "pieces")
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_id", *(["ids"] if with_ids else [])]
    more = T.StructType([*kind.fields, T.StructField("sequence_id", T.LongType())])
    fields = [f.name for f in more.fields]

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin", "slot"], kind="stable").reset_index(drop=True)
        j, at = int(pdf["class"].iloc[0]), np.arange(len(pdf))
        pdf["slot"], pdf["sequence_id"], pdf["open"] = at % j, pdf["bin"].to_numpy()[at // j * j] * 4 + 1, at >= len(pdf) // j * j
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf[fields]

    last_task = (p.agg(F.max("bin").alias("bin")).first()["bin"] or 0) >> 40
    out, rest, tasks = [p.where("not open").withColumn("sequence_id", F.col("bin") * 4)], p.where("open"), 1
    while True:
        tasks *= FAN_IN
        rest = written(rest.select(*p.columns, F.floor(F.shiftright("bin", 40) / tasks).alias("of")).groupBy("class", "of").applyInPandas(again, more), "open")
        out.append(rest.where("not open"))
        rest = rest.where("open").drop("sequence_id")
        if tasks > last_task:
            break
    out.append(rest.groupBy().applyInPandas(lambda pdf: _last_bins(capacity)(pdf)[fields], more))
    return reduce(DataFrame.unionByName, [o.select(keep) for o in out])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents in their sequences."""
    return pack(docs)
