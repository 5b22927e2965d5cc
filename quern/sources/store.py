"""A collection: a log of typed Parquet commits under a manifest, read as the last record of each _id.

A commit is a directory that executors write; the manifest that names it is replaced in one rename, which is the commit
point, so directories of writers that died are never read. Writers take a lock file and check the manifest's version.
A batch commits to a manifest of its own, which takes the place of the last one at its end. Checkpoints hold the live
documents as of some commit: reads take what came later from the log, and need no shuffle where nothing did.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConflictError, DuplicateIdError, InvalidDocumentError, InvalidIdError, NoMatchError, ReadOnlyError
from ..operators.embedding import Embedder
from ..operators.text_index import LAYOUT, TextIndex
from ..plans.filters import compile_filter, validate
from ..plans.query import Query, Ranked, find
from .typing import fitted, settled, type_of, unify

LIVE, GONE, CHANGED = 1, 2, 3
DURABILITY = ("none", "os", "fsync")
#: commits after a checkpoint from which close() writes another
CHECKPOINT_AFTER = 8


def replay(log: DataFrame, seq: str = "_seq", op: str = "_op", id_col: str = "_id") -> DataFrame:
    """The live rows of a log: of each id the record with the highest seq, unless that is a tombstone. One aggregate, combined before its shuffle."""
    rest = [c for c in log.columns if c != id_col]
    last = log.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return last.where(F.col(f"_last.{op}") != GONE).select(id_col, *[F.col("_last")[c].alias(c) for c in rest])


def changed(df: DataFrame, set: dict | None = None, unset: list | None = None, inc: dict | None = None) -> DataFrame:  # noqa: A002
    """df with fields set, then unset, then incremented, from 0 where absent. _id can't change; only numbers can be incremented."""
    for name in [*(set or {}), *(unset or []), *(inc or {})]:
        if name == "_id":
            raise InvalidIdError("_id can't change")
    for name, value in (set or {}).items():
        t = settled(type_of(value))
        df = df.withColumn(name, _lit(value, settled(unify(df.schema[name].dataType, t)) if name in df.columns else t))
    for name in unset or []:
        if name in df.columns:
            df = df.withColumn(name, F.lit(None).cast(df.schema[name].dataType))
    for name, by in (inc or {}).items():
        if isinstance(by, bool) or not isinstance(by, (int, float)):
            raise InvalidDocumentError("only numbers can be added")
        if name in df.columns and not isinstance(df.schema[name].dataType, T.NumericType):
            raise InvalidDocumentError(f"{name} isn't a number")
        df = df.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit(0)) + F.lit(by) if name in df.columns else F.lit(by).cast(settled(type_of(by))))
    return df


def _lit(value: Any, t: T.DataType):
    if isinstance(value, dict):
        return F.struct(*[_lit(value.get(f.name), f.dataType).alias(f.name) for f in t.fields])
    if isinstance(value, (list, tuple)):
        return F.array(*[_lit(v, t.elementType) for v in value]).cast(t)
    return F.lit(bytearray(value) if isinstance(value, bytes) else value).cast(t)


class Collection:
    """Documents by _id, kept in a directory."""

    def __init__(self, spark: SparkSession, path: str, indexes: list[str] = (), vector_indexes: dict[str, int] | None = None, text_indexes: list[str] = (), readonly: bool = False, durability: str = "os", auto_embed: dict | None = None):
        if durability not in DURABILITY:
            raise ValueError(f"unknown durability {durability}")
        self.spark, self.path, self.readonly, self.durability = spark, path, readonly, durability
        self.embedder = Embedder(auto_embed) if auto_embed else None
        self._pending: dict | None = None
        self._doomed: list[str] = []
        if not readonly:
            os.makedirs(path, exist_ok=True)
        self.meta = self._merged({"indexes": list(indexes), "vector_indexes": dict(vector_indexes or {}), "text_indexes": list(text_indexes)})

    # manifest

    def _manifest(self) -> dict:
        try:
            with open(os.path.join(self.path, "manifest.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return {"version": 0, "next": 0, "commits": [], "schema": T.StructType([T.StructField("_id", T.StringType())]).json(), "meta": {}}

    def _state(self) -> dict:
        """The manifest that verbs go by: in a batch, its own."""
        return self._manifest() if self._pending is None else self._pending

    def _merged(self, declared: dict) -> dict:
        """Stored and declared indexes together; a stored vector width wins."""
        old = self._manifest()["meta"]
        return {"indexes": sorted({*old.get("indexes", []), *declared["indexes"]}), "text_indexes": sorted({*old.get("text_indexes", []), *declared["text_indexes"]}), "vector_indexes": {**declared["vector_indexes"], **old.get("vector_indexes", {})}}

    def _replace(self, m: dict, version: int) -> None:
        if self._pending is not None:
            self._pending = m
            return
        if self._manifest()["version"] != version:
            raise ConflictError("another writer committed")
        m = m | {"version": version + 1, "meta": self.meta}
        tmp = os.path.join(self.path, f".manifest-{uuid.uuid4().hex}")
        with open(tmp, "w") as f:
            json.dump(m, f)
            f.flush()
            if self.durability == "fsync":
                os.fsync(f.fileno())
        os.replace(tmp, os.path.join(self.path, "manifest.json"))
        self._flushed(self.path)

    def _flushed(self, *paths: str) -> None:
        """Has folders, and the files in them, reach the disk, if that is what the collection promises."""
        for path in paths if self.durability == "fsync" else ():
            for x in [path, *(os.path.join(path, f) for f in os.listdir(path))]:
                if x == path or os.path.isfile(x):
                    d = os.open(x, os.O_RDONLY)
                    os.fsync(d)
                    os.close(d)

    def _drop(self, names: list[str]) -> None:
        """Takes folders away once no manifest names them, at a batch's end if one is open."""
        if self._pending is not None:
            self._doomed += names
        else:
            for n in names:
                shutil.rmtree(os.path.join(self.path, n), ignore_errors=True)

    @contextmanager
    def _writing(self):
        if self.readonly:
            raise ReadOnlyError("the collection is open for reading")
        if self._pending is not None:  # a batch holds the lock already
            yield self._pending
            return
        with open(os.path.join(self.path, ".lock"), "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield self._manifest()

    # reading

    def _schema(self, m: dict | None = None) -> T.StructType:
        return T.StructType.fromJson(json.loads((m or self._manifest())["schema"]))

    def log(self, m: dict | None = None) -> DataFrame:
        """All records: _seq, _op and the documents' columns."""
        m = m or self._manifest()
        schema = T.StructType([T.StructField("_seq", T.LongType()), T.StructField("_op", T.ByteType()), *self._schema(m).fields])
        if not m["commits"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[os.path.join(self.path, c) for c in m["commits"]])

    def snapshot(self, m: dict | None = None) -> DataFrame:
        """Live documents, with _seq: the last checkpoint's, but for ids that later commits hold, and theirs."""
        m = m or self._manifest()
        held = m.get("checkpoint")
        if not held:
            return replay(self.log(m)).drop("_op")
        base, later = self.log(m | {"commits": [held["name"]]}).drop("_op"), m["commits"][held["commits"] :]
        if not later:
            return base
        log = self.log(m | {"commits": later})
        return base.join(log.select("_id").distinct(), "_id", "left_anti").select(*base.columns).unionByName(replay(log).drop("_op"))

    def mark(self) -> list[str]:
        """Where the log ends now, for since()."""
        return list(self._manifest()["commits"])

    def since(self, mark: list[str]) -> DataFrame:
        """The last record of each id committed after the mark: _op, _id and the documents' columns. Reads the new commits alone; after a compaction, which ends what marks stand for, the whole log."""
        m = self._manifest()
        fine = m["commits"][: len(mark)] == mark
        log = self.log(m | {"commits": m["commits"][len(mark) if fine else 0 :]})
        rest = [c for c in log.columns if c != "_id"]
        last = log.groupBy("_id").agg(F.max_by(F.struct(*rest), F.col("_seq")).alias("_last"))
        return last.select("_id", *[F.col("_last")[c].alias(c) for c in rest if c != "_seq"])

    def to_dataframe(self) -> DataFrame:
        return self.snapshot().drop("_seq")

    def find(self, where: dict | None = None) -> Query:
        """A query over the last commit; what an open batch holds isn't seen."""
        m = self._manifest()
        df = self.snapshot(m)
        compile_filter(where, df.schema)
        widths = {**{c.target: c.dims for c in (self.embedder.configs.values() if self.embedder else ())}, **self.meta["vector_indexes"]}
        return _Documents(df, where, "_id", "_seq", embedder=self.embedder, widths=widths, texts=tuple(self.meta["text_indexes"]), indexes=self._text_indexes(m))

    def find_one(self, where: dict | None = None) -> dict | None:
        return self.find(where).first()

    def count(self, where: dict | None = None) -> int:
        return self.find(where).count()

    def exists(self, where: dict | None = None) -> bool:
        return self.find(where).exists()

    def stats(self) -> dict:
        """documents, dead_records (a change makes 1, a deletion 2), file_size_bytes, dead_ratio."""
        m = self._manifest()
        records, live = self.log(m).count(), self.snapshot(m).count()
        size = sum(os.path.getsize(os.path.join(d, f)) for c in m["commits"] for d, _, fs in os.walk(os.path.join(self.path, c)) for f in fs if f.endswith(".parquet"))
        return {"documents": live, "dead_records": records - live, "file_size_bytes": size, "dead_ratio": (records - live) / records if records else 0.0}

    # writing

    def _commit(self, m: dict, rows: DataFrame, used: int, only: bool = False) -> None:
        schema = self._schema(m)
        new = unify(schema, T.StructType([f for f in rows.schema.fields if f.name not in ("_seq", "_op")]))
        wider = [f.name for f in schema.fields if new[f.name].dataType != f.dataType]
        if wider and m["commits"] and not only:  # a column got wider: the log is written again
            old = self.log(m)
            rows = self._shaped(old, new).unionByName(self._shaped(rows, new))
            only = True
        name = f"commit-{m['version']:08d}-{uuid.uuid4().hex[:8]}"
        self._shaped(rows, new).write.parquet(os.path.join(self.path, name))
        self._flushed(os.path.join(self.path, name))
        gone = [*m["commits"], *([m["checkpoint"]["name"]] if m.get("checkpoint") else [])] if only else []
        after = m | {"commits": [name] if only else [*m["commits"], name], "next": m["next"] + used, "schema": T.StructType([T.StructField(f.name, settled(f.dataType)) for f in new.fields]).json()}
        if only:
            after["checkpoint"] = None
        self._replace(after, m["version"])
        self._drop(gone)

    @staticmethod
    def _shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
        def column(f):
            return F.col(f"`{f.name}`").cast(settled(f.dataType)).alias(f.name) if f.name in df.columns else F.lit(None).cast(settled(f.dataType)).alias(f.name)
        return df.select(F.col("_seq").cast("long").alias("_seq"), F.col("_op").cast("byte").alias("_op"), *[column(f) for f in schema.fields])

    def _rows(self, docs: list[tuple[int, int, dict]]) -> DataFrame:
        t: T.DataType = T.StructType([T.StructField("_id", T.StringType())])
        for _, _, d in docs:
            t = unify(t, type_of(d))
        t = settled(t)
        schema = T.StructType([T.StructField("_seq", T.LongType()), T.StructField("_op", T.IntegerType()), *t.fields])
        rows = self.spark.createDataFrame([(s, o, *fitted(d, t)) for s, o, d in docs], schema)
        return self.embedder.apply(rows) if self.embedder else rows

    @staticmethod
    def _with_id(doc: dict) -> dict:
        if not isinstance(doc, dict):
            raise InvalidDocumentError("a document is a dict")
        if "_id" in doc and not isinstance(doc["_id"], str):
            raise InvalidIdError("_id must be a string")
        return doc if "_id" in doc else {"_id": uuid.uuid4().hex[:24], **doc}

    def insert(self, doc: dict) -> dict:
        return self.insert_many([doc])[0]

    def insert_many(self, docs: list[dict]) -> list[dict]:
        """All or none: an _id that exists, or comes twice, raises before anything is written."""
        docs = [self._with_id(d) for d in docs]
        ids = [d["_id"] for d in docs]
        if len(set(ids)) < len(ids):
            raise DuplicateIdError("an _id comes twice")
        with self._writing() as m:
            if docs:
                rows = self._rows([(m["next"] + i, LIVE, d) for i, d in enumerate(docs)])
                hit = self.snapshot(m).join(F.broadcast(rows.select("_id")), "_id", "left_semi").select("_id").first()  # as many ids as the caller holds
                if hit:
                    raise DuplicateIdError(hit["_id"])
                self._commit(m, rows, len(docs))
        return docs

    def insert_frame(self, df: DataFrame) -> int:
        """Inserts a frame's rows, _id among its columns, distributed; all or none. The frame is evaluated once; what it gave then is checked, written and counted."""
        with self._writing() as m:
            staged = os.path.join(self.path, f"staged-{uuid.uuid4().hex[:8]}")
            try:
                df.write.parquet(staged)
                rows = self.spark.read.schema(df.schema).parquet(staged)
                twice = rows.groupBy("_id").count().where("count > 1 or _id is null")
                if not twice.isEmpty() or not rows.select("_id").join(self.snapshot(m).select("_id"), "_id", "left_semi").isEmpty():
                    raise DuplicateIdError("an _id exists, comes twice or is null")
                made = self.embedder.apply(rows) if self.embedder else rows
                self._commit(m, made.withColumn("_seq", F.lit(m["next"]) + F.monotonically_increasing_id()).withColumn("_op", F.lit(LIVE)), 1 << 48)
                return rows.count()
            finally:
                shutil.rmtree(staged, ignore_errors=True)

    def _hit(self, m: dict, where: dict) -> DataFrame:
        df = self.snapshot(m)
        return df.where(compile_filter(where, df.schema))

    @staticmethod
    def _first(hit: DataFrame) -> DataFrame:
        return hit.orderBy("_seq", "_id").limit(1)

    def _change(self, where: dict, one: bool, make) -> int:
        validate(where)
        with self._writing() as m:
            hit = self._hit(m, where)
            if one:
                hit = self._first(hit)
            n = hit.count()
            if n:
                self._commit(m, make(hit).withColumn("_seq", F.lit(m["next"])), 1)
            return n

    def update_many(self, where: dict, set: dict | None = None, unset: list | None = None, inc: dict | None = None) -> int:  # noqa: A002
        return self._change(where, False, self._changes(set, unset, inc))

    def update_one(self, where: dict, set: dict | None = None, unset: list | None = None, inc: dict | None = None) -> dict:  # noqa: A002
        """The first match changed, and returned; none raises NoMatchError. It is picked and changed under one lock."""
        validate(where)
        with self._writing() as m:
            first = self._first(self._hit(m, where)).select("_id").first()
            if first is None:
                raise NoMatchError("nothing matches")
            own = {"_id": first["_id"]}
            self._commit(m, self._changes(set, unset, inc)(self._hit(m, own)).withColumn("_seq", F.lit(m["next"])), 1)
            return self._hit(self._state(), own).drop("_seq").first().asDict(recursive=True)

    def _changes(self, set_: dict | None, unset: list | None, inc: dict | None):
        def make(hit: DataFrame) -> DataFrame:
            out = changed(hit, set_, unset, inc).withColumn("_op", F.lit(CHANGED))
            return self.embedder.apply(out) if self.embedder and any(k in self.embedder.configs for k in (set_ or {})) else out
        return make

    def replace_one(self, where: dict, doc: dict) -> dict:
        """The first match replaced, its _id kept."""
        if "_id" in doc and not isinstance(doc["_id"], str):
            raise InvalidIdError("_id must be a string")
        validate(where)
        with self._writing() as m:
            hit = self._first(self._hit(m, where)).select("_id").first()
            if hit is None:
                raise NoMatchError("nothing matches")
            new = {**doc, "_id": hit["_id"]}
            self._commit(m, self._rows([(m["next"], CHANGED, new)]), 1)
            return new

    def delete_one(self, where: dict) -> bool:
        return bool(self._change(where, True, self._gone))

    def delete_many(self, where: dict) -> int:
        return self._change(where, False, self._gone)

    @staticmethod
    def _gone(hit: DataFrame) -> DataFrame:
        return hit.select("_id").withColumn("_op", F.lit(GONE))

    @contextmanager
    def batch(self):
        """Every verb, those on frames included, writes to the batch and sees what it wrote before; find() sees the last commit.

        The end commits all of it at once; an exception drops it all. Other writers wait.
        """
        if self._pending is not None:
            raise RuntimeError("a batch is open already")
        with self._writing() as m:
            before = {*m["commits"], *([m["checkpoint"]["name"]] if m.get("checkpoint") else [])}
            self._pending = m
            try:
                yield self
                done, self._pending = self._pending, None
                if done is not m:
                    self._replace(done, m["version"])
                left, self._doomed = self._doomed, []
                self._drop(left)
            except BaseException:
                made, left, self._pending, self._doomed = self._pending or {}, self._doomed, None, []
                made = [*made.get("commits", []), *([made["checkpoint"]["name"]] if made.get("checkpoint") else []), *left]
                self._drop([c for c in made if c not in before])
                raise

    # maintenance

    def compact(self) -> None:
        """One commit with the live documents, which is its own checkpoint; the old directories go once the manifest has changed."""
        with self._writing() as m:
            if m["commits"]:
                self._commit(m, self.snapshot(m).withColumn("_op", F.lit(LIVE)), 0, only=True)
                m = self._state()
                self._replace(m | {"checkpoint": {"name": m["commits"][0], "commits": 1}}, m["version"])

    def checkpoint(self) -> None:
        """Writes the live documents, so that later reads take only later commits from the log."""
        with self._writing() as m:
            old = m.get("checkpoint")
            if not m["commits"] or old and old["commits"] == len(m["commits"]):
                return
            name = f"checkpoint-{m['version']:08d}-{uuid.uuid4().hex[:8]}"
            self._shaped(self.snapshot(m).withColumn("_op", F.lit(LIVE)), self._schema(m)).write.parquet(os.path.join(self.path, name))
            self._flushed(os.path.join(self.path, name))
            self._replace(m | {"checkpoint": {"name": name, "commits": len(m["commits"])}}, m["version"])
            self._drop([old["name"]] if old and old["name"] not in m["commits"] else [])

    def reembed(self, source: str) -> int:
        """Computes the vectors of a source field again, in one commit."""
        if self.embedder is None or source not in self.embedder.configs:
            raise ValueError(f"no embedding is configured for {source}")
        c = self.embedder.configs[source]
        if c.dims is not None:
            self.meta["vector_indexes"][c.target] = c.dims
        return self._change({source: {"$exists": True}}, False, lambda hit: self.embedder.apply(hit).withColumn("_op", F.lit(CHANGED)))

    def _text_indexes(self, m: dict) -> dict[str, TextIndex]:
        """Those text indexes that are of this version of the documents."""
        return {f: TextIndex(self.spark, os.path.join(self.path, x["name"])) for f, x in m.get("texts", {}).items() if x["commits"] == m["commits"] and x.get("layout") == LAYOUT}

    def reindex(self) -> None:
        """Builds the declared text indexes again, and a checkpoint. Until the next write searches read them; after it, they scan, with the same results, until they are built again."""
        self.checkpoint()
        with self._writing() as m:
            df, made = self.snapshot(m), {}
            for field in self.meta["text_indexes"]:
                if field in df.columns:
                    name = f"text-{m['version']:08d}-{uuid.uuid4().hex[:8]}"
                    TextIndex.build(df, field, "_id", os.path.join(self.path, name))
                    made[field] = {"name": name, "commits": m["commits"], "layout": LAYOUT}
            if made:
                self._replace(m | {"texts": made}, m["version"])
                self._drop([x["name"] for x in m.get("texts", {}).values()])
        self.spark.catalog.clearCache()

    def sync(self) -> None:
        """Commits are durable once made; a checkpoint is written."""
        if not self.readonly:
            self.checkpoint()

    def close(self) -> None:
        """No more writes. Writes a checkpoint if many commits came after the last."""
        m = self._manifest()
        if not self.readonly and len(m["commits"]) - (m.get("checkpoint") or {"commits": 0})["commits"] >= CHECKPOINT_AFTER:
            self.checkpoint()
        self.readonly = True

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_) -> None:
        self.close()


@dataclass(frozen=True)
class _Documents(Query):
    """Results without _seq; ranked searches go by the declared fields: others find nothing, and a query of another width than declared raises ValueError."""

    widths: dict | None = None
    texts: tuple[str, ...] = ()
    indexes: dict | None = None

    def to_dataframe(self) -> DataFrame:
        return super().to_dataframe().drop("_seq")

    def _none(self) -> Ranked:
        return Ranked(self.df.limit(0).drop("_seq").withColumn("score", F.lit(0.0)))

    def vector_search(self, field: str, vector: list[float], limit: int | None = 10, dim: int | None = None) -> Ranked:
        if field not in self.widths:
            return self._none()
        return Ranked(super().vector_search(field, vector, limit, self.widths[field] or dim).df.drop("_seq"))

    def text_search(self, field: str, query: str, limit: int | None = 10, analyzer: str = "english") -> Ranked:
        if field not in self.texts:
            return self._none()
        if field in self.indexes:
            return Ranked(self.indexes[field].search(self.df.drop("_seq"), query, limit, "_id", self.predicate() if self.where else None, analyzer))
        return Ranked(super().text_search(field, query, limit, analyzer).df.drop("_seq"))

    def hybrid_search(self, text_field: str, vector_field: str, text: str, vector: list[float] | None = None, limit: int | None = 10, analyzer: str = "english") -> Ranked:
        target = self.embedder.target_of(vector_field) if self.embedder else vector_field
        width = self.widths.get(target)
        if vector is not None and width and len(vector) != width:
            raise ValueError(f"the query has {len(vector)} components, the field {width}")
        q = replace(self, df=self.df.drop("_seq"), text_index=self.indexes.get(text_field))
        return Query.hybrid_search(q, text_field if text_field in self.texts else "", vector_field if target in self.widths else "", text, vector, limit, analyzer)


def from_dataframe(df: DataFrame, where: dict | None = None, id_col: str = "_id") -> Query:
    """The read side over any frame."""
    return find(df, where, id_col)
