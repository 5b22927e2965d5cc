import datetime as dt

import pytest

from quern.errors import DuplicateIdError, InvalidDocumentError, InvalidFilterError, InvalidIdError, NoMatchError, ReadOnlyError
from quern.functions.quantize import round_trip, storage_size
from quern.functions.stemmer import stem
from quern.functions.tokens import tokens, tokens_of
from quern.operators.embedding import Embedder, EmbedConfig, plan_batches
from quern.plans.query import count, find, find_ex, first, last, mean, sum
from quern.sources import bson, files
from quern.sources.store import Collection


class Letters:
    """A model for tests: how often each of four letters comes."""

    def embed(self, texts):
        return [[float(t.count(c)) for c in "abcd"] for t in texts]


def frame(spark):
    return spark.createDataFrame([("1", "x", 3, 1.0), ("2", "y", None, 2.0), ("3", "x", 5, None), ("4", None, 1, 4.0)], "_id string, g string, n bigint, v double")


def test_shape_is_fixed_whatever_the_order(spark):
    q = find(frame(spark)).limit(2).skip(1).sort("n")
    assert [d["_id"] for d in q.to_list()] == ["1", "3"]
    assert [d["_id"] for d in find(frame(spark)).sort("n", True).to_list()] == ["2", "3", "1", "4"]
    assert find(frame(spark)).limit(2).count() == 2
    assert find(frame(spark)).limit(0).first() is None
    base = find(frame(spark))
    assert base.sort("n") is not base and base.sort_by is None


def test_groups(spark):
    out = find(frame(spark)).group("g").agg(count(), sum("n"), mean("v"), first("n"), last("v")).sort("count", True).to_list()
    assert out[0] == {"g": "x", "count": 2, "sum_n": 8, "mean_v": 1.0, "first_n": 3, "last_v": 1.0}
    assert {d["g"]: d["sum_n"] for d in out} == {"x": 8, "y": 0, None: 1}
    assert {d["g"] for d in find(frame(spark)).group("g").to_list()} == {"x", "y", None}


def test_options(spark):
    assert find_ex(frame(spark), {}, {"sort": {"field": "v", "descending": False}, "limit": 1}).first()["_id"] == "1"
    with pytest.raises(ValueError):
        find_ex(frame(spark), {}, {"project": []})
    with pytest.raises(InvalidFilterError):
        find(frame(spark), {"$x": 1})


def test_vector_search(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [2.0, 0.0]), ("d", None), ("e", [1.0]), ("f", [-1.0, None])], "_id string, v array<double>")
    assert [(d["_id"], s) for d, s in find(df).vector_search("v", [3.0, 0.0], None).to_list()] == [("a", 1.0), ("c", 1.0), ("b", 0.0)]
    assert find(df).vector_search("v", [0.0, 0.0]).to_list() == [] and find(df).vector_search("w", [1.0]).to_list() == []
    with pytest.raises(ValueError):
        find(df).vector_search("v", [1.0], dim=2)


def test_tokens(spark):
    said = ["Hello World-Wide a v1.2.3 x_y", "ünïcode, naïve", "", None]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    got = [r[0] for r in df.select(tokens(df.t)).collect()]
    assert got == [tokens_of(t or "") for t in said]
    assert got[0] == ["hello", "world", "wide", "world-wide", "v1", "v1.2.3", "x_y"]


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("gas", "gas"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("happy", "happi"), ("by", "by"), ("say", "say"), ("relational", "relat"),
                                       ("conditional", "condit"), ("generalization", "general"), ("communism", "communism"), ("consistency", "consist"), ("knightly", "knight"), ("dying", "die"), ("news", "news"), ("skies", "sky"), ("nationality", "nation"), ("adjustment", "adjust"), ("knocking", "knock"), ("consolatory", "consolatori"), ("succeeding", "succeed"), ("controlled", "control")])
def test_stems(word, want):
    assert stem(word) == want


def test_text_search_with_stems(spark):
    df = spark.createDataFrame([("1", "cats and a running dog"), ("2", "the cat runs"), ("3", "birds"), ("4", None)], "_id string, t string")
    assert {d["_id"] for d, _ in find(df).text_search("t", "Cat").to_list()} == {"1", "2"}
    assert {d["_id"] for d, _ in find(df).text_search("t", "run", analyzer="none").to_list()} == set()
    assert find(df).text_search("t", "!").to_list() == [] and find(df).text_search("z", "cat").to_list() == []
    hits = find(df, {"_id": "2"}).text_search("t", "cats").to_list()
    assert [d["_id"] for d, _ in hits] == ["2"] and hits[0][1] == pytest.approx(dict((d["_id"], s) for d, s in find(df).text_search("t", "cats").to_list())["2"])


def test_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), indexes=["n"], durability="fsync")
    c.insert({"_id": "a", "n": 1, "t": "x", "at": dt.datetime(2024, 1, 1, 1, tzinfo=dt.timezone(dt.timedelta(hours=1)))})
    made = c.insert_many([{"n": 2, "tags": ["p", "q"]}, {"_id": "c", "n": 2.5, "o": {"k": 1}}])
    assert len(made[0]["_id"]) == 24 and c.count() == 3
    assert c.find_one({"_id": "a"})["at"] == dt.datetime(2024, 1, 1)
    with pytest.raises(DuplicateIdError):
        c.insert_many([{"_id": "d"}, {"_id": "a"}])
    assert not c.exists({"_id": "d"})
    with pytest.raises(InvalidIdError):
        c.insert({"_id": 3})
    with pytest.raises(InvalidDocumentError):
        c.insert({"n": "text"})
    assert c.update_one({"_id": "a"}, set={"t": "y"}, inc={"n": 2, "hits": 1})["n"] == 3.0
    assert c.update_many({"n": {"$gte": 2}}, unset=["t"]) == 3
    assert c.find_one({"_id": "a"})["t"] is None
    with pytest.raises(InvalidIdError):
        c.update_many({}, set={"_id": "z"})
    with pytest.raises(NoMatchError):
        c.replace_one({"_id": "none"}, {})
    assert c.replace_one({"_id": "c"}, {"n": 9})["_id"] == "c" and c.find_one({"_id": "c"})["o"] is None
    assert c.delete_one({"_id": "a"}) and not c.delete_one({"_id": "a"}) and c.delete_many({"n": 9}) == 1
    s = c.stats()
    assert s["documents"] == 1 and s["dead_records"] > 0
    c.compact()
    assert c.stats()["dead_records"] == 0 and c.count() == 1
    with pytest.raises(ReadOnlyError):
        Collection(spark, str(tmp_path / "c"), readonly=True).insert({})
    assert Collection(spark, str(tmp_path / "c"), indexes=["t"]).meta["indexes"] == ["n", "t"]


def test_batch(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    c.insert({"_id": "a", "n": 1})
    with pytest.raises(RuntimeError), c.batch():
        c.insert({"_id": "b", "n": 2})
        raise RuntimeError
    assert c.count() == 1
    with c.batch():
        c.insert({"_id": "b", "n": 2})
        c.update_one({"_id": "a"}, inc={"n": 5})
        with pytest.raises(DuplicateIdError):
            c.insert({"_id": "b"})
        assert c.count() == 1
        c.insert({"_id": "x", "n": 0})
        c.delete_one({"_id": "a"})
    assert {d["_id"]: d["n"] for d in c.find().to_list()} == {"b": 2, "x": 0}


def test_batches_hold_every_verb(spark, tmp_path):
    """Verbs see what the batch wrote; an exception takes back all of them, frames, updates and compaction included."""
    c = Collection(spark, str(tmp_path / "c"))
    c.insert_many([{"_id": str(i), "n": i} for i in range(4)])
    before = {d["_id"]: d["n"] for d in c.find().to_list()}
    with pytest.raises(KeyError), c.batch():
        assert c.update_many({"n": {"$gte": 2}}, inc={"n": 10}) == 2
        c.insert_frame(spark.createDataFrame([("f", 7)], "_id string, n bigint"))
        c.insert({"_id": "w", "n": 1.5})
        c.compact()
        assert c.delete_many({"n": {"$gt": 6}}) == 3
        raise KeyError
    assert {d["_id"]: d["n"] for d in c.find().to_list()} == before and len(list((tmp_path / "c").glob("commit-*"))) == 1
    with c.batch():
        c.insert({"_id": "new", "n": 3})
        assert c.update_one({"_id": "new"}, set={"t": "x"})["t"] == "x" and c.replace_one({"t": "x"}, {"n": 30})["_id"] == "new"
        assert c.update_many({"n": {"$gte": 3}}, inc={"n": 1}) == 2 and c.delete_one({"_id": "0"})
        with pytest.raises(NoMatchError):
            c.update_one({"_id": "0"}, set={"n": 1})
        with pytest.raises(RuntimeError), c.batch():
            pass
    assert {d["_id"]: d["n"] for d in c.find().to_list()} == {"1": 1, "2": 2, "3": 4, "new": 31}


def test_frames_are_evaluated_once(spark, tmp_path):
    from pyspark.sql import functions as F

    c = Collection(spark, str(tmp_path / "c"))
    n = c.insert_frame(spark.range(50).where(F.rand() < 0.5).select(F.col("id").cast("string").alias("_id")))
    assert n == c.count()
    with pytest.raises(DuplicateIdError):
        c.insert_frame(spark.createDataFrame([("z",), ("z",)], "_id string"))
    assert n == c.count() and not list((tmp_path / "c").glob("staged-*"))


def test_checkpoints(spark, tmp_path):
    """Reads are the same with and without a checkpoint, and have no shuffle right after it."""
    c = Collection(spark, str(tmp_path / "c"), durability="fsync")
    c.insert_many([{"_id": str(i), "n": i} for i in range(6)])
    c.delete_one({"n": 0})
    c.sync()
    assert "Exchange" not in c.snapshot()._jdf.queryExecution().executedPlan().toString() and c.count() == 5
    mark = c.mark()
    c.update_many({"n": 1}, set={"n": 100, "late": "yes"})
    c.delete_one({"n": 2})
    c.insert({"_id": "0", "n": -1})
    assert {d["_id"]: d["n"] for d in c.find().to_list()} == {"0": -1, "1": 100, "3": 3, "4": 4, "5": 5}
    assert {(r["_id"], r["_op"]) for r in c.since(mark).collect()} == {("1", 3), ("2", 2), ("0", 1)}
    c.compact()
    assert {d["_id"]: d["late"] for d in c.find().to_list()}["1"] == "yes" and c.stats()["dead_records"] == 0
    assert len(list((tmp_path / "c").glob("c*-*"))) == 1


def test_declared_fields(spark, tmp_path):
    """Ranked searches go by the declared fields and widths, and return documents alone."""
    c = Collection(spark, str(tmp_path / "c"), vector_indexes={"v": 2}, text_indexes=["t"])
    c.insert_many([{"_id": "a", "v": [1.0, 0.0], "u": [1.0, 0.0], "t": "red house", "s": "red"}, {"_id": "b", "v": [1.0, 0.0, 0.0], "t": "blue houses"}])
    hits = c.find().vector_search("v", [1.0, 0.0]).to_list()
    assert [(d["_id"], s) for d, s in hits] == [("a", 1.0)] and "_seq" not in hits[0][0] and "_seq" not in c.find().first()
    assert c.find().vector_search("u", [1.0, 0.0]).to_list() == [] == c.find().text_search("s", "red").to_list()
    with pytest.raises(ValueError):
        c.find().vector_search("v", [1.0, 0.0, 0.0])
    with pytest.raises(ValueError):
        c.find().hybrid_search("t", "v", "red", [1.0])
    assert [d["_id"] for d, _ in c.find().hybrid_search("t", "u", "red", [1.0, 0.0]).to_list()] == ["a"]
    scanned = [c.find().text_search("t", q).to_list() for q in ("house", "red", "none")]
    c.reindex()
    assert c.find().indexes and [c.find().text_search("t", q).to_list() for q in ("house", "red", "none")] == scanned and len(scanned[0]) == 2
    assert [d["_id"] for d, _ in c.find({"_id": "b"}).hybrid_search("t", "v", "house", [1.0, 0.0]).to_list()] == ["b"]
    c.insert({"_id": "c", "t": "a house of red stone"})
    assert not c.find().indexes and {d["_id"] for d, _ in c.find().text_search("t", "house").to_list()} == {"a", "b", "c"}


def test_text_index(spark, tmp_path):
    """Its scores are those of the scan, stems, repeated terms, filters and limits included."""
    from quern.operators.text_index import TextIndex

    rows = [(str(i), t) for i, t in enumerate(["cats and a running dog", "the cat runs, the cat sleeps", "birds", None, "", "v1.2 cat-like runs", "dogs dogs dogs"])]
    df = spark.createDataFrame(rows, "_id string, t string")
    index = TextIndex.build(df, "t", "_id", str(tmp_path / "i"))
    for q in ("cat", "run cats cat", "the", "v1.2", "nothing", "", "dog bird"):
        for analyzer in ("english", "none"):
            for where in (None, {"_id": {"$in": ["1", "5", "6"]}}):
                for limit in (1, 10, None, 0):
                    got = find(df, where, text_index=index).text_search("t", q, limit, analyzer).to_list()
                    want = find(df, where).text_search("t", q, limit, analyzer).to_list()
                    assert [d for d, _ in got] == [d for d, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])
    plan = index._table("postings").where("token = 'cat'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,cat)" in plan
    assert TextIndex.build(df.limit(0), "t", "_id", str(tmp_path / "j")).hits("cat").count() == 0


def test_tail_of_a_log(spark, tmp_path):
    """A stream of commits as they come: the live documents so far."""
    from pyspark.sql import types as T

    from quern.streaming.tail import latest, run_once, tail

    c = Collection(spark, str(tmp_path / "c"))
    c.insert_many([{"_id": "a", "n": 1}, {"_id": "b", "n": 2}])
    c.update_many({"n": 1}, set={"n": 5})
    c.delete_one({"_id": "b"})
    schema = T.StructType([T.StructField("_seq", T.LongType()), T.StructField("_op", T.ByteType()), *c._schema().fields])
    run_once(latest(tail(spark, c.path, schema)), "tail_of_c")
    assert [(r["_id"], r["n"]) for r in spark.table("tail_of_c").collect()] == [("a", 5)]


def test_ties_of_first_and_last(spark):
    df = spark.createDataFrame([("g", 1, "x"), ("g", 1, "y"), ("g", 0, None)], "g string, _id int, v string")
    assert find(df).group("g").agg(first("v"), last("v")).to_list() == [{"g": "g", "first_v": "x", "last_v": "y"}]


def test_sqlite_json(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("create table t (i integer, o text, l text, m text)")
        db.executemany("insert into t values (?, ?, ?, ?)", [(1, '{"a": 1, "b": [1, 2.5]}', "[1, 2]", "[1]"), (2, '{"a": 3}', None, "text"), (3, None, "[]", "{bad")])
    got = sorted(files.read_sqlite(spark, str(tmp_path / "x.db")).collect(), key=lambda r: r["i"])
    assert got[0]["o"]["b"] == [1.0, 2.5] and got[1]["o"]["a"] == 3 and [r["l"] for r in got] == [[1, 2], None, []] and [r["m"] for r in got] == ["[1]", "text", "{bad"]


def test_embedding(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), auto_embed={"t": {"model": Letters(), "target": "v", "dims": 4, "doc_prefix": "a"}})
    c.insert_many([{"_id": "1", "t": "bbbb"}, {"_id": "2", "t": "aaa"}, {"_id": "3", "n": 1}])
    assert [d["_id"] for d, _ in c.find().semantic("t", "b").to_list()][0] == "1"
    assert [d["_id"] for d, _ in c.find().hybrid_search("t", "t", "aaa", limit=2).to_list()][0] == "2"
    assert c.reembed("t") == 2
    with pytest.raises(ValueError):
        EmbedConfig.of({"model": Letters(), "target": "v", "colour": 1})
    with pytest.raises(ValueError):
        Embedder({"t": {"model": "hf:x", "target": "v"}})
    with pytest.raises(ValueError):
        find(frame(spark)).semantic("t", "x")


def test_plan_batches():
    texts = ["a" * 30, "b" * 3, "c" * 300, "d"]
    plan = plan_batches(texts, batch_size=2, max_batch_tokens=60)
    assert sorted(i for b in plan for i in b) == [0, 1, 2, 3] and plan[0] == [2] and all(len(b) <= 2 for b in plan)
    assert round_trip([1.0, -0.5], "int8") == [1.0, -64 / 127] and storage_size(10, "binary") == 2


def test_bson_and_files(spark, tmp_path):
    doc = {"_id": "1", "n": 1, "big": 1 << 40, "f": 1.5, "b": True, "x": None, "l": [1, "a", [2]], "d": {"k": "v"}, "t": dt.datetime(2024, 1, 2, 3, 4, 5, 6000), "raw": b"\0\1"}
    assert bson.decode(bson.encode(doc)) == doc
    data = bson.frame(1, doc) + bson.frame(2, {"_id": "1"})
    assert [op for _, op, _ in bson.frames(data + b"\5")] == [1, 2]
    p = tmp_path / "a.json"
    p.write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_json(spark, str(p)).count() == 2
    p.write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert files.read_json(spark, str(p)).count() == 3
    with pytest.raises(NotImplementedError):
        files.read_mongo()


def test_cli(spark, tmp_path, capsys):
    from quern.cli import main

    src, db, out = tmp_path / "in.json", str(tmp_path / "db"), tmp_path / "out.json"
    src.write_text('{"_id": "a", "n": 1}\n{"n": 2}\n')
    main(["import-json", db, str(src)], spark)
    main(["export-json", db, str(out)], spark)
    import json

    assert sorted(d["n"] for d in json.loads(out.read_text())) == [1, 2]
    main(["export-sqlite", db, str(tmp_path / "o.db")], spark)
    assert files.read_sqlite(spark, str(tmp_path / "o.db")).count() == 2
