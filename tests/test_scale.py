"""What a step moves or gathers, on small tables."""

from collections import Counter

import pyarrow as pa

from quern.functions.tokens import tokens_of
from quern.operators import text_index
from quern.operators.text_index import TextIndex
from quern.plans.query import find


def test_index_moves_blocks(spark, tmp_path):
    """A row a token and block, not one a posting; every posting is in one."""
    df = spark.range(3000, numPartitions=4).selectExpr("id as _id", "concat('red house w', id % 7, ' the the') as t")
    index = TextIndex.build(df, "t", "_id", str(tmp_path / "i"))
    post = index._table("postings")
    assert post.count() <= 4 * 10
    assert post.selectExpr("token", "inline(arrays_zip(ids, tf, dl))").where("token = 'the' and tf = 2 and dl = 5").select("ids").distinct().count() == 3000
    assert index._table("stats").first().asDict() == {"n": 3000, "length": 15000}
    assert index.hits("w3", None, "_id", None, "none").count() == 429
    assert {p.name for p in (tmp_path / "i").iterdir()} == {"postings", "words", "stats"}


def test_blocks_hold_the_tokens_of_each_text(monkeypatch):
    """Those of tokens_of(), for words of any length, joined ones, blocks of any size, and texts without a token."""
    texts = ["a foo-bar. foo.bar_baz--x . -foo- FOO é foo1é2bar v1.2", None, "", "x" * 33 + " " + "x" * 32 + " " + "x" * 32 + "y " + "x" * 33, "end", "start. . end.", "ab.", ". b", "ſtop K straße İx", "a.b", "abcdefgh abcdefghi abcdefg"]
    batch = pa.RecordBatch.from_arrays([pa.array([f"i{k}" for k in range(len(texts))]), pa.array(texts, pa.string())], names=["id", "said"])
    want = {(w, f"i{i}"): (n, len(tokens_of(t or ""))) for i, t in enumerate(texts) for w, n in Counter(tokens_of(t or "")).items()}
    for size in (1, 20, 1 << 24):
        monkeypatch.setattr(text_index, "BYTES", size)
        rows = [r for b in text_index._blocks(iter([batch.slice(0, 1), batch.slice(1)])) for r in b.to_pylist()]
        got = [((r["token"], i), (tf, dl)) for r in rows if r["token"] is not None for i, tf, dl in zip(r["ids"], r["tf"], r["dl"], strict=True)]
        assert dict(got) == want and len(got) == len(want)
        assert sum(r["dl"][0] for r in rows if r["token"] is None) == sum(len(tokens_of(t or "")) for t in texts)


def test_skip_brings_no_table_into_one_task(spark):
    """skip after a sort drops the first rows and no others: nulls, NaN, ties of the id and of the sort field, frames without the id, more than there are."""
    nan = float("nan")
    rows = [(i % 9, v, m) for i, v in enumerate([None, 1.0, nan, 2.0, 2.0, None, -0.0, 0.0, 1.0, 2.0, nan, 2.0]) for m in "ab"] + [(3, 2.0, "a")] * 3 + [(None, 2.0, "c"), (None, None, "d")]
    df = spark.createDataFrame(rows, "_id int, v double, _n string").repartition(3)
    q = find(df).sort("v").skip(5).to_dataframe()
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "CollectLimit" not in plan and "GlobalLimit" not in plan
    for frame, columns in ((df, ["v", "_id"]), (df.drop("_id"), ["v"]), (df.select("_id", "_n"), ["_id"])):
        for down in (False, True):
            everything = [str(tuple(r[c] for c in columns)) for r in find(frame).sort(columns[0], down).to_dataframe().collect()]
            assert len(everything) == 29
            for n in (1, 7, 28, 29, 40):
                got = find(frame).sort(columns[0], down).skip(n).to_dataframe()
                assert got.columns == frame.columns
                assert [str(tuple(r[c] for c in columns)).replace("-0.0", "0.0") for r in got.collect()] == [x.replace("-0.0", "0.0") for x in everything[n:]], (columns, down, n)
    grouped = find(df).group("_n").agg().sort("_n").skip(2)
    assert [r["_n"] for r in grouped.to_dataframe().collect()] == ["c", "d"]
