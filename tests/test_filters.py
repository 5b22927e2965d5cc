"""Filters against a plain evaluator of the same semantics, over random documents and filters."""

import random

import pytest

from quern.errors import InvalidFilterError
from quern.plans.filters import Field, all_of, any_of, class_of, compile_filter, is_operators, none_of, validate

SCHEMA = "_id string, n bigint, d double, s string, b boolean, xs array<bigint>, ds array<struct<a:bigint,t:string>>, o struct<a:bigint,t:string>"


def equal(v, x):
    if v is None or x is None:
        return v is None and x is None
    if class_of(v) != class_of(x):
        return False
    if isinstance(v, list):
        return len(v) == len(x) and all(equal(p, q) for p, q in zip(v, x))
    if isinstance(v, dict):
        return set(x) <= set(v) and all(equal(v[k], x.get(k)) for k in v)
    return v == x


def op(v, o, x):
    if o == "$eq":
        return equal(v, x)
    if o == "$ne":
        return not equal(v, x)
    if o == "$in":
        return any(equal(v, y) for y in x)
    if o == "$nin":
        return not any(equal(v, y) for y in x)
    if o == "$exists":
        return (v is not None) == bool(x)
    if o == "$elemMatch":
        if not isinstance(v, list):
            return False
        if not x:
            return bool(v)
        if is_operators(x) and not set(x) & {"$and", "$or", "$not"}:
            return any(all(op(e, k, y) for k, y in x.items()) for e in v)
        return any(isinstance(e, dict) and matches(e, x) for e in v)
    if v is None or class_of(v) != class_of(x) or class_of(v) in ("list", "document", "other"):
        return False
    return {"$gt": v > x, "$gte": v >= x, "$lt": v < x, "$lte": v <= x}[o]


def matches(d, f):
    out = True
    for k, x in f.items():
        if k == "$and":
            hit = all(matches(d, s) for s in x)
        elif k == "$or":
            hit = any(matches(d, s) for s in x)
        elif k == "$not":
            hit = not matches(d, x)
        elif is_operators(x):
            hit = all(op(d.get(k), o, y) for o, y in x.items())
        else:
            hit = equal(d.get(k), x)
        out = out and hit
    return out


def some(r, field):
    return {"n": lambda: r.choice([0, 1, 2, 5, 2.0, 1.5, "1", None, True]), "d": lambda: r.choice([0.5, 1, 2.0, -3.25, "x", None]), "s": lambda: r.choice(["a", "b", "", "ü", 3, None]), "b": lambda: r.choice([True, False, 1, None]),
            "xs": lambda: r.choice([[], [1], [1, 2], [2.0], ["a"], None]), "o": lambda: r.choice([{"a": 1, "t": "x"}, {"a": 1}, {"z": 1}, None]), "ds": lambda: r.choice([[], [{"a": 1, "t": "x"}], None])}[field]()


def a_filter(r, depth=2):
    if depth and r.random() < 0.35:
        k = r.choice(["$and", "$or", "$not"])
        return {k: a_filter(r, depth - 1)} if k == "$not" else {k: [a_filter(r, depth - 1) for _ in range(r.randint(0, 3))]}
    field = r.choice(["n", "d", "s", "b", "xs", "o", "ds", "gone"])
    if field == "gone":
        return {field: r.choice([None, 1, {"$exists": r.random() < 0.5}, {"$ne": 1}, {"$in": [None, 1]}, {"$gt": 0}])}
    k = r.choice(["", "$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$elemMatch"])
    if k == "":
        return {field: some(r, field)}
    if k in ("$in", "$nin"):
        return {field: {k: [some(r, field) for _ in range(r.randint(0, 3))]}}
    if k == "$exists":
        return {field: {k: r.random() < 0.5}}
    if k == "$elemMatch":
        return {field: {k: r.choice([{"$gt": 1}, {"$gte": 1, "$lt": 2}, {"$in": [None, 2]}, {"a": 1}, {"a": {"$gt": 0}, "t": "x"}, {"$or": [{"t": "y"}, {"a": None}]}, {}, {"$exists": True}])}}
    return {field: {k: some(r, field), **({"$ne": some(r, field)} if r.random() < 0.2 else {})}}


def docs(r, n=60):
    pick = r.choice
    return [{"_id": str(i), "n": pick([None, 0, 1, 2, 5, 9]), "d": pick([None, 0.5, 1.0, 2.0, -3.25]), "s": pick([None, "", "a", "b", "ü"]), "b": pick([None, True, False]), "xs": pick([None, [], [1], [1, 2], [2, None]]),
             "ds": pick([None, [], [{"a": 1, "t": "x"}], [{"a": None, "t": "y"}, {"a": 2, "t": None}], [None]]), "o": pick([None, {"a": 1, "t": "x"}, {"a": 1, "t": None}])} for i in range(n)]


def test_random_filters(spark):
    r = random.Random(11)
    data = docs(r)
    df = spark.createDataFrame([tuple(d.values()) for d in data], SCHEMA).cache()
    filters = [a_filter(r) for _ in range(150)]
    cols = [compile_filter(f, df.schema).alias(f"c{i}") for i, f in enumerate(filters)]
    got = {row["_id"]: row for row in df.select("_id", *cols).collect()}
    for d in data:
        for i, f in enumerate(filters):
            v = got[d["_id"]][f"c{i}"]
            assert v is not None, f
            assert v == matches(d, f), (f, d)


@pytest.mark.parametrize("bad", [{"$nor": []}, {"a": {"$regex": "x"}}, {"a": {"$gt": 1, "b": 2}}, {"$and": {}}, {"$or": [1]}, {"$not": []}, {"a": {"$in": 3}}, {"a": {"$elemMatch": 3}}, {"a": {"$elemMatch": {"$foo": 1}}}, [], {3: 1}])
def test_wrong_filters_raise(bad):
    with pytest.raises(InvalidFilterError):
        validate(bad)


def test_leaves_are_pushed_down(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = df.where(compile_filter({"l_quantity": {"$gt": 45}, "$not": {"l_returnflag": "R"}}, df.schema)).select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45" in plan and "l_returnflag" in plan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "l_comment" not in plan.split("ReadSchema")[1]


def test_builders():
    assert all_of(Field("a") >= 1, none_of(Field("b").isin([2]))) == {"$and": [{"a": {"$gte": 1}}, {"$not": {"b": {"$in": [2]}}}]}
    assert any_of(Field("a") == 1, Field("c").exists()) == {"$or": [{"a": {"$eq": 1}}, {"c": {"$exists": True}}]}
