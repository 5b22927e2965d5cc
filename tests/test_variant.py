import json
import random

from pyspark.sql import functions as F

from quern.plans.variant import compile_variant, distinct_values, find_variant, sort_key
from test_filters import a_filter, matches

DOCS = [{"n": 1, "s": "a", "b": True}, {"n": 2.5, "s": 3}, {"n": "1", "xs": [1, 2, "x"], "o": {"a": 1, "t": "x"}}, {"n": None, "ds": [{"a": 1, "t": "x"}, 5, {"a": "1"}]}, {}, {"n": True, "s": None, "d": -3.25, "xs": []}, {"a'b": 1, "n": 2}]


def test_random_filters_over_mixed_documents(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "i int, j string").select("i", F.parse_json("j").alias("doc"))
    r = random.Random(2)
    filters = [a_filter(r) for _ in range(120)] + [{"a'b": 1}, {"n": {"$in": [1, "1"]}}, {"xs": {"$elemMatch": {"$eq": "x"}}}, {"ds": {"$elemMatch": {"a": "1"}}}, {"o": {"a": 1, "t": "x"}}, {"o": {"t": "x", "a": 1}}, {"xs": []}, {"xs": {"$in": [[1, 2, "x"]]}}]
    got = {x["i"]: x for x in df.select("i", *[compile_variant(f).alias(f"c{k}") for k, f in enumerate(filters)]).collect()}
    for i, d in enumerate(DOCS):
        for k, f in enumerate(filters):
            assert got[i][f"c{k}"] == matches(d, f), (d, f)
    assert find_variant(df, {"n": {"$gt": 1}}).count() == 2
    assert {(x["value"], x["count"]) for x in distinct_values(df, "n").collect()} == {("1", 1), ("2.5", 1), ('"1"', 1), (None, 2), ("true", 1), ("2", 1)}
    assert [x["i"] for x in df.orderBy(sort_key("doc", "n").asc_nulls_last(), "i").collect()] == [5, 0, 6, 1, 2, 3, 4]
