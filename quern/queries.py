"""The registered queries of the engine's operators, each with its SQL where SQL can say it."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.quantize import dequantize, hamming_cosine, quantize
from .operators.aggregates import collect, count, first, last, max, mean, min, sum  # noqa: A004
from .operators.embedding import EmbedConfig, embed_column
from .operators.text_index import TextIndex
from .operators.vector import cosine
from .plans.query import Query, find, find_ex
from .sources import bson, files
from .sources.shared import shared_folder
from .sources.store import CHANGED, GONE, LIVE, Collection, changed, replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: a fixed query vector of 64 components, the same in SQL
VECTOR = [((i * 37) % 101 - 50) / 50 for i in range(64)]
VECTOR_SQL = "[" + ", ".join(repr(x) for x in VECTOR) + "]::DOUBLE[]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


def simple(name: str, on: str, id_col: str, where: dict | None, sql: str, columns: list[str], then: Callable[[Query], Query] = lambda q: q) -> None:
    """A filter over a table, some columns of what it finds."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return then(find(table(spark, sf_dir, on), where, id_col)).to_dataframe().select(*columns)
    QUERIES[name], SQL[name] = run, sql


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with absences: kind is null for errors, big for values up to 20."""
    e = table(spark, sf_dir, "events")
    return e.select("*", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"), F.when(F.col("value") > 20, F.col("value")).alias("big"))


EVENTS = "(SELECT *, nullif(event_type, 'error') AS kind, CASE WHEN value > 20 THEN value END AS big FROM events)"


def absent(name: str, where: dict, sql_where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return find(events(spark, sf_dir), where, "event_id").to_dataframe().select("event_id")
    QUERIES[name], SQL[name] = run, f"SELECT event_id FROM {EVENTS} WHERE {sql_where}"


# predicates
query("find_all_count", "SELECT count(*) AS n FROM nation")(lambda s, d: find(table(s, d, "nation"), {}, "n_nationkey").to_dataframe().agg(F.count(F.lit(1)).alias("n")))
for _n, _w, _s in [("eq_implicit", {"o_orderstatus": "F"}, "o_orderstatus = 'F'"), ("eq_explicit", {"o_orderstatus": {"$eq": "O"}}, "o_orderstatus = 'O'"), ("cross_type_false", {"o_orderkey": {"$gt": "5"}}, "false"),
                   ("cross_type_ne", {"o_orderkey": {"$ne": "5"}}, "true")]:
    simple(_n, "orders", "o_orderkey", _w, f"SELECT o_orderkey FROM orders WHERE {_s}", ["o_orderkey"])
simple("ne", "events", "event_id", {"event_type": {"$ne": "click"}}, "SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'click'", ["event_id"])
for _n, _w, _s in [("gt", {"l_quantity": {"$gt": 45}}, "l_quantity > 45"), ("gte", {"l_quantity": {"$gte": 45}}, "l_quantity >= 45"), ("lt", {"l_discount": {"$lt": 0.02}}, "l_discount < 0.02"), ("lte", {"l_discount": {"$lte": 0.02}}, "l_discount <= 0.02"),
                   ("range_combined", {"l_quantity": {"$gte": 10, "$lt": 20}, "l_returnflag": "R"}, "l_quantity >= 10 AND l_quantity < 20 AND l_returnflag = 'R'")]:
    simple(_n, "lineitem", "l_orderkey", _w, f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_s}", ["l_orderkey", "l_linenumber"])
simple("range_datetime", "events", "event_id", {"ts": {"$gte": dt.datetime(2024, 1, 3), "$lt": dt.datetime(2024, 1, 9, tzinfo=dt.timezone.utc)}}, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09'", ["event_id"])
simple("numeric_int_vs_double", "part", "p_partkey", {"p_size": 5.0}, "SELECT p_partkey FROM part WHERE p_size = 5.0", ["p_partkey"])
absent("ne_absent", {"kind": {"$ne": "click"}}, "kind IS DISTINCT FROM 'click'")
absent("eq_null", {"kind": None}, "kind IS NULL")
absent("range_absent_never_matches", {"big": {"$gt": 5}}, "big > 5")
absent("in", {"event_type": {"$in": ["click", "view"]}}, "event_type IN ('click', 'view')")
absent("in_with_null", {"kind": {"$in": ["click", None]}}, "kind IN ('click') OR kind IS NULL")
absent("in_empty", {"kind": {"$in": []}}, "false")
absent("nin", {"event_type": {"$nin": ["click", "view"]}}, "event_type NOT IN ('click', 'view')")
absent("nin_absent", {"kind": {"$nin": ["click", "view"]}}, "kind IS NULL OR kind NOT IN ('click', 'view')")
absent("exists_true", {"kind": {"$exists": True}}, "kind IS NOT NULL")
absent("exists_false", {"big": {"$exists": False}}, "big IS NULL")
absent("not_", {"$not": {"kind": "click", "value": {"$gt": 10}}}, "NOT coalesce(kind = 'click' AND value > 10, false)")
absent("or_empty", {"$or": []}, "false")
absent("and_empty", {"$and": []}, "true")
absent("missing_field", {"nowhere": {"$exists": False}}, "true")
simple("and_", "customer", "c_custkey", {"$and": [{"c_acctbal": {"$gt": 0}}, {"c_mktsegment": "BUILDING"}]}, "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'", ["c_custkey"])
simple("or_", "supplier", "s_suppkey", {"$or": [{"s_acctbal": {"$lt": 0}}, {"s_nationkey": {"$in": [1, 2, 3]}}]}, "SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 OR s_nationkey IN (1, 2, 3)", ["s_suppkey"])
simple("nested_logic", "customer", "c_custkey", {"$or": [{"$and": [{"c_acctbal": {"$gte": 5000}}, {"$not": {"c_mktsegment": "BUILDING"}}]}, {"c_nationkey": 7}]}, "SELECT c_custkey FROM customer WHERE (c_acctbal >= 5000 AND NOT c_mktsegment = 'BUILDING') OR c_nationkey = 7", ["c_custkey"])
simple("elem_match_scalar", "embeddings", "vec_id", {"embedding": {"$elemMatch": {"$gt": 0.3, "$lt": 0.35}}}, "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x::DOUBLE > 0.3 AND x::DOUBLE < 0.35)) > 0", ["vec_id"])


@query("elem_match_doc", "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def elem_match_doc(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("items"))
    return find(items, {"items": {"$elemMatch": {"l_quantity": {"$gt": 45}, "l_returnflag": "R"}}}, "o_orderkey").to_dataframe().select("o_orderkey")


@query("subdoc_equality", "SELECT n_nationkey FROM nation WHERE n_name = (SELECT min(n_name) FROM nation) AND n_regionkey IS NOT NULL AND {'name': n_name, 'region': n_regionkey} = (SELECT {'name': n_name, 'region': n_regionkey} FROM nation ORDER BY n_name LIMIT 1)")
def subdoc_equality(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("doc"))
    low = n.orderBy("doc.name").first()["doc"]
    return find(n, {"doc": {"name": low["name"], "region": low["region"]}}, "n_nationkey").to_dataframe().select("n_nationkey")


# sort, skip, limit
for _n, _down, _nulls in [("sort_asc_nulls_last", False, "ASC NULLS LAST"), ("sort_desc_nulls_first", True, "DESC NULLS FIRST")]:
    query(_n, f"SELECT event_id, big FROM {EVENTS} ORDER BY big {_nulls}, event_id LIMIT 50")(lambda s, d, down=_down: find(events(s, d), {}, "event_id").sort("big", down).limit(50).to_dataframe().select("event_id", "big"))
for _n, _then, _s in [("skip", lambda q: q.sort("o_orderkey").skip(100), "ORDER BY o_orderkey OFFSET 100"), ("limit", lambda q: q.sort("o_orderkey").limit(25), "ORDER BY o_orderkey LIMIT 25"), ("skip_limit", lambda q: q.limit(50).skip(100).sort("o_totalprice", True), "ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100"),
                      ("topk", lambda q: q.sort("o_totalprice", True).limit(10), "ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"), ("first", lambda q: q.sort("o_orderdate").limit(1), "ORDER BY o_orderdate, o_orderkey LIMIT 1"), ("limit_zero", lambda q: q.limit(0), "LIMIT 0")]:
    simple(_n, "orders", "o_orderkey", {}, f"SELECT o_orderkey, o_totalprice FROM orders {_s}", ["o_orderkey", "o_totalprice"], _then)
simple("find_one", "orders", "o_orderkey", {"o_orderkey": 7}, "SELECT o_orderkey FROM orders WHERE o_orderkey = 7", ["o_orderkey"], lambda q: q.limit(1))
query("exists_q", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000) AS there")(lambda s, d: s.range(1).select(F.lit(find(table(s, d, "orders"), {"o_totalprice": {"$gt": 1000}}, "o_orderkey").exists()).alias("there")))

# groups
_LINE = lambda s, d: table(s, d, "lineitem").withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber")).withColumn("price", F.col("l_extendedprice").cast("decimal(18,4)"))
for _n, _a, _s in [("group_count", count(), "count(*) AS count"), ("group_sum", sum("l_quantity"), "sum(l_quantity) AS sum_l_quantity"), ("group_mean", mean("l_quantity"), "avg(l_quantity) AS mean_l_quantity"), ("group_min", min("l_shipdate"), "min(l_shipdate) AS min_l_shipdate"), ("group_max", max("l_extendedprice"), "max(l_extendedprice) AS max_l_extendedprice"),
                   ("group_first", first("l_shipdate"), "min({'k': l_orderkey * 8 + l_linenumber, 'v': l_shipdate}).v AS first_l_shipdate"), ("group_last", last("l_shipdate"), "max({'k': l_orderkey * 8 + l_linenumber, 'v': l_shipdate}).v AS last_l_shipdate")]:
    query(_n, f"SELECT l_returnflag, {_s} FROM lineitem GROUP BY l_returnflag")(lambda s, d, a=_a: find(_LINE(s, d), {}, "k").group("l_returnflag").agg(a).to_dataframe())
query("group_collect", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS collect_o_orderkey FROM orders GROUP BY o_custkey")(lambda s, d: find(table(s, d, "orders"), {}, "o_orderkey").group("o_custkey").agg(collect("o_orderkey")).to_dataframe().withColumn("collect_o_orderkey", F.array_join("collect_o_orderkey", ",")))
query("sum_of_no_values_is_zero", f"SELECT kind, coalesce(sum(CASE WHEN value < -1 THEN value END), 0.0) AS sum_none FROM {EVENTS} GROUP BY kind")(lambda s, d: find(events(s, d).withColumn("none", F.when(F.col("value") < -1, F.col("value"))), {}, "event_id").group("kind").agg(sum("none")).to_dataframe())
query("group_null_key", f"SELECT kind, count(*) AS count, max(big) AS max_big FROM {EVENTS} GROUP BY kind")(lambda s, d: find(events(s, d), {}, "event_id").group("kind").agg(count(), max("big")).to_dataframe())
query("distinct_values", "SELECT DISTINCT lang FROM documents")(lambda s, d: find(table(s, d, "documents"), {}, "doc_id").group("lang").to_dataframe())
query("group_sort_limit", "SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY l_suppkey ORDER BY count DESC, l_suppkey LIMIT 10")(lambda s, d: find(_LINE(s, d), {}, "k").limit(10).sort("count", True).group("l_suppkey").agg(count()).to_dataframe())
_FLAG = {"l_shipdate": {"$gte": dt.datetime(1995, 1, 1)}}
query("filter_group_sort", "SELECT l_returnflag, count(*) AS count, sum(l_quantity) AS sum_l_quantity, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS sum_price FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY l_returnflag")(
    lambda s, d: find(_LINE(s, d), _FLAG, "k").group("l_returnflag").agg(count(), sum("l_quantity"), sum("price")).sort("count", True).to_dataframe().withColumn("sum_price", F.col("sum_price").cast("double")))
query("options_form", "SELECT l_linestatus, count(*) AS count, max(l_quantity) AS max_l_quantity FROM lineitem WHERE l_quantity > 10 GROUP BY l_linestatus ORDER BY l_linestatus LIMIT 5")(
    lambda s, d: find_ex(_LINE(s, d), {"l_quantity": {"$gt": 10}}, {"group": "l_linestatus", "agg": [{"func": "count"}, {"func": "max", "field": "l_quantity"}], "sort": "l_linestatus", "limit": 5}, "k").to_dataframe())


# ranked searches
def ranked(df: DataFrame, id_col: str) -> DataFrame:
    """The ids, ranks and scores, to six places, of a ranked result; a window over what the limit left."""
    return df.select(id_col, F.row_number().over(W.orderBy(F.desc("score"), F.asc(id_col))).alias("rank"), F.round("score", 6).alias("score"))


def ranked_sql(inner: str, id_col: str, limit: int | None = 10) -> str:
    return f"SELECT {id_col}, row_number() OVER (ORDER BY score DESC, {id_col})::INTEGER AS rank, round(score, 6) AS score FROM ({inner} ORDER BY score DESC, {id_col}{f' LIMIT {limit}' if limit else ''})"


_COS = f"list_cosine_similarity(embedding::DOUBLE[], {VECTOR_SQL})"
query("vector_topk", ranked_sql(f"SELECT vec_id, {_COS} AS score FROM embeddings", "vec_id"))(lambda s, d: ranked(find(table(s, d, "embeddings"), {}, "vec_id").vector_search("embedding", VECTOR).df, "vec_id"))
query("vector_filtered", ranked_sql(f"SELECT vec_id, {_COS} AS score FROM embeddings WHERE label = 3", "vec_id"))(lambda s, d: ranked(find(table(s, d, "embeddings"), {"label": 3}, "vec_id").vector_search("embedding", VECTOR).df, "vec_id"))
query("vector_all", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings")(lambda s, d: find(table(s, d, "embeddings"), {}, "vec_id").vector_search("embedding", VECTOR, None).df.select("vec_id", F.round("score", 6).alias("score")))
query("vector_ties", ranked_sql("SELECT vec_id, CASE WHEN label < 5 THEN 1.0 ELSE 0.0 END AS score FROM embeddings", "vec_id", 30))(lambda s, d: ranked(find(table(s, d, "embeddings").select("vec_id", F.when(F.col("label") < 5, F.array(F.lit(2.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0))).alias("v")), {}, "vec_id").vector_search("v", [1.0, 0.0], 30).df, "vec_id"))
query("vector_zero_query", "SELECT vec_id, 1 AS rank, 0.0 AS score FROM embeddings WHERE false")(lambda s, d: ranked(find(table(s, d, "embeddings"), {}, "vec_id").vector_search("embedding", [0.0] * 64).df, "vec_id"))

_TOK = r"""(SELECT doc_id, lang, list_filter(flatten(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+(?:[._-][a-zA-Z0-9]+)*'),
  lambda t: CASE WHEN regexp_matches(t, '[._-]') THEN list_append(list_filter(regexp_split_to_array(lower(t), '[._-]'), lambda p: length(p) > 1), lower(t)) WHEN length(t) > 1 THEN [lower(t)] ELSE [] END)), lambda t: true) AS toks FROM documents)"""


def bm25_sql(terms: list[tuple[list[str], int]], columns: str = "doc_id, lang") -> str:
    """(doc_id, lang, score) of every document with a term; a term is its surface forms and how often it was asked for."""
    tf = ", ".join(f"len(list_filter(toks, lambda t: list_contains({forms!r}, t))) AS tf{i}" for i, (forms, _) in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN df{i} > 0 THEN {n} * ln((n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i, (_, n) in enumerate(terms))
    return f"SELECT {columns}, {score} AS score FROM (SELECT doc_id, lang, len(toks) AS dl, {tf} FROM {_TOK}) c, (SELECT count(*) FILTER (dl > 0)::DOUBLE AS n, (sum(dl) / count(*) FILTER (dl > 0))::DOUBLE AS avgdl, {stats} FROM (SELECT len(toks) AS dl, {tf} FROM {_TOK})) s WHERE " + "(" + " OR ".join(f"tf{i} > 0" for i in range(len(terms))) + ")"


_INDEXES: dict[tuple, TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of documents' texts, built at first use in a session and kept in the shared folder."""
    path = f"{sf_dir}/documents.parquet"
    key = (spark.sparkContext.applicationId, path, os.stat(path).st_mtime_ns if os.path.exists(path) else 0)
    if key not in _INDEXES:
        _INDEXES[key] = TextIndex.build(table(spark, sf_dir, "documents"), "text", "doc_id", os.path.join(shared_folder(spark, "index"), "text"))
    return _INDEXES[key]


def text(name: str, said: str, terms: list[tuple[list[str], int]], where: dict | None = None, sql_where: str = "true", analyzer: str = "none", limit: int | None = 10) -> None:
    query(name, ranked_sql(f"SELECT * FROM ({bm25_sql(terms)}) WHERE {sql_where}", "doc_id", limit))(lambda s, d: ranked(find(table(s, d, "documents"), where, "doc_id", text_index=text_index(s, d)).text_search("text", said, limit, analyzer).df, "doc_id"))


text("text_bm25_raw", "license", [(["license"], 1)])
text("text_multi_term", "licensed reserved idiot", [(["licensed"], 1), (["reserved"], 1), (["idiot"], 1)], limit=20)
text("text_repeat_term", "rights rights licensed", [(["rights"], 2), (["licensed"], 1)])
text("text_prefilter", "licensed rights", [(["licensed"], 1), (["rights"], 1)], {"lang": "de"}, "lang = 'de'")
text("text_negative_idf", "the and of", [(["the"], 1), (["and"], 1), (["of"], 1)])
# worthless has no other form in the text that stems to worthless; rights, right share a stem, as do license(s/d)
text("text_bm25_stemmed", "Licenses", [(["license", "licensed", "licenses", "licensing"], 1)], analyzer="english")


# the same search without an index: two scans
query("text_scan", ranked_sql(f"SELECT * FROM ({bm25_sql([(['licensed'], 1), (['rights'], 1)])})", "doc_id"))(lambda s, d: ranked(find(table(s, d, "documents"), None, "doc_id").text_search("text", "licensed rights", 10, "none").df, "doc_id"))


@query("text_array_field", r"""WITH c AS (SELECT conv_id, regexp_extract_all(lower(string_agg(text, ' ')), '[a-z0-9]+(?:[._-][a-z0-9]+)*') AS raw FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, len(list_filter(raw, lambda t: length(t) > 1)) AS dl, len(list_filter(raw, lambda t: t = 'with')) AS tf FROM c),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, count(*) FILTER (tf > 0) AS df FROM f)
SELECT conv_id, row_number() OVER (ORDER BY score DESC, conv_id)::INTEGER AS rank, round(score, 6) AS score FROM (SELECT conv_id, ln((n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM f, s WHERE tf > 0 ORDER BY score DESC, conv_id LIMIT 10)""")
def text_array_field(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("said"))
    return ranked(find(c, {}, "conv_id").text_search("said", "with", 10, "none").df, "conv_id")


def hybrid(name: str, said: str, terms: list, vector: list[float], where: dict | None, sql_where: str) -> None:
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        docs = table(spark, sf_dir, "documents").join(e, "doc_id", "left")
        return ranked(find(docs, where, "doc_id", text_index=text_index(spark, sf_dir)).hybrid_search("text", "embedding", said, vector, 10, "none").df, "doc_id")

    vec = f"SELECT doc_id, list_cosine_similarity(embedding::DOUBLE[], {VECTOR_SQL}) AS score FROM documents JOIN embeddings ON doc_id = vec_id WHERE {sql_where}" if any(vector) else "SELECT 0::BIGINT AS doc_id, 0.0 AS score WHERE false"
    txt = f"SELECT * FROM ({bm25_sql(terms)}) WHERE {sql_where}" if terms else "SELECT 0::BIGINT AS doc_id, 0.0 AS score WHERE false"
    leg = lambda q: f"SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS score FROM (SELECT doc_id, score FROM ({q}) ORDER BY score DESC, doc_id LIMIT 50)"
    query(name, ranked_sql(f"SELECT doc_id, sum(score) AS score FROM ({leg(txt)} UNION ALL {leg(vec)}) GROUP BY doc_id", "doc_id"))(run)


_LR = [(["licensed"], 1), (["rights"], 1)]
hybrid("hybrid_rrf", "licensed rights", _LR, VECTOR, None, "true")
hybrid("hybrid_prefilter", "licensed rights", _LR, VECTOR, {"lang": "en"}, "lang = 'en'")
hybrid("hybrid_text_only", "licensed rights", _LR, [0.0] * 64, None, "true")
hybrid("hybrid_vector_only", "", [], VECTOR, None, "true")

# quantisation
_E = "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings"
for _p, _s in [("int8", "list_transform(e, lambda x: round(x * (127.0::DOUBLE / (SELECT max(abs(y)) FROM (SELECT unnest(e) AS y))))::INTEGER)"), ("uint8", "list_transform(e, lambda x: round((x - list_min(e)) * (255.0::DOUBLE / (list_max(e) - list_min(e))))::INTEGER)")]:
    if _p == "int8":
        _s = "list_transform(e, lambda x: round(x * (127.0::DOUBLE / greatest(list_max(e), -list_min(e))))::INTEGER)"
    query(f"quantize_{_p}", f"SELECT vec_id, array_to_string({_s}, ',') AS code FROM ({_E})")(lambda s, d, p=_p: table(s, d, "embeddings").select("vec_id", F.array_join(quantize(F.col("embedding"), p), ",").alias("code")))
query("quantize_binary", f"SELECT vec_id, array_to_string(list_transform(range(8), lambda b: list_sum(list_transform(range(8), lambda i: CASE WHEN e[b * 8 + i + 1] >= 0 THEN 1 << i ELSE 0 END))::INTEGER), ',') AS code FROM ({_E})")(lambda s, d: table(s, d, "embeddings").select("vec_id", F.array_join(quantize(F.col("embedding"), "binary"), ",").alias("code")))
_SIGNS = "[" + ", ".join("1.0" if x >= 0 else "-1.0" for x in VECTOR) + "]::DOUBLE[]"
query("binary_hamming_cosine", f"SELECT vec_id, round(list_cosine_similarity(list_transform(e, lambda x: CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END), {_SIGNS}), 6) AS score FROM ({_E})")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(hamming_cosine(quantize(F.col("embedding"), "binary"), quantize(F.array(*[F.lit(x) for x in VECTOR]), "binary"), 64), 6).alias("score")))
query("dequantize_int8_cosine", f"SELECT vec_id, round(list_cosine_similarity(list_transform(e, lambda x: round(x * (127.0::DOUBLE / greatest(list_max(e), -list_min(e)))) / 127.0::DOUBLE), {VECTOR_SQL}), 6) AS score FROM ({_E})")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(cosine(dequantize(quantize(F.col("embedding"), "int8"), "int8"), VECTOR), 6).alias("score")))


# log and writes, on a log made of orders: all inserted, those of status F changed, those of status P deleted
def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("_id"), "o_orderkey", "o_orderstatus", "o_totalprice")
    at = lambda op, k: (F.lit(op).alias("_op"), (F.col("o_orderkey") * 3 + k).alias("_seq"))
    a = o.select("*", *at(LIVE, 0))
    b = o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2).select("*", *at(CHANGED, 1))
    c = o.where("o_orderstatus = 'P'").select("*", *at(GONE, 2))
    return a.unionByName(b).unionByName(c)


_LIVE = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P'"
query("log_replay_latest", _LIVE)(lambda s, d: replay(order_log(s, d)).select("o_orderkey", "o_orderstatus", "o_totalprice"))
query("log_stats", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS documents, (SELECT count(*) + count(*) FILTER (o_orderstatus = 'F') + count(*) FILTER (o_orderstatus = 'P') FROM orders) - (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS dead_records")(
    lambda s, d: replay(order_log(s, d)).agg(F.count(F.lit(1)).alias("documents")).crossJoin(order_log(s, d).agg(F.count(F.lit(1)).alias("n"))).select("documents", (F.col("n") - F.col("documents")).alias("dead_records")))
query("update_set_unset_inc", "SELECT o_orderkey, 'done' AS o_orderstatus, o_totalprice + 1.5 AS o_totalprice, 2 AS tries, NULL::VARCHAR AS o_orderpriority FROM orders WHERE o_orderstatus = 'P'")(
    lambda s, d: changed(find(table(s, d, "orders"), {"o_orderstatus": "P"}, "o_orderkey").to_dataframe(), {"o_orderstatus": "done"}, ["o_orderpriority"], {"o_totalprice": 1.5, "tries": 2}).select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("tries").cast("int").alias("tries"), "o_orderpriority"))


# collections: customers are put in, then verbs change them
def customers(spark: SparkSession, sf_dir: str) -> Collection:
    c = Collection(spark, os.path.join(shared_folder(spark, "collection"), "customers"), indexes=["c_nationkey"])
    c.insert_frame(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_id"), "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"))
    return c


_CUSTOMER = "c_custkey::VARCHAR AS _id, c_custkey, c_nationkey, c_acctbal, c_mktsegment"


@query("store_delete_many", f"SELECT {_CUSTOMER}, deleted FROM customer, (SELECT count(*) AS deleted FROM customer WHERE c_acctbal < 0) WHERE NOT c_acctbal < 0")
def store_delete_many(spark, sf_dir):
    c = customers(spark, sf_dir)
    n = c.delete_many({"c_acctbal": {"$lt": 0}})
    return c.to_dataframe().withColumn("deleted", F.lit(n).cast("long"))


@query("store_replace_one", "SELECT c_custkey::VARCHAR AS _id, c_nationkey, CASE WHEN c_custkey = 5 THEN 'none' ELSE c_mktsegment END AS c_mktsegment FROM (SELECT c_custkey, CASE WHEN c_custkey = 5 THEN NULL ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM customer)")
def store_replace_one(spark, sf_dir):
    c = customers(spark, sf_dir)
    c.replace_one({"c_custkey": 5}, {"c_mktsegment": "none"})
    return c.to_dataframe().select("_id", "c_nationkey", "c_mktsegment")


@query("store_update_one", f"SELECT {_CUSTOMER.replace('c_acctbal', 'CASE WHEN c_custkey = 7 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal')} FROM customer")
def store_update_one(spark, sf_dir):
    c = customers(spark, sf_dir)
    c.update_one({"c_custkey": 7}, inc={"c_acctbal": 1})
    c.checkpoint()
    return c.to_dataframe()


@query("store_stats", "SELECT count(*) FILTER (NOT c_acctbal < 0) AS documents, 2 * count(*) FILTER (c_acctbal < 0) + count(*) FILTER (c_nationkey = 3 AND NOT c_acctbal < 0) AS dead_records FROM customer")
def store_stats(spark, sf_dir):
    c = customers(spark, sf_dir)
    c.delete_many({"c_acctbal": {"$lt": 0}})
    c.update_many({"c_nationkey": 3}, set={"c_mktsegment": "x"})
    s = c.stats()
    return spark.createDataFrame([(s["documents"], s["dead_records"])], "documents long, dead_records long")


@query("store_compact", "SELECT c_custkey::VARCHAR AS _id, CASE WHEN c_nationkey = 3 THEN 'x' ELSE c_mktsegment END AS c_mktsegment, 0::BIGINT AS dead_records FROM customer WHERE NOT c_acctbal < 0")
def store_compact(spark, sf_dir):
    c = customers(spark, sf_dir)
    c.delete_many({"c_acctbal": {"$lt": 0}})
    c.update_many({"c_nationkey": 3}, set={"c_mktsegment": "x"})
    c.compact()
    return c.to_dataframe().select("_id", "c_mktsegment").withColumn("dead_records", F.lit(c.stats()["dead_records"]).cast("long"))


@query("store_batch", "SELECT c_custkey::VARCHAR AS _id, CASE WHEN c_nationkey = 3 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 4 UNION ALL SELECT 'new', 11.0")
def store_batch(spark, sf_dir):
    """A batch that raises leaves nothing; one that ends is seen at once, its later verbs having seen its earlier ones."""
    c = customers(spark, sf_dir)
    try:
        with c.batch():
            c.update_many({}, set={"c_acctbal": 0.0})
            raise KeyError
    except KeyError:
        pass
    with c.batch():
        c.insert({"_id": "new", "c_nationkey": 3, "c_acctbal": 1.0})
        c.update_many({"c_nationkey": 3}, inc={"c_acctbal": 10})
        c.delete_many({"c_nationkey": 4})
    return c.to_dataframe().select("_id", "c_acctbal")


@query("store_suffix_scan", "SELECT c_custkey::VARCHAR AS _id, 'late' AS c_mktsegment FROM customer WHERE c_nationkey = 3")
def store_suffix_scan(spark, sf_dir):
    """What was committed after a manifest that was read before: the tail of the log, by its commits."""
    c = customers(spark, sf_dir)
    seen = c.mark()
    c.update_many({"c_nationkey": 3}, set={"c_mktsegment": "late"})
    return c.since(seen).select("_id", "c_mktsegment")


class Letters:
    """A model for queries: how often each of eight letters comes."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(c)) for c in "AEIORSTN"] for t in texts]


_COUNTS = "[" + ", ".join(f"(length(n_name) - length(replace(n_name, '{c}', '')))::DOUBLE" for c in "AEIORSTN") + "]"
query("embed_typed", f"SELECT n_nationkey, array_to_string(list_transform(e, lambda x: round(x * (127.0::DOUBLE / greatest(list_max(e), -list_min(e))))::INTEGER), ',') AS codes FROM (SELECT n_nationkey, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS e FROM (SELECT n_nationkey, {_COUNTS} AS v FROM nation))")(
    lambda s, d: embed_column(table(s, d, "nation").select("n_nationkey", "n_name"), "n_name", EmbedConfig(Letters(), "v", precision="int8")).select("n_nationkey", F.array_join(F.transform("v", lambda x: F.round(x * 127).cast("int")), ",").alias("codes")))


# formats; the driver reads and writes these, so they run on small tables
@query("json_roundtrip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def json_roundtrip(spark, sf_dir):
    path = os.path.join(shared_folder(spark, "files"), "nation.json")
    files.write_json(table(spark, sf_dir, "nation"), path)
    return files.read_json(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@query("sqlite_roundtrip", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def sqlite_roundtrip(spark, sf_dir):
    path = os.path.join(shared_folder(spark, "files"), "region.db")
    files.write_sqlite(table(spark, sf_dir, "region"), path, "region", "r_regionkey")
    return files.read_sqlite(spark, path).select("r_regionkey", "r_name")


@query("bson_roundtrip", "SELECT n_nationkey::VARCHAR AS _id, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def bson_roundtrip(spark, sf_dir):
    path = os.path.join(shared_folder(spark, "files"), "nation.log")
    with open(path, "wb") as f:
        for r in table(spark, sf_dir, "nation").toLocalIterator():
            f.write(bson.frame(LIVE, {"_id": str(r["n_nationkey"]), "n_name": r["n_name"], "n_regionkey": r["n_regionkey"]}))
        f.write(b"\x99\x00\x00\x00\x01torn")
    spark.dataSource.register(bson.FramedLog)
    log = spark.read.format("framedlog").load(path)
    return replay(log).select("_id", F.get_json_object("doc", "$.n_name").alias("n_name"), F.get_json_object("doc", "$.n_regionkey").cast("long").alias("n_regionkey"))


@query("stream_tail_latest", "SELECT user_id, max(event_id) AS last_event FROM events GROUP BY user_id")
def stream_tail_latest(spark, sf_dir):
    from .streaming.tail import latest, run_once

    e = table(spark, sf_dir, "events")
    log = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("user_id").cast("string").alias("_id"), "user_id", F.col("event_id").alias("_seq"), F.lit(LIVE).alias("_op"))
    run_once(latest(log), "quern_tail")
    return spark.table("quern_tail").select("user_id", F.col("_seq").alias("last_event"))


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["filter_group_sort"](spark, "/root/testdata/sf0.001")
