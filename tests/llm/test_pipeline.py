import corpus_pipeline
from helpers import clashing, empty_docs, odd_docs

from quern.llm import packing


def test_run_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == seen[0].columns, name
        docs = spark.createDataFrame(docs.collect(), seen[0].schema)
        seen.append(docs)
    n = [d.count() for d in seen]
    assert n[0] >= n[1] >= n[2] >= n[3] > 0
    before, after = (sum(len(r["text"].split()) for r in d.collect()) for d in (seen[3], seen[4]))
    assert 1.3 < after / before < 1.7
    rows = corpus_pipeline.run(spark, sf).collect()
    enc = packing.encoder(None)
    assert sum(r["length"] for r in rows) == sum(len(enc.ids(r["text"])) // 4 + 1 for r in seen[4].collect())
    assert len({(r["row_id"], r["start"]) for r in rows}) == len(rows) and len({r["row_id"] for r in rows}) == n[4]


def test_run_over_a_table_with_more_columns_and_nulls(spark, tmp_path):
    """What run() returns is the same whatever else documents hold; junk and unlearned scripts are gone, near copies share no lines."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    near = docs.where("length(text) > 3000").limit(1).select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat("text", F.lit(" end")).alias("text"), "lang", "source", "n_chars")
    junk = spark.createDataFrame([(-1, "xq zvk jjw qpx kkz vvx wqz " * 30, None, "s", 1), (-2, None, None, None, None), (-3, "Съешь же ещё этих мягких булок " * 9, None, "s", 1)], docs.schema)
    every = clashing(docs.unionByName(near).unionByName(junk))
    every.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    size = {r["doc_id"]: r["doc_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    first = near.first()["doc_id"]
    assert not set(size) & {-1, -2, -3} and len(size) > 100
    assert size.get(first, 0) > 3 * size.get(first - 1_000_000, 0) or size.get(first - 1_000_000, 0) > 3 * size.get(first, 0)  # shared lines stay in one of the two


def test_stages_over_odd_and_empty_tables(spark):
    for df in (odd_docs(spark), clashing(odd_docs(spark)), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, "")
            assert name == "packing" or out.columns == df.columns
            out.count()
