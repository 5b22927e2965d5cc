"""Tables for tests, and nulls, empty and long texts, ties and clashing names to run every operator over."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_docs(spark):
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n ", None, None, 5), (None, "a text without an id, long enough to be a line", "en", None, 40), (4, "same words here again and again and again today", "de", "b", 48),
            (4, "same words here again and again and again today", "de", "b", 48), (5, "same words here again and again and again today", "de", "c", 48), (6, "12345 67890", "fr", "c", 11), (7, "long " * 30_000, "en", "a", 150_000), (8, "日本語のテキスト🙂　x\x1cy", "ja", "d", 12)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same rows with columns that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["id", "score", "size", "target", "copies", "label", "k1", "k2", "units", "secrets", "lang_pred", "predicted", "raw", "b", "source_size", "text_id", "n_rows", "gone", "bucket", "TARGET_x"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
