"""python -m quern.cli: import and export JSON and SQLite, and a shell with db and the aggregates bound."""

from __future__ import annotations

import argparse
import code

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.query import AGGREGATES
from .sources.files import read_json, read_mongo, read_sqlite, write_json, write_sqlite
from .sources.store import Collection


def with_ids(df: DataFrame) -> DataFrame:
    """Rows without an _id get one of their content and place; an _id of another type is read as text."""
    made = F.substring(F.sha2(F.concat_ws(":", F.to_json(F.struct("*")), F.monotonically_increasing_id()), 256), 1, 24)
    return df.withColumn("_id", F.coalesce(F.col("_id").cast("string"), made) if "_id" in df.columns else made)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("what", choices=["import-json", "export-json", "import-sqlite", "export-sqlite", "import-mongo", "export-mongo", "shell"])
    p.add_argument("collection")
    p.add_argument("file", nargs="?", default="-")
    p.add_argument("--table")
    a = p.parse_args(argv)
    if a.what.endswith("mongo"):
        read_mongo()
    spark = spark or SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    db = Collection(spark, a.collection, readonly=a.what.startswith("export"))
    if a.what == "import-json":
        print(db.insert_frame(with_ids(read_json(spark, a.file))), "documents")
    elif a.what == "import-sqlite":
        print(db.insert_frame(with_ids(read_sqlite(spark, a.file, a.table))), "documents")
    elif a.what == "export-json":
        write_json(db.to_dataframe(), a.file)
    elif a.what == "export-sqlite":
        write_sqlite(db.to_dataframe(), a.file, a.table or "documents")
    else:
        code.interact(banner="db is the collection", local={"db": db, "spark": spark, **AGGREGATES})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
