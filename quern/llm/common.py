"""What the operators share: the shared folder, written tables, fresh column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset and Spark runs locally, as in tests, one is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage is cut there, and a lost executor costs no recomputation."""
    return Scratch().written(df, name)


class Scratch:
    """Written tables that may go before the session ends: those that nothing reads any more."""

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(df.sparkSession)}/quern/{uuid.uuid4().hex}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *keep: DataFrame) -> None:
        """Deletes what was written here, but for these tables, as written() returned them. Frames that read the others must have been written."""
        kept = []
        for df, path in self.tables:
            if any(df is k for k in keep):
                kept.append((df, path))
                continue
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        self.tables = kept


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows over all cores, if it has fewer splits than there are cores, as a small table in one row group has; else the scan as it is, unshuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() * 2 <= cores else scan
