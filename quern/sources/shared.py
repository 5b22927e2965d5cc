"""The folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a path, in the one named in spark.checkpoint.dir. Only where that is unset and Spark runs on one machine is it made elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quern-")
    base = base.removeprefix("file:")
    if "://" in base:
        raise ValueError("the shared folder isn't mounted as a path")
    path = os.path.join("/" + base.lstrip("/"), "quern", f"{uuid.uuid4().hex}-{name}")
    os.makedirs(path)
    return path
