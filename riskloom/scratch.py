"""Intermediate tables on storage that the driver and all executors share.

Iterative and multi-pass operators cut lineage here instead of caching: a table
written to shared storage survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and there is one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_riskloom_dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark._riskloom_dir = path
        atexit.register(__import__("shutil").rmtree, path[len("file://"):], True)
    # with its scheme, so that readers outside the JVM find the same store
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString()
    return full.replace("file:/", "file:///", 1).replace("file://///", "file:///", 1) if full.startswith("file:/") else full


#: Folders made in this process.
made: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Remove every table made so far; results not written by then are lost."""
    while made:
        remove(spark, made.pop())


class Scratch:
    """Parquet tables of one operator call. They stay, as lazy results read them, until ``clean`` is called."""

    def __init__(self, spark: SparkSession, name: str = "op"):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        made.append(self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write once, read back; the reader's plan starts at the files."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        remove(self.spark, self.path(name))
