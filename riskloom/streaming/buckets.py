"""Tables kept by a stream on shared storage, in buckets, with numbered commits.

A bucket is what a hash of the first column deals to one folder. A step reads the
buckets of the keys it looks at and writes those it changes, so its cost follows the
step and not the history. What a step wrote counts once its commit, a small file that
names the folders of every bucket, has been renamed into place: a step that failed left
nothing, and one that is run again after its commit is known by its number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Folders that a bucket may have before they are written as one.
FOLDERS = 8


class Store:
    """Bucketed tables under one folder. ``schemas``: of each table, whose first column is its key."""

    def __init__(self, spark: SparkSession, base: str, schemas: dict[str, str], buckets: int = 64):
        self.spark, self.base, self.schemas = spark, base, schemas
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.number, self.buckets, self.at = -1, buckets, {name: {} for name in schemas}
        self.next: dict[str, dict[str, list[str]]] = {}
        self.lost: list[str] = []
        self._load()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _load(self) -> None:
        """Take up the last commit."""
        found = [int(f.getPath().getName()) for f in self.fs.listStatus(self._path("commits"))] if self.fs.exists(self._path("commits")) else []
        if found:
            self.number = max(found)
            kept = json.loads("".join(r.value for r in self.spark.read.text(f"{self.base}/commits/{self.number}").collect()))  # a line
            self.at, self.buckets = kept["at"], kept["buckets"]

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys in a frame's first column: as many numbers as there are buckets at most."""
        return [r[0] for r in keys.select(self.bucket(keys.columns[0]).alias("bucket")).distinct().collect()]

    def _folders(self, name: str, bucket: int) -> list[str]:
        return self.next.get(name, {}).get(str(bucket), self.at[name].get(str(bucket), []))

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets or of all, with what this step has written."""
        buckets = range(self.buckets) if buckets is None else buckets
        paths = [f"{self.base}/{name}/{v}/bucket={b}" for b in buckets for v in self._folders(name, b)]
        reader = self.spark.read.schema(self.schemas[name])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])

    def _write(self, name: str, df: DataFrame, buckets: list[int], version: str) -> None:
        key = df.columns[0]
        rows = df.withColumn("bucket", self.bucket(key)).repartition(max(1, min(len(buckets), self.buckets)), "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/{name}/{version}")

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows; a bucket of many folders is written anew."""
        own = self.buckets_of(df)
        version = uuid.uuid4().hex[:12]
        self._write(name, df, own, version)
        into = self.next.setdefault(name, {})
        for b in own:
            into[str(b)] = [*self._folders(name, b), version]
        full = [b for b in own if len(into[str(b)]) > FOLDERS]
        if full:
            self.replace(name, self.read(name, full), full)

    def replace(self, name: str, df: DataFrame, buckets: list[int]) -> None:
        """Put rows in place of all that these buckets hold."""
        version = uuid.uuid4().hex[:12]
        self._write(name, df, buckets, version)
        there = {r[0] for r in df.select(self.bucket(df.columns[0])).distinct().collect()}
        into = self.next.setdefault(name, {})
        for b in buckets:
            self.lost += [f"{name}/{v}/bucket={b}" for v in self._folders(name, b)]
            into[str(b)] = [version] if b in there else []

    def commit(self, number: int | None = None) -> int:
        """All writes of this step at once, under the next number or a greater one; folders that no bucket needs any more go."""
        at = {name: self.at[name] | self.next.get(name, {}) for name in self.schemas}
        number = self.number + 1 if number is None else number
        temporary, final = self._path(f"_commit-{number}"), self._path(f"commits/{number}")
        out = self.fs.create(temporary, True)
        out.write(bytearray(json.dumps({"at": at, "buckets": self.buckets}).encode()))
        out.close()
        self.fs.mkdirs(self._path("commits"))
        if not self.fs.rename(temporary, final):
            raise RuntimeError(f"step {number} of {self.base} was committed by another writer")
        gone, self.lost = self.lost, []
        self.number, self.at, self.next = number, at, {}
        for path in gone:
            self.fs.delete(self._path(path), True)
        return number

    def forget(self) -> None:
        """Drop what this step has written."""
        self.next, self.lost = {}, []
