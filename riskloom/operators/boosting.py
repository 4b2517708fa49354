"""Boosting that goes on from a kept margin, stops when it gains no more, and takes up after a kill.

The margin (log odds) of every row is a column of a table. A block of trees is fitted by
Spark to the Newton step of the logistic loss at that margin, and its trees are added up;
the table with the new margin, the block and the average precision after each of its trees
on the latest fifth of the rows are kept before the next block begins. When no tree of the
last ``patience`` was the best, the number of the best one is known, and as many trees are
fitted on all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scratch import Scratch
from .metrics import average_precision
from .model import prepared
from .split import TARGET, TIME, cutoff

#: Trees at most, trees without gain after which it ends, trees of a block, and the part of a block's step that is taken.
ROUNDS, PATIENCE, BLOCK, SHRINK = 2000, 100, 20, 0.3
TREES = {"maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.7", "minInstancesPerNode": 20}
#: Steps are bounded where a probability is near 0 or 1.
STEEPEST, LEAST_CURVE = 4.0, 1e-4


@dataclass
class Boosted:
    """Blocks of trees after one preparation of the inputs."""

    prepare: PipelineModel
    blocks: list[GBTRegressionModel]
    features: list[str]
    base: float
    shrink: float
    validation_ap: float

    @property
    def rounds(self) -> int:
        return sum(b.getNumTrees for b in self.blocks)

    def probability(self, df: DataFrame) -> DataFrame:
        """The rows with ``score``."""
        out = self.prepare.transform(prepared(df, self.features)).withColumn("_margin", F.lit(self.base))
        for block in self.blocks:
            out = block.setPredictionCol("_step").transform(out).withColumn("_margin", F.col("_margin") + self.shrink * F.col("_step")).drop("_step")
        return out.withColumn("score", F.round(1 / (1 + F.exp(-F.col("_margin"))), 6)).select(*df.columns, "score")


def steps(model: GBTRegressionModel, df: DataFrame) -> DataFrame:
    """Adds ``steps``: the block's step after 1, 2, ... of its trees."""
    out, kept = df, df.columns
    for i, tree in enumerate(model.trees):
        out = tree.setPredictionCol(f"_t{i}").transform(out)
    outputs = F.array(*[F.col(f"_t{i}") * w for i, w in enumerate(model.treeWeights)])
    none = F.array().cast("array<double>")
    sums = F.aggregate(outputs, none, lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))
    return out.select(*kept, sums.alias("steps"))


class Run:
    """Blocks fitted one after another, kept under ``path``; what is there from an earlier run is taken up."""

    def __init__(self, spark: SparkSession, path: str, shrink: float, block: int, trees: dict, seed: int):
        self.spark, self.path, self.shrink, self.block, self.trees, self.seed = spark, path, shrink, block, trees, seed
        self.blocks: list[GBTRegressionModel] = []
        self.aps: list[float] = []

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def start(self, rows: DataFrame) -> DataFrame:
        """The rows (features, label, w, late, margin) after the last block that was kept."""
        if not self._exists("rows0"):
            rows.write.mode("overwrite").parquet(f"{self.path}/rows0")
        # a block counts once its precisions are there, which are written last
        while self._exists(f"aps{len(self.blocks)}"):
            b = len(self.blocks)
            self.aps += [r["ap"] for r in self.spark.read.parquet(f"{self.path}/aps{b}").orderBy("k").collect()]
            self.blocks.append(GBTRegressionModel.load(f"{self.path}/block{b}"))
        return self.spark.read.parquet(f"{self.path}/rows{len(self.blocks)}")

    def go_on(self, rows: DataFrame, rounds: int) -> DataFrame:
        """One more block; its rows."""
        b = len(self.blocks)
        p = 1 / (1 + F.exp(-F.col("margin")))
        curve = F.greatest(p * (1 - p), F.lit(LEAST_CURVE))
        step = F.greatest(F.least((F.col("label") - p) / curve, F.lit(STEEPEST)), F.lit(-STEEPEST))
        gbt = GBTRegressor(featuresCol="features", labelCol="z", weightCol="h", maxIter=min(self.block, rounds - sum(x.getNumTrees for x in self.blocks)), seed=self.seed + b, **self.trees)
        model = gbt.fit(rows.where("not late").withColumns({"z": step, "h": F.col("w") * curve}))
        model.write().overwrite().save(f"{self.path}/block{b}")
        moved = steps(model, rows)
        moved.withColumn("margin", F.col("margin") + self.shrink * F.element_at("steps", -1)).drop("steps").write.mode("overwrite").parquet(f"{self.path}/rows{b + 1}")
        late = moved.where("late").select("label", F.posexplode(F.transform("steps", lambda x: F.col("margin") + self.shrink * x)).alias("k", "m"))
        aps = average_precision(late, "label", "m", by=("k",)).select("k", "ap")
        none = self.spark.range(model.getNumTrees).select(F.col("id").cast("int").alias("k"))
        none.join(aps, "k", "left").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/aps{b}")
        self.aps += [r["ap"] for r in self.spark.read.parquet(f"{self.path}/aps{b}").orderBy("k").collect()]
        self.blocks.append(model)
        return self.spark.read.parquet(f"{self.path}/rows{b + 1}")

    def best(self) -> int:
        """Number of the first tree with the greatest precision, from 1; 0 if none has one."""
        known = [(-a, i + 1) for i, a in enumerate(self.aps) if a is not None]
        return min(known)[1] if known else 0


def boost(df: DataFrame, features: list[str], target: str = TARGET, weight: str | None = None, path: str | None = None, rounds: int = ROUNDS, patience: int = PATIENCE, block: int = BLOCK, shrink: float = SHRINK, seed: int = 42, **trees) -> Boosted:
    """Trees as many as are best on the latest fifth of the time, then fitted on all rows.

    Missing values become medians beside a flag of missingness. ``path``: a folder on shared
    storage under which blocks are kept; a call with the same rows and parameters that finds
    some goes on from them. Without positives among the late rows, or late rows, all ``rounds``
    are fitted.
    """
    spark = df.sparkSession
    path = path or Scratch(spark, "boosting").path("run")
    stages = [Imputer(inputCols=[f"_{c}" for c in features], outputCols=[f"_{c}_full" for c in features], strategy="median"),
              VectorAssembler(inputCols=[f"_{c}_full" for c in features] + [f"_{c}_missing" for c in features], outputCol="features")]
    own: Column = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = prepared(df, features).withColumns({"late": F.col(TIME) >= cutoff(df, 0.8), "label": F.col(target).cast("double"), "w": own})
    prepare = Pipeline(stages=stages).fit(rows.where("not late"))
    share = rows.where("not late").agg(F.try_divide(F.sum(F.col("w") * F.col("label")), F.sum("w"))).first()[0] or 0.0
    base = math.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6)))
    ready = prepare.transform(rows).select("features", "label", "w", "late").withColumn("margin", F.lit(base))
    trees = TREES | trees
    search = Run(spark, f"{path}/search", shrink, block, trees, seed)
    at = search.start(ready)
    while len(search.aps) < rounds and len(search.aps) - search.best() < patience:
        at = search.go_on(at, rounds)
        if not search.best():
            break
    wanted = search.best() or rounds
    whole = Run(spark, f"{path}/whole", shrink, block, trees, seed)
    at = whole.start(ready.withColumn("late", F.lit(False)))
    while len(whole.aps) < wanted:
        at = whole.go_on(at, wanted)
    return Boosted(prepare, whole.blocks, list(features), base, shrink, max((a for a in search.aps if a is not None), default=math.nan))
