"""Training and scoring with Spark's gradient-boosted trees, and variants compared on one test set."""

from __future__ import annotations

import math
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scratch import Scratch
from ..sources.tables import coverage_pct
from .metrics import average_precision, evaluate, inr
from .resample import ap_delta, delta, draw_aps, interval
from .split import TIME, TARGET, cutoff
from .values import compare_values

#: Training parameters; rounds bound the trees, of which the number best on the latest fifth of the rows is kept.
DEFAULTS = {"maxIter": 40, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.7", "minInstancesPerNode": 20, "seed": 42}

#: Rows that a task trains on at most.
PER_TASK = 500_000

#: Rows beyond which those that agree in all bins are added up before training, and about how many parts they are then dealt into.
COUNTED, PARTS = 1_000_000, 1_000_000
#: Bins of an input, as many as the learner itself makes, and the quantiles that they are made of.
BINS, LEVELS = 32, 1000


@dataclass
class Trained:
    """A fitted pipeline, its inputs, and how many of its trees count."""

    pipeline: PipelineModel
    features: list[str]
    rounds: int
    validation_ap: float

    def save(self, path: str) -> None:
        """Overwrites a folder with the pipeline and what goes with it."""
        spark = SparkSession.active()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark.createDataFrame([(self.features, self.rounds, self.validation_ap)], "features array<string>, rounds int, ap double").coalesce(1).write.mode("overwrite").parquet(f"{path}/inputs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trained:
        r = spark.read.parquet(f"{path}/inputs").first()
        return cls(PipelineModel.load(f"{path}/pipeline"), list(r["features"]), r["rounds"], r["ap"])


def train(df: DataFrame, features: list[str], target: str = TARGET, weight: str | None = None, **params) -> Trained:
    """Trees on the first four fifths of the time, their number chosen by average precision on the last fifth.

    Missing values become medians beside a flag of missingness. ``params``: those of
    GBTClassifier, over DEFAULTS. The learner sees no more of an input than its bin, so of
    more than COUNTED rows those that agree in all bins and the label are added up, and trees
    are fitted on the sums, in parts of about equal numbers of rows. Every row counts, and
    ``minInstancesPerNode`` and ``subsamplingRate`` are then of parts.
    """
    at = cutoff(df, 0.8)
    s = Scratch(df.sparkSession, "training")
    rows = s.table(prepared(df, features).withColumn("_late", F.col(TIME) >= at).withColumn("label", F.col(target).cast("double")).select(
        *[f"_{c}" for c in features], *[f"_{c}_missing" for c in features], "_late", "label", *([weight] if weight else [])), "rows")
    gbt = GBTClassifier(featuresCol="features", labelCol="label", **(DEFAULTS | params))
    full, flags = [f"_{c}_full" for c in features], [f"_{c}_missing" for c in features]
    imputer = Imputer(inputCols=[f"_{c}" for c in features], outputCols=full, strategy="median")
    early, late = rows.where("not _late"), rows.where("_late")
    many = early.count()
    if many > COUNTED:
        known = imputer.fit(early)
        bins = [f"_{c}_bin" for c in features]
        cut = Bucketizer(inputCols=full, outputCols=bins, splitsArray=[[-math.inf, *edges(x), math.inf] for x in known.transform(early).approxQuantile(full, [i / LEVELS for i in range(LEVELS + 1)], 0.5 / LEVELS)])
        inputs, gbt = [known, cut, VectorAssembler(inputCols=bins + flags, outputCol="features")], gbt.setWeightCol("_w")
        # rows are counted by bins on both sides: trees tell no more apart
        cells = s.table(cut.transform(known.transform(rows)).groupBy(*bins, *flags, "label", "_late").agg(
            F.count("*").alias("n"), F.sum(F.col(weight) if weight else F.lit(1.0)).alias("_w")), "cells")
        parts = F.ceil(F.col("n") / F.lit(-(-many // PARTS))).cast("int")
        early = s.table(cells.where("not _late").withColumn("_w", F.col("_w") / parts).withColumn("_part", F.explode(F.sequence(F.lit(1), parts))), "parts")
        many, late = early.count(), cells.where("_late")
        ready = inputs[2:]
    else:
        inputs = ready = [imputer, VectorAssembler(inputCols=full + flags, outputCol="features")]
        late = late.withColumn("n", F.lit(1))
        gbt = gbt.setWeightCol(weight) if weight else gbt
    if many > PER_TASK:
        # the learner keeps rows in memory at many times their size in a file, a part of the file to a task
        early = early.repartition(max(df.sparkSession.sparkContext.defaultParallelism, many // PER_TASK + 1))
    fitted = Pipeline(stages=[*ready, gbt]).fit(early)
    # of rows that were counted, the steps up to the bins come first
    pipeline = PipelineModel(inputs[:len(inputs) - len(ready)] + fitted.stages)
    if late.where("label = 1").isEmpty():
        return Trained(pipeline, list(features), pipeline.stages[-1].getNumTrees, math.nan)
    # trees cut the inputs into few cells, so rows are counted before each becomes as many as there are trees
    sums = s.table(by_rounds(fitted, late).groupBy("sums", "label").agg(F.sum("n").alias("n")), "rounds")
    best = average_precision(sums.select("label", "n", F.posexplode("sums").alias("k", "m")), "label", "m", "n", ("k",)).orderBy(F.desc("ap"), "k").first()
    return Trained(pipeline, list(features), best["k"] + 1, best["ap"])


def edges(values: list[float], bins: int = BINS) -> list[float]:
    """Where bins of an input part, at most bins - 1, from its quantiles at even levels: between any two values if they are few; else a bin closes with its even share of what is left, so that a frequent value takes one bin and not several."""
    values = [x for x in values if math.isfinite(x)]
    counts = sorted(Counter(values).items())
    at, held, left, places = [], 0, len(values), bins
    for (x, n), (y, _) in zip(counts, counts[1:]):
        held += n
        if len(counts) <= bins or held * places >= left and places > 1:
            # the upper value where nothing lies between
            at.append(x + (y - x) / 2 if x < x + (y - x) / 2 else y)
            held, left, places = 0, left - held, places - 1
    return at or [counts[0][0] if counts else 0.0]


def by_rounds(pipeline: PipelineModel, df: DataFrame, rounds: int | None = None) -> DataFrame:
    """Adds ``sums``: the margin after 1, 2, ... trees, all of them or the first ``rounds``."""
    model = pipeline.stages[-1]
    out = df
    for stage in pipeline.stages[:-1]:
        out = stage.transform(out)
    kept = out.columns
    for i, tree in enumerate(model.trees[:rounds]):
        out = tree.setPredictionCol(f"_t{i}").transform(out)
    outputs = F.array(*[F.col(f"_t{i}") * w for i, w in enumerate(model.treeWeights[:rounds])])
    # one fold, as sums written out would nest as deep as there are trees
    none = F.array().cast("array<double>")
    sums = F.aggregate(outputs, none, lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))
    return out.select(*kept, sums.alias("sums"))


def prepared(df: DataFrame, features: list[str]) -> DataFrame:
    """Inputs in columns of their own; one that the table lacks is missing in every row."""
    have = {c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double") for c in features}
    return df.withColumns({**{f"_{c}": v for c, v in have.items()}, **{f"_{c}_missing": v.isNull().cast("double") for c, v in have.items()}})


def probability(model: Trained, df: DataFrame) -> DataFrame:
    """The rows with ``score``, the probability of fraud by the trees that count."""
    if model.rounds == model.pipeline.stages[-1].getNumTrees:
        return model.pipeline.transform(prepared(df, model.features)).withColumn("score", F.round(vector_to_array("probability")[1], 6)).select(*df.columns, "score")
    sums = by_rounds(model.pipeline, prepared(df, model.features), model.rounds)
    # the classifier's probability: logistic in twice the margin
    return sums.select(*df.columns, F.round(1 / (1 + F.exp(-2 * F.col("sums")[model.rounds - 1])), 6).alias("score"))


def predict(model: Trained, df: DataFrame, key: str = "TransactionID") -> DataFrame:
    """key, score: the probability of fraud."""
    return probability(model, df).select(key, "score")


def importances(model: Trained, top: int = 8) -> list[tuple[str, float]]:
    """The inputs of greatest gain, as shares of the whole."""
    names = [*model.features, *[f"{c}_missing" for c in model.features]]
    return sorted(zip(names, model.pipeline.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))[:top]


def score_payments(model: Trained | None, payments: DataFrame, features: Column, total: int | None = None) -> DataFrame:
    """payments with score, features_present, features_total, coverage_pct, available.

    ``features``: a struct of the inputs that a payment tells; all other inputs are missing.
    Without a model nothing is scored and nothing is available.
    """
    if model is None:
        return payments.withColumns({"score": F.lit(None).cast("double"), "features_present": F.lit(0), "features_total": F.lit(0), "coverage_pct": F.lit(0.0), "available": F.lit(False)})
    kept = payments.columns
    own = payments.withColumn("_f", features)
    mapped = [c for c in own.schema["_f"].dataType.names if c in model.features]
    present = sum((F.col(f"_f.{c}").isNotNull().cast("int") for c in mapped), F.lit(0))
    total = len(model.features) if total is None else total
    rows = own.select(*kept, present.alias("features_present"), *[F.col(f"_f.{c}").alias(c) for c in mapped if c not in kept])
    return probability(model, rows).withColumn("features_total", F.lit(total)).withColumn("coverage_pct", coverage_pct(F.col("features_present"), F.lit(total))).withColumn(
        "available", F.lit(True)).select(*kept, "score", "features_present", "features_total", "coverage_pct", "available")


#: Models that are fitted at a time.
AT_A_TIME = 5


def variants(train_rows: DataFrame, test_rows: DataFrame, sets: dict[str, list[str]], cache: str | None = None, weights: dict[str, str] | None = None, **params) -> DataFrame:
    """(variant, TransactionID, score): one model for each feature set, all on the same test rows.

    Scores go to a folder for each variant below ``cache`` (by default of this call alone); a variant that is there is not fitted again.
    """
    spark = train_rows.sparkSession
    cache = cache or Scratch(spark, "variants").path("scores")
    jvm = spark._jvm

    def fit(name: str, features: list[str]) -> None:
        done = jvm.org.apache.hadoop.fs.Path(f"{cache}/variant={name}/_SUCCESS")
        if not done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
            model = train(train_rows, features, weight=(weights or {}).get(name), **params)
            predict(model, test_rows).write.mode("overwrite").parquet(f"{cache}/variant={name}")

    # fitting is many short jobs, each with few tasks at its end: those of several models fill the cores
    with ThreadPoolExecutor(AT_A_TIME) as pool:
        for fitted in [pool.submit(inheritable_thread_target(spark)(fit), *x) for x in sets.items()]:
            fitted.result()
    found = spark.read.option("basePath", cache).parquet(*[f"{cache}/variant={name}" for name in sets])
    return found.select(F.col("variant").cast("string").alias("variant"), "TransactionID", "score")


def compare(scores: DataFrame, test_rows: DataFrame, base: str, draws: int = 400, comparisons: int | None = None, target: str = TARGET, amount: str = "TransactionAmt") -> DataFrame:
    """One row a variant: AUC-PR, AUC-ROC, both operating points, and the change of AUC-PR from ``base`` with its interval and verdict."""
    rows = Scratch(scores.sparkSession, "compare").table(scores.join(test_rows.select("TransactionID", F.col(target).alias("y"), inr(F.col(amount)).alias("amount_inr")), "TransactionID"), "rows")
    names = sorted(r["variant"] for r in rows.select("variant").distinct().collect())
    comparisons = max(1, len(names) - 1) if comparisons is None else comparisons
    first = rows.where(F.col("variant") == base).select("TransactionID", "y", F.col("score").alias("s"))
    scored_by = lambda name: F.col("variant") == name
    wide = Scratch(scores.sparkSession, "compare").table(rows.groupBy("TransactionID", "y").agg(
        *[F.max(F.when(scored_by(name), F.col("score"))).alias(f"s{i}") for i, name in enumerate(names)], *[F.count_if(scored_by(name)).alias(f"n{i}") for i, name in enumerate(names)]), "wide")
    aps = None
    # where every variant scores every row once, the rows are weighed once for all variants
    if base in names and wide.where(" or ".join(f"n{i} <> 1" for i in range(len(names)))).isEmpty():
        aps = Scratch(scores.sparkSession, "compare").table(draw_aps(wide, "TransactionID", draws, [f"s{i}" for i in range(len(names))]), "aps")
    out = None
    for name in names:
        own = rows.where(F.col("variant") == name).withColumnRenamed("score", "s")
        report = evaluate(name, own)[0]
        if name == base:
            more = scores.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in ("delta", "low", "high")], F.lit(None).cast("string").alias("verdict"))
        else:
            pair = first.join(own.select("TransactionID", F.col("s").alias("v")), "TransactionID")
            more = ap_delta(pair, "TransactionID", draws, comparisons=comparisons) if aps is None else interval(delta(aps, names.index(name), names.index(base)), comparisons)
            more = more.select("delta", "low", "high", "verdict")
        one = report.crossJoin(more)  # one row by one row
        out = one if out is None else out.union(one)
    return out


def compare_by_value(scores: DataFrame, test_rows: DataFrame, base: str, draws: int = 400, target: str = TARGET, amount: str = "TransactionAmt", cap: float = 0.01) -> DataFrame:
    """As compare_values(), of variants(): every variant's score of a row beside the others, on rows that all have scored."""
    names = sorted(r["variant"] for r in scores.select("variant").distinct().collect())
    wide = scores.groupBy("TransactionID").agg(*[F.max(F.when(F.col("variant") == n, F.col("score"))).alias(f"v{i}") for i, n in enumerate(names)]).na.drop()
    rows = wide.join(test_rows.select("TransactionID", F.col(target).alias("y"), inr(F.col(amount)).alias("amount_inr")), "TransactionID")
    return compare_values(rows, "TransactionID", {n: f"v{i}" for i, n in enumerate(names)}, base, draws, cap)
