"""Core numbers on shared state, kept up to date by batches of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.components import connected_components
from ..operators.graph import k_core
from ..scratch import Scratch
from .buckets import Store


class IncrementalCore:
    """Core numbers of a graph that only gains edges, in bucketed tables.

    A batch raises core numbers only of nodes that such nodes of equal number join to an end
    of a new edge (or to a node that rose before). Those are found by frontier joins, which
    read the buckets they reach; the ones with too few neighbours at the next number fall out,
    round by round, and the rest rise by one. As one batch may raise a number several times
    this is repeated from what rose. Only buckets of nodes that rose, and of the ends of new
    edges, are written. Rounds are as many as the plateau is deep;
    where a step would read most buckets anyway, all plateaus are found as components instead.

    ``path`` names a folder on shared storage in which the state outlives the process.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.s = spark, Scratch(spark, "cores")
        self.store = Store(spark, path or self.s.path("state"), {"near": "src string, dst string", "core": "node string, core long"}, buckets)
        self.n = 0

    @property
    def state(self) -> DataFrame:
        """(node, core) of all nodes."""
        return self.store.read("core")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("near").where("src < dst")

    def _table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return self.s.table(df, f"t{self.n}")

    def insert(self, batch: DataFrame, number: int | None = None, before: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Takes edges (src, dst; loops, nulls and repeats are ignored) and returns (node, core) of the nodes that rose.

        ``number``: of the batch in its stream; one that was committed before changes nothing.
        ``before`` is given the result ahead of the commit, so that what it writes is there if the batch counts.
        """
        nothing = self.spark.createDataFrame([], "node string, core long")
        if number is not None and number <= self.store.number:
            return nothing
        self.store.forget()
        ends = batch.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).where("src <> dst")
        ends = self._table(ends.union(ends.select("dst", "src")).distinct())
        new = self._table(ends.join(self.store.read("near", self.store.buckets_of(ends)), ["src", "dst"], "left_anti"))
        rose = nothing
        if not new.isEmpty():
            self.store.append("near", new)
            rose = self._raise(new.select(F.col("src").alias("node")).distinct())
            own = self.store.buckets_of(rose)
            self.store.replace("core", self.store.read("core", own).join(rose, "node", "left_anti").union(rose), own)
        if before:
            before(rose)
        self.store.commit(number)
        return rose

    def _raise(self, seeds: DataFrame) -> DataFrame:
        """(node, core) of the nodes whose number is new, with all rises of this batch."""
        rose = self._table(self.spark.createDataFrame([], "node string, core long"))
        while True:
            around = self._plateaus(seeds, rose)
            up = self._fitting(around)
            if up.isEmpty():
                return rose
            # next may rise what rose, and what was level with it and stayed
            stayed = around.join(up.select(F.col("node").alias("src")), "src", "left_semi").where("mine = theirs").select(F.col("dst").alias("node"))
            rose = self._table(rose.join(up, "node", "left_anti").union(up.select("node", F.col("core") + 1)))
            seeds = self._table(stayed.union(up.select("node")).distinct())

    def _values(self, nodes: DataFrame, rose: DataFrame) -> DataFrame:
        """(node, core) of the known ones among nodes, rises of this batch included."""
        return self.store.read("core", self.store.buckets_of(nodes)).join(rose, "node", "left_anti").union(rose)

    def _told(self, pairs: DataFrame, rose: DataFrame) -> DataFrame:
        """(src, mine, dst, theirs): pairs with the numbers of both ends, of those ``src`` alone that might rise.

        A node might if more neighbours than its number are at or above it.
        """
        values = self._values(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")), rose)
        told = pairs.join(values.select(F.col("node").alias("src"), F.col("core").alias("mine")), "src", "left").join(values.select(F.col("node").alias("dst"), F.col("core").alias("theirs")), "dst", "left")
        told = self._table(told.select("src", F.coalesce("mine", F.lit(0)).alias("mine"), "dst", F.coalesce("theirs", F.lit(0)).alias("theirs")))
        might = told.groupBy("src").agg(F.count_if(F.col("theirs") >= F.col("mine")).alias("n"), F.max("mine").alias("m")).where("n > m").select("src")
        return self._table(told.join(might, "src", "left_semi"))

    def _plateaus(self, seeds: DataFrame, rose: DataFrame) -> DataFrame:
        """_told() of the nodes that might rise and that such nodes of equal number join to a seed."""
        seen, front, found = seeds, seeds, None
        while not front.isEmpty():
            own = self.store.buckets_of(front)
            if 2 * len(own) > self.store.buckets:
                return self._whole_plateaus(seeds, rose)
            told = self._told(self._table(front.withColumnRenamed("node", "src").join(self.store.read("near", own), "src")), rose)
            found = told if found is None else found.union(told)
            front = self._table(told.where("mine = theirs").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
            seen = seen.union(front)
        return self._table(found)

    def _whole_plateaus(self, seeds: DataFrame, rose: DataFrame) -> DataFrame:
        """As _plateaus(), when a step would read most buckets anyway: all plateaus as components, in a few rounds however deep."""
        told = self._told(self.store.read("near"), rose)
        nodes = told.select("src").distinct()
        level = told.where("mine = theirs").select("src", "dst").join(nodes.withColumnRenamed("src", "dst"), "dst", "left_semi")
        part = self._table(connected_components(level.union(nodes.select("src", F.col("src").alias("dst")))))
        reached = part.join(seeds, "node", "left_semi").select("component").distinct()
        return self._table(told.join(part.join(reached, "component", "left_semi").select(F.col("node").alias("src")), "src", "left_semi"))

    def _fitting(self, around: DataFrame) -> DataFrame:
        """(node, core): the most nodes that all have, after rising by one, as many neighbours at their number or above."""
        alive = self._table(around.groupBy(F.col("src").alias("node")).agg(F.max("mine").alias("core")))
        many = alive.count()
        while many:
            with_ = around.join(alive.select(F.col("node").alias("src")), "src", "left_semi").join(alive.select(F.col("node").alias("dst"), F.lit(True).alias("in")), "dst", "left")
            stands = (F.col("theirs") > F.col("mine")) | ((F.col("theirs") == F.col("mine")) & F.coalesce("in", F.lit(False)))
            alive = self._table(with_.groupBy(F.col("src").alias("node")).agg(F.max("mine").alias("core"), F.count_if(stands).alias("n")).where("n > core").select("node", "core"))
            left = alive.count()
            if left == many:
                break
            many = left
        return alive

    def matches_batch(self) -> bool:
        """Whether the state equals a computation from all edges."""
        edges = self.edges
        if edges.isEmpty():
            return self.state.isEmpty()
        whole = k_core(edges)
        own = self.state.select("node", "core")
        return own.exceptAll(whole).isEmpty() and whole.exceptAll(own).isEmpty()


def maintained_cores(edges: DataFrame, state: str, out: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Core numbers kept by a stream of edges (src, dst): each batch's new numbers go to ``out``, the state of all nodes is in ``state``.

    A batch writes its folder before it is committed and does nothing if it was, so whatever is
    tried again, each change of a number is in ``out`` once. Ends when what is there has been read.
    """

    def each(batch: DataFrame, number: int) -> None:
        IncrementalCore(batch.sparkSession, state, buckets).insert(batch, number, lambda rose: rose.write.mode("overwrite").parquet(f"{out}/batch={number}"))

    return edges.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
