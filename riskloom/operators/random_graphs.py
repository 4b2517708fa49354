"""Random graphs of an exact number of edges, for benches of graph operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROUNDS = 4


def mixed(x: Column, bits: int, seed: int) -> Column:
    """A bijection of the numbers of ``bits`` bits, an even count: Feistel rounds over their halves."""
    half = bits // 2
    mask = F.lit((1 << half) - 1).cast("long")
    left, right = F.shiftright(x, half), x.bitwiseAND(mask)
    for r in range(ROUNDS):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(seed), F.lit(r)).bitwiseAND(mask))
    return F.shiftleft(left, half).bitwiseOR(right)


def random_edges(spark: SparkSession, nodes: int, edges: int, seed: int = 0) -> DataFrame:
    """(src, dst): exactly ``edges`` distinct pairs src < dst of the nodes 0 to ``nodes`` - 1, the same in every run.

    Pairs are numbered 0 to nodes (nodes - 1) / 2 - 1, and the first numbers are sent through a
    bijection: to the next even power of two, and again from there as long as the result is no
    number of a pair (at most four times as many as there are). So nothing repeats, and
    nothing is sorted, compared or cut off.
    """
    pairs = nodes * (nodes - 1) // 2
    if not 0 <= edges <= pairs:
        raise ValueError(f"{nodes} nodes have {pairs} pairs")
    bits = max(2, 2 * math.ceil(math.log2(max(2, pairs)) / 2))
    todo = spark.range(edges).select(F.col("id").alias("x"))
    # one walk for each row: rounds of the bijection until it lands below
    walk = F.reduce(F.sequence(F.lit(1), F.lit(64)), mixed(F.col("x"), bits, seed), lambda at, _: F.when(at < pairs, at).otherwise(mixed(at, bits, seed)))
    at = todo.select(walk.alias("p")).where(F.assert_true(F.col("p") < pairs, "a walk of 64 steps found no pair").isNull())
    # pair p is (i, j) with j (j - 1) / 2 + i = p; the root is put right where doubles round it
    j = F.floor((F.sqrt(8.0 * F.col("p") + 1) + 1) / 2).cast("long")
    at = at.withColumn("j", j)
    low = lambda j: F.expr(f"({j} * ({j} - 1)) div 2")
    at = at.withColumn("j", F.when(low("j") > F.col("p"), F.col("j") - 1).when(low("(j + 1)") <= F.col("p"), F.col("j") + 1).otherwise(F.col("j")))
    return at.select((F.col("p") - low("j")).alias("src"), F.col("j").alias("dst"))
