"""Dense numbers for rows and names, without a task that sees all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import Scratch

#: Bits of a row's number within its partition.
WITHIN = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str | Column], name: str = "id", start: int = 0) -> DataFrame:
    """The rows with ``name``: start, start + 1, ... in the given order, ties in any.

    Rows are dealt by ranges and sorted there; a row's number is its place in its range
    and the count of the ranges before, which are a table of one row a range.
    """
    s = Scratch(df.sparkSession, "numbered")
    # written before it is dealt out: ranges are found by a sample, which would compute the rows a second time
    rows = s.table(df, "rows")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = s.table(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(WITHIN)).alias("_at")), "placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(counts), "_part").select(*df.columns, (F.col("_before") + F.col("_at") + start).alias(name))  # a row a range


def entity_index(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, id, n_nodes, n_edges): entities numbered by name, with the size of their graph on every row."""
    size = entities.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))  # one row
    return numbered(entities.select("uid"), ["uid"]).crossJoin(F.broadcast(size))
