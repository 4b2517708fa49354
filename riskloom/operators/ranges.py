"""Exact order statistics and running sums without a task that sees all values.

Distinct values are range-partitioned (boundaries are sampled, so parts are even however
values bunch), the parts' totals are a table of one row a part, and running sums within a
part start from the totals of the parts before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import Scratch


def parts(per: DataFrame, order: list[str]) -> DataFrame:
    """``per`` in ranges of the ``order`` columns, with the number of each row's range as ``_part``; a table in shared storage."""
    ranged = per.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    return Scratch(per.sparkSession, "ranges").table(ranged, "parts")


def running(df: DataFrame, value: str, sums: dict[str, Column], by: tuple[str, ...] = (), ascending: bool = False) -> DataFrame:
    """One row per distinct value (and ``by``): each sum, and its running total from the highest (or lowest) value on as ``cum_``."""
    # written before it is dealt out: ranges are found by a sample, which would compute the counts a second time
    counts = Scratch(df.sparkSession, "running").table(df.groupBy(*by, value).agg(*[v.alias(k) for k, v in sums.items()]), "counts")
    per = parts(counts, [*by, value])
    first = (lambda c: F.col(c)) if ascending else F.desc
    # as many rows as there are ranges, for each value of ``by`` in them
    whole = per.groupBy(*by, "_part").agg(*[F.sum(k).alias(k) for k in sums])
    before = Window.partitionBy(*by).orderBy(first("_part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*by, "_part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    within = Window.partitionBy(*by, "_part").orderBy(first(value)).rowsBetween(Window.unboundedPreceding, 0)
    return per.join(whole, [*by, "_part"]).select(*by, value, *sums, *[(F.col(f"_{k}") + F.sum(k).over(within)).alias(f"cum_{k}") for k in sums])


def between(low: float, high: float, share: float) -> float:
    return low if low == high else low * (1 - share) + high * share


def quantiles(df: DataFrame, column: str, levels: list[float], by: tuple[str, ...] = (), weight: str | None = None) -> dict[tuple, list[float]]:
    """Exact, linearly interpolated quantiles of each group, by the values of ``by``; null and NaN are left out.

    ``weight``: how many rows a row stands for. What reaches the driver is bounded by the
    levels times the groups. A group without values is missing.
    """
    x = F.col(column).cast("double")
    rows = df.select(*by, x.alias("_x"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_w")).where("_x is not null and not isnan(_x) and _w > 0")
    r = Scratch(df.sparkSession, "quantiles").table(running(rows, "_x", {"n": F.sum("_w")}, by, ascending=True), "running")
    total = r.groupBy(*by).agg(F.max("cum_n").alias("total")) if by else r.agg(F.max("cum_n").alias("total"))
    at = F.array(*[F.lit(float(q)) for q in levels])
    ranks = F.transform(at, lambda q: q * (F.col("total") - 1))
    wanted = F.array_distinct(F.concat(F.transform(ranks, lambda p: F.floor(p)), F.transform(ranks, lambda p: F.ceil(p))))
    joined = r.join(total, list(by)) if by else r.crossJoin(F.broadcast(total))  # one row
    hits = joined.withColumn("i", F.explode(F.filter(wanted, lambda i: (i < F.col("cum_n")) & (i >= F.col("cum_n") - F.col("n"))))).select(*by, "total", "i", "_x")
    found: dict[tuple, dict[int, float]] = {}
    totals: dict[tuple, int] = {}
    for h in hits.collect():
        key = tuple(h[c] for c in by)
        totals[key] = h["total"]
        found.setdefault(key, {})[h["i"]] = h["_x"]
    out = {}
    for key, n in totals.items():
        places = [q * (n - 1) for q in levels]
        out[key] = [between(found[key][math.floor(p)], found[key][math.ceil(p)], p - math.floor(p)) for p in places]
    return out


def quantiles_of(df: DataFrame, column: str, levels: list[float], weight: str | None = None) -> list[float]:
    """As quantiles(), of all rows; empty without values."""
    return quantiles(df, column, levels, weight=weight).get((), [])
