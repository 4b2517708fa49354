"""Connected components by rounds in which every task contracts the edges it holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import Scratch

#: Edges that a task contracts at once.
HELD = 1 << 19


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component: minima over edges with pointer jumping."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, label[a], label[b])
        np.minimum.at(new, label[b], label[a])
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        new = new[label]
        if (new == label).all():
            return label
        label = new


def stars(edges: pd.DataFrame) -> pd.DataFrame:
    """(node, root, h): of each node the one of its component among these edges whose hash ``h`` is least. ``edges``: a, b, ha, hb."""
    n = len(edges)
    code, names = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True))
    h = np.empty(len(names), np.int64)
    h[code] = np.concatenate([edges["ha"].to_numpy(), edges["hb"].to_numpy()])
    order = np.argsort(h, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    root = order[least_labels(len(names), place[code[:n]], place[code[n:]])[place]]
    names = np.asarray(names)
    return pd.DataFrame({"node": names, "root": names[root], "h": h[root]})


def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, many = [], 0
    for pdf in batches:
        held.append(pdf)
        many += len(pdf)
        if many >= HELD:
            yield stars(pd.concat(held, ignore_index=True))
            held, many = [], 0
    if many:
        yield stars(pd.concat(held, ignore_index=True))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node reachable, itself included.

    Each round every task turns the edges it holds, at most HELD at a time, into stars
    around the node of each component that comes first in a hashed order. A node of
    several stars joins their middles, and these edges are the next round's. What fits one
    task is done in one round; beyond, stars leave only middles, and the hashed order makes
    even a sorted chain dealt edge by edge shrink by a constant factor, so rounds are
    logarithmic and their work falls off. A hub has at most as many stars as there are tasks.
    Null endpoints are dropped; self-loops only register their node.
    """
    s = Scratch(edges.sparkSession, "components")
    kind = edges.schema[src].dataType.simpleString()
    live = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    hops: list[DataFrame] = []
    while True:
        both = live.withColumns({"ha": F.xxhash64("a"), "hb": F.xxhash64("b")})
        # evened at run time: small rounds go to one task, and a hub's edges to several
        made = both.hint("rebalance", "a").mapInPandas(contract, f"node {kind}, root {kind}, h long")
        first = F.min(F.struct("h", "root")).over(Window.partitionBy("node"))
        made = s.table(made.withColumn("first", first).select("node", "root", F.col("first.root").alias("to")), f"stars{len(hops)}")
        hops.append(made.select("node", "to").distinct())
        live = made.where("root <> to").select(F.col("root").alias("a"), F.col("to").alias("b")).distinct()
        if live.isEmpty():
            break
    at = hops[0]
    for r, hop in enumerate(hops[1:]):
        on = hop.select(F.col("node").alias("to"), F.col("to").alias("next"))
        at = s.table(at.join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to")), f"at{r}")
    least = at.groupBy("to").agg(F.min("node").alias("component"))
    return at.join(least, "to").select("node", "component")
