"""Graph features under several hub caps at once.

The edges of an attribute value count from the first cap on that its holders do not pass,
so graphs of rising caps are nested. Components come from a merge forest: the edges that a
cap adds are contracted on what the caps before have left, each edge once. Core numbers of
all caps are peeled where the largest cap's component lies. ``caps`` rise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch
from .components import connected_components
from .entity import attribute_groups
from .graph import DEALT, LOCAL, large_cores, peel, undirected
from .metrics import average_precision


def levelled_edges(links: DataFrame, caps: tuple[int, ...]) -> DataFrame:
    """(src, dst, level) of values held by 2 to the last cap; ``level`` is the place of the first cap that lets the value link."""
    if list(caps) != sorted(set(caps)):
        raise ValueError("caps must rise")
    groups = attribute_groups(links).where(F.col("members").between(2, caps[-1]))
    level = F.size(F.filter(F.array(*[F.lit(c) for c in caps]), lambda c: c < F.col("members")))
    sized = links.join(groups.select("key_name", "value", level.alias("level")), ["key_name", "value"])
    return sized.select(F.concat(F.lit("0|"), "uid").alias("src"), F.concat(F.lit("1|"), "key_name", F.lit("|"), "value").alias("dst"), "level")


def merge_forest(edges: DataFrame, caps: tuple[int, ...]) -> DataFrame:
    """(node, c0, c1, ...): the component of a node under each cap, null as long as it has no edge. ``edges``: of levelled_edges()."""
    s = Scratch(edges.sparkSession, "forest")
    at = None
    for i in range(len(caps)):
        own = edges.where(F.col("level") == i).select("src", "dst")
        if at is None:
            at = s.table(connected_components(own).withColumnRenamed("component", "c0"), "at0")
            continue
        last, new = f"c{i - 1}", f"c{i}"
        roots = at.where(F.col(last).isNotNull()).select(F.col("node").alias("src"), F.col(last).alias("root"))
        found = s.table(connected_components(own.join(roots, "src", "left").select(F.coalesce("root", "src").alias("src"), "dst")), f"found{i}")
        moved = at.join(found.select(F.col("node").alias(last), "component"), last, "left").select("node", *[f"c{j}" for j in range(i)], F.coalesce("component", last).alias(new))
        fresh = found.join(at, "node", "left_anti").select("node", *[F.lit(None).cast("string").alias(f"c{j}") for j in range(i)], F.col("component").alias(new))
        at = s.table(moved.union(fresh), f"at{i}")
    return at


def cores_by_cap(edges: DataFrame, forest: DataFrame, caps: tuple[int, ...], local: int = LOCAL) -> DataFrame:
    """(level, node, core) of nodes with an edge under a cap; components of at most ``local`` edges are peeled in tasks under all caps, larger ones by rounds, a cap at a time."""
    s = Scratch(edges.sparkSession, "capcores")
    last = forest.select(F.col("node").alias("src"), F.col(f"c{len(caps) - 1}").alias("component"))
    own = s.table(edges.join(last, "src"), "own")
    large = s.table(own.groupBy("component").count().where(F.col("count") > local).select("component"), "large")
    parts = max(1, own.count() // max(1, min(local, DEALT)))
    small = own.join(large, "component", "left_anti").withColumn("part", F.pmod(F.xxhash64("component"), F.lit(parts)))

    def solve(e: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(pd.concat([e["src"], e["dst"]], ignore_index=True))
        a, b, level = code[:len(e)], code[len(e):], e["level"].to_numpy()
        out = []
        for i in range(len(caps)):
            x, y = a[level <= i], b[level <= i]
            core = peel(len(names), np.concatenate([x, y]), np.concatenate([y, x]))
            there = np.flatnonzero(core)
            out.append(pd.DataFrame({"level": i, "node": np.asarray(names)[there], "core": core[there]}))
        return pd.concat(out)

    done = small.groupBy("part").applyInPandas(solve, "level int, node string, core long")
    if not large.isEmpty():
        rest = s.table(own.join(large, "component", "left_semi").select("src", "dst", "level"), "rest")
        for i in range(len(caps)):
            both = s.table(undirected(rest.where(F.col("level") <= i)), f"both{i}")
            if not both.isEmpty():
                done = done.union(large_cores(both, Scratch(edges.sparkSession, "capcores")).select(F.lit(i).alias("level"), "node", "core"))
    return done


def features_by_cap(entities: DataFrame, links: DataFrame, caps: tuple[int, ...] = (5, 20, 50), local: int = LOCAL) -> DataFrame:
    """cap and the columns of graph_features() of every entity, under each cap."""
    s = Scratch(links.sparkSession, "caps")
    edges = s.table(levelled_edges(links, caps), "edges")
    forest = merge_forest(edges, caps)
    cores = s.table(cores_by_cap(edges, forest, caps, local), "cores")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"c{i}").alias("component")) for i in range(len(caps))])).alias("x")
    placed = s.table(forest.select("node", each).select("node", "x.level", "x.component").where("component is not null"), "placed")
    entity, uid = F.col("node").startswith("0|"), F.substring("node", 3, 1 << 30).alias("uid")
    sizes = placed.groupBy("level", "component").agg(F.count_if(entity).alias("g_component_size"), F.count("*").alias("g_component_size_total"))
    # an edge counts under its own cap and all that follow
    degree = edges.select("src", F.explode(F.sequence(F.col("level"), F.lit(len(caps) - 1))).alias("level")).groupBy(F.col("src").alias("node"), "level").agg(F.count("*").alias("g_degree"))
    linked = placed.where(entity).join(sizes, ["level", "component"]).join(cores, ["level", "node"]).join(degree, ["level", "node"])
    linked = linked.select("level", uid, F.substring("component", 3, 1 << 30).alias("g_component"), "g_component_size", "g_component_size_total", F.col("core").alias("g_core_number"), "g_degree")
    every = entities.select("uid", F.posexplode(F.array(*[F.lit(c) for c in caps])).alias("level", "cap"))
    one = lambda c, v: F.coalesce(F.col(c), F.lit(v)).cast("long").alias(c)
    return every.join(linked, ["level", "uid"], "left").select(
        "cap", "uid", F.coalesce("g_component", "uid").alias("g_component"), one("g_component_size", 1), one("g_component_size_total", 1), one("g_core_number", 0), one("g_degree", 0),
        F.when(F.col("g_degree") > 0, 1).otherwise(0).cast("long").alias("g_is_linked"))


def cap_report(features: DataFrame, rows: DataFrame, caps: tuple[int, ...], y: str = "y", s: str = "s", v: str = "v") -> DataFrame:
    """A row a cap: size and shape of its graph, the share of ``rows`` on linked entities, and the average precision of two scores there.

    ``features``: of features_by_cap(); ``rows``: uid, y and both scores. Without positives on linked rows both precisions are null.
    """
    linked = F.col("g_is_linked") == 1
    shape = features.groupBy("cap").agg(F.sum("g_degree").alias("edges"), F.count_if(linked).alias("linked_entities"), F.count_distinct(F.when(linked, F.col("g_component"))).alias("components"),
                                        F.max("g_component_size").alias("largest_component"), F.max("g_core_number").alias("max_core"))
    every = rows.select("uid", F.col(y).alias("y"), F.col(s).alias("s"), F.col(v).alias("v"), F.explode(F.array(*[F.lit(c) for c in caps])).alias("cap"))
    own = Scratch(rows.sparkSession, "caps").table(every.join(features.select("cap", "uid", "g_is_linked"), ["cap", "uid"], "left"), "rows")
    covered = own.groupBy("cap").agg(F.round(F.avg(F.when(linked, 1.0).otherwise(0.0)), 6).alias("row_coverage"), F.count_if(linked).alias("linked_rows"), F.coalesce(F.sum(F.when(linked, F.col("y"))), F.lit(0)).alias("linked_fraud"))
    out = shape.join(covered, "cap")
    for name, score in (("base_ap", "s"), ("variant_ap", "v")):
        out = out.join(average_precision(own.where(linked), s=score, by=("cap",)).select("cap", F.round("ap", 6).alias(name)), "cap", "left")
    return out
