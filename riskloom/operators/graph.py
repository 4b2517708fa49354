"""Graph operators over edge tables: cores, features, PageRank, betweenness, projection.

Edges are two columns ``src`` and ``dst``, undirected. What a component decides alone is
solved component by component: of at most LOCAL ends in tasks, many components to each,
with exact in-memory algorithms; larger ones by rounds of joins and aggregations over
tables in shared storage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import Scratch
from .components import connected_components, least_labels as components_of
from .ranges import quantiles_of

#: Ends of edges up to which a component is one task's work, and about which a task is given of small ones.
LOCAL, DEALT = 4_000_000, 1_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) in both directions, without loops."""
    e = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    return e.union(e.select("dst", "src")).distinct()


def numbered(e: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node names in order, and the ends of each edge as places among them."""
    names, at = np.unique(np.concatenate([e["src"].to_numpy(), e["dst"].to_numpy()]), return_inverse=True)
    return names, at[:len(e)], at[len(e):]


def adjacency(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each node, in one array with offsets; (a, b) holds both directions."""
    order = np.argsort(a, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b[order]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node with an edge or a loop."""
    return connected_components(edges)


def dealt(both: DataFrame, comp: DataFrame, s: Scratch, local: int) -> tuple[DataFrame, DataFrame | None]:
    """(component, src, dst, part) of components of at most ``local`` ends, dealt to tasks whole and many together, and the edges of larger ones, if any."""
    own = s.table(both.join(comp.withColumnRenamed("node", "src"), "src"), "own")
    sizes = own.groupBy("component").agg(F.count("*").alias("ends"))
    told = sizes.agg(F.max("ends").alias("most"), F.sum("ends").alias("all")).first()
    # as even as hashing makes them; a part is about as large as the largest component that it may hold
    part = F.pmod(F.xxhash64("component"), F.lit(max(1, (told["all"] or 0) // max(1, min(local, DEALT)))))
    if (told["most"] or 0) <= local:
        return own.withColumn("part", part), None
    large = s.table(sizes.where(F.col("ends") > local).select("component"), "large")
    return own.join(large, "component", "left_anti").withColumn("part", part), own.join(large, "component", "left_semi").select("src", "dst")


def peel(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Core numbers: nodes leave in waves, all of the current level at once."""
    ends, near = adjacency(n, a, b)
    degree, core, alive, k = np.diff(ends), np.zeros(n, np.int64), np.ones(n, bool), 0
    degree = degree.copy()
    while alive.any():
        k = max(k, int(degree[alive].min()))
        wave = np.flatnonzero(alive & (degree <= k))
        while len(wave):
            core[wave], alive[wave] = k, False
            lost = np.concatenate([near[ends[v]:ends[v + 1]] for v in wave])
            degree -= np.bincount(lost, minlength=n)
            wave = np.flatnonzero(alive & (degree <= k))
    return core


def k_core(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, core): exact core number of every node with an edge.

    Cores of a component depend on it alone: components of at most ``local`` ends are peeled
    in tasks, many together. In larger ones the h-index of the neighbours' values is taken
    again and again from the degrees downwards until nothing changes. Neighbours are counted
    by value before the window, so a hub sends its distinct values, not its neighbours.
    """
    kind = edges.schema["src"].dataType.simpleString()
    s = Scratch(edges.sparkSession, "kcore")
    both = s.table(undirected(edges), "edges")
    small, large = dealt(both, connected_components(both), s, local)

    def solve(e: pd.DataFrame) -> pd.DataFrame:
        names, a, b = numbered(e)
        return pd.DataFrame({"node": names, "core": peel(len(names), a, b)})

    done = small.groupBy("part").applyInPandas(solve, f"node {kind}, core long")
    return done if large is None else done.union(large_cores(s.table(large, "rest"), s))


def large_cores(both: DataFrame, s: Scratch) -> DataFrame:
    """(node, core) by rounds of joins; ``both`` holds both directions. Values only fall, so the rounds end."""
    h = s.table(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("h")), "h0")
    r = 0
    while True:
        own = both.join(h.select(F.col("node").alias("dst"), F.col("h").alias("theirs")), "dst").join(
            h.select(F.col("node").alias("src"), F.col("h").alias("mine")), "src")
        counted = own.groupBy("src", "mine", F.least("theirs", "mine").alias("v")).agg(F.count("*").alias("n"))
        at_least = F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("v")))
        new = counted.withColumn("m", F.least("v", at_least)).groupBy(F.col("src").alias("node")).agg(F.max("m").alias("h"), F.max("mine").alias("was"))
        r += 1
        new = s.table(new, f"h{r}")
        h = new.select("node", "h")
        if new.where("h <> was").isEmpty():
            return h.select("node", F.col("h").alias("core"))
        if r > 1:
            s.drop(f"h{r - 2}")


def bipartite(edges: DataFrame) -> DataFrame:
    """(src, dst) of entity-attribute links; entities sort before attributes, so a component is named by an entity."""
    return edges.select(F.concat(F.lit("0|"), "uid").alias("src"), F.concat(F.lit("1|"), "key_name", F.lit("|"), "value").alias("dst"))


def graph_features(entities: DataFrame, edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """Per entity: component (least uid), its sizes in entities and in all nodes, core number, degree, linked flag.

    An isolated entity is its own component of size 1 with core number and degree 0.
    """
    pairs = Scratch(edges.sparkSession, "features").table(bipartite(edges), "pairs")
    comp = components(pairs)
    entity = F.col("node").startswith("0|")
    sizes = comp.groupBy("component").agg(F.count_if(entity).alias("g_component_size"), F.count("*").alias("g_component_size_total"))
    uid = F.substring("node", 3, 1 << 30)
    linked = comp.where(entity).join(sizes, "component").select(uid.alias("uid"), F.substring("component", 3, 1 << 30).alias("g_component"), "g_component_size", "g_component_size_total")
    core = k_core(pairs, local).where(entity).select(uid.alias("uid"), F.col("core").alias("g_core_number"))
    degree = edges.groupBy("uid").agg(F.count("*").alias("g_degree"))
    one = lambda c, v: F.coalesce(F.col(c), F.lit(v)).cast("long").alias(c)
    return entities.select("uid").join(linked, "uid", "left").join(core, "uid", "left").join(degree, "uid", "left").select(
        "uid", F.coalesce("g_component", "uid").alias("g_component"), one("g_component_size", 1), one("g_component_size_total", 1),
        one("g_core_number", 0), one("g_degree", 0), F.when(F.col("g_degree") > 0, 1).otherwise(0).cast("long").alias("g_is_linked"))


def attach(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Features on rows by uid; a null uid keeps null features, an isolated entity has zeros."""
    return rows.join(features, "uid", "left")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-10, rounds: int = 100, local: int = LOCAL) -> DataFrame:
    """(node, rank): power iteration from 1/N, the mass of nodes without edges spread evenly; the last vector after ``rounds``.

    Only nodes without edges give their mass to all, and all of them have one rank, which is
    known for every round from their number. So components go their own ways: those of at
    most ``local`` ends in tasks, many together, each telling how far its ranks moved in every
    round; larger ones by rounds of joins. The rounds end when all moves together are small.
    """
    kind = edges.schema["src"].dataType.simpleString()
    s = Scratch(edges.sparkSession, "pagerank")
    both = s.table(undirected(edges), "edges")
    linked = both.select(F.col("src").alias("node")).distinct()
    lone = None
    if nodes is not None:
        lone = s.table(nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null").distinct().join(linked, "node", "left_anti"), "lone")
    alone = lone.count() if lone is not None else 0
    n = linked.count() + alone
    if not n:
        return linked.withColumn("rank", F.lit(0.0))
    # what every node is given in each round, and how far the lone ones moved
    given, moved, x = [], np.zeros(rounds), 1 / n
    for r in range(rounds):
        given.append((1 - damping + damping * alone * x) / n)
        moved[r] = alone * abs(given[-1] - x)
        x = given[-1]
    small, large = dealt(both, connected_components(both), s, local)

    def solve(e: pd.DataFrame, upto: int) -> pd.DataFrame:
        names, a, b = numbered(e)
        degree, rank, far = np.bincount(a, minlength=len(names)), np.full(len(names), 1 / n), np.zeros(rounds)
        for r in range(upto):
            new = given[r] + damping * np.bincount(b, (rank / degree)[a], len(names))
            far[r], rank = np.abs(new - rank).sum(), new
        return pd.DataFrame({"node": names, "rank": rank, "far": [far if i == 0 else None for i in range(len(names))]})

    solved = lambda upto: small.groupBy("part").applyInPandas(lambda e: solve(e, upto), f"node {kind}, rank double, far array<double>")
    ranks = s.table(solved(rounds), "small")
    for r, far in ranks.where("far is not null").select(F.posexplode("far").alias("r", "far")).groupBy("r").agg(F.sum("far")).collect():
        moved[r] += far
    last = rounds
    out = None
    if large is not None:
        out, last = _large_ranks(s.table(large, "rest"), s, n, damping, given, moved, tolerance)
    elif (moved < tolerance).any():
        last = int(np.argmax(moved < tolerance)) + 1
    done = (ranks if last == rounds else solved(last)).select("node", "rank")
    if out is not None:
        done = done.union(out)
    return done if lone is None else done.union(lone.select("node", F.lit(given[last - 1]).alias("rank")))


def _large_ranks(both: DataFrame, s: Scratch, n: int, damping: float, given: list[float], moved: np.ndarray, tolerance: float) -> tuple[DataFrame, int]:
    """(node, rank) of large components and the number of rounds; ``moved``: how far all other ranks move in each."""
    rank = s.table(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")), "nodes").withColumn("rank", F.lit(1.0 / n))
    for r, base in enumerate(given):
        shares = both.join(rank.select(F.col("node").alias("src"), (F.col("rank") / F.col("d")).alias("g")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("g").alias("g"))
        new = s.table(rank.withColumnRenamed("rank", "was").join(shares, "node").select("node", "d", (F.lit(base) + damping * F.col("g")).alias("rank"), "was"), f"rank{r}")
        far = new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        rank = new.drop("was")
        if far + moved[r] < tolerance:
            break
    return rank.select("node", "rank"), r + 1


#: Nodes up to which a component is solved as a dense matrix; edges that one task walks over, about, in larger ones.
DENSE, WALK = 192, 20_000_000


def dense_betweenness(near: np.ndarray) -> np.ndarray:
    """Unscaled betweenness of graphs given as a stack of adjacency matrices of one size: all sources, level by level."""
    graphs, n, _ = near.shape
    front = np.broadcast_to(np.eye(n), near.shape)
    paths, depth, level = front.copy(), np.where(front > 0, 0, -1), 0
    while True:
        front = np.where(depth < 0, front @ near, 0.0)
        if not front.any():
            break
        level += 1
        paths += front
        depth = np.where(front > 0, level, depth)
    share = np.zeros(near.shape)
    for d in range(level, 1, -1):
        back = np.where(depth == d, (1 + share) / np.where(paths > 0, paths, 1), 0.0) @ near
        share += np.where(depth == d - 1, paths * back, 0.0)
    return share.sum(1)


def source_betweenness(n: int, ends: np.ndarray, near: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Unscaled betweenness that shortest paths from ``roots`` give to the nodes of one graph."""
    total = np.zeros(n)
    for root in roots:
        depth, paths = np.full(n, -1), np.zeros(n)
        depth[root], paths[root] = 0, 1
        waves, steps = [np.array([root])], []
        while len(waves[-1]):
            # one step outwards for a whole wave: edges from it to nodes not reached before
            wave = waves[-1]
            size = np.diff(ends)[wave]
            v = np.repeat(wave, size)
            w = near[np.repeat(ends[wave] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            new = depth[w] < 0
            depth[w[new]] = len(waves)
            on = depth[w] == len(waves)
            np.add.at(paths, w[on], paths[v[on]])
            steps.append((v[on], w[on]))
            waves.append(np.unique(w[new]))
        share = np.zeros(n)
        for v, w in reversed(steps[1:]):
            np.add.at(share, v, paths[v] / paths[w] * (1 + share[w]))
        share[root] = 0
        total += share
    return total


def small_components(e: pd.DataFrame) -> pd.DataFrame:
    """(node, betweenness), unscaled, of whole components of at most DENSE nodes: those of one size together. ``e`` holds both directions."""
    names, a, b = numbered(e)
    label = components_of(len(names), a, b)
    order = np.argsort(label, kind="stable")
    size = np.bincount(label, minlength=len(names))
    first = np.cumsum(size) - size
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names)) - first[label[order]]
    total = np.zeros(len(names))
    for n in np.unique(size[size > 2]).tolist():
        roots = np.flatnonzero(size == n)
        step = max(1, (1 << 22) // (n * n))
        for i in range(0, len(roots), step):
            own = roots[i:i + step]
            at = np.full(len(names), -1)
            at[own] = np.arange(len(own))
            inside = at[label[a]] >= 0
            near = np.zeros((len(own), n, n))
            near[at[label[a[inside]]], place[a[inside]], place[b[inside]]] = 1
            nodes = order[first[own][:, None] + np.arange(n)]
            total[nodes] = dense_betweenness(near)
    return pd.DataFrame({"node": names, "betweenness": total})


def betweenness(edges: DataFrame, n_all: int | None = None, local: int = LOCAL) -> DataFrame:
    """(node, betweenness): Brandes within each component, scaled by the whole graph's size.

    Components of at most DENSE nodes go to tasks many at a time. The sources of a larger
    one are dealt to tasks of about WALK steps, each with the component's edges, and their
    parts are added up.
    """
    kind = edges.schema["src"].dataType.simpleString()
    s = Scratch(edges.sparkSession, "betweenness")
    both = s.table(undirected(edges), "edges")
    comp = s.table(components(both), "components")
    n_all = comp.count() if n_all is None else n_all
    scale = 1 / ((n_all - 1) * (n_all - 2)) if n_all >= 3 else 0.0
    own = both.join(comp.withColumnRenamed("node", "src"), "src")
    sizes = s.table(own.groupBy("component").agg(F.countDistinct("src").alias("nodes"), F.count("*").alias("ends")), "sizes")
    schema = f"node {kind}, betweenness double"
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, sizes.count() // 20_000)
    small = own.join(sizes.where(F.col("nodes") <= DENSE).select("component"), "component").withColumn("part", F.pmod(F.xxhash64("component"), F.lit(parts)))
    done = small.groupBy("part").applyInPandas(lambda e: small_components(e[["src", "dst"]]), schema)
    large = s.table(sizes.where(F.col("nodes") > DENSE), "large")
    if not large.isEmpty():
        dealt = large.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("nodes") * F.col("ends") / WALK)).cast("int"))
        pairs = own.join(dealt.select("component", "chunks"), "component").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

        def walk(e: pd.DataFrame) -> pd.DataFrame:
            names, a, b = numbered(e)
            ends, near = adjacency(len(names), a, b)
            roots = np.arange(int(e["chunk"].iloc[0]), len(names), int(e["chunks"].iloc[0]))
            return pd.DataFrame({"node": names, "betweenness": source_betweenness(len(names), ends, near, roots)})

        done = done.union(pairs.groupBy("component", "chunk").applyInPandas(walk, schema).groupBy("node").agg(F.sum("betweenness").alias("betweenness")))
    return done.select("node", (F.col("betweenness") * scale).alias("betweenness"))


def project(edges: DataFrame, max_group: int = 64) -> DataFrame:
    """Distinct entity pairs (a < b) that share an attribute value held by 2 to ``max_group`` entities."""
    e = edges.select("uid", "key_name", "value").distinct()
    fit = e.groupBy("key_name", "value").count().where(F.col("count").between(2, max_group)).select("key_name", "value")
    e = e.join(fit, ["key_name", "value"], "left_semi")
    return e.withColumnRenamed("uid", "a").join(e.withColumnRenamed("uid", "b"), ["key_name", "value"]).where("a < b").select("a", "b").distinct()


def describe_graph(name: str, vertices: DataFrame, edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row of shape figures; components count from two nodes up. Without edges the largest and mean component and the core are null."""
    key = vertices.columns[0]
    both = undirected(edges)
    deg = vertices.select(F.col(key).alias("node")).join(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")), "node", "left")
    base = deg.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("d"), F.lit(0)).alias("ends"), F.count_if(F.col("d").isNull()).alias("lone"))
    comps = components(both).groupBy("component").count().agg(
        F.count("*").alias("components"), F.max("count").alias("largest_component"), F.round(F.avg("count"), 4).alias("mean_component"))
    cores = k_core(edges, local).agg(F.max("core").alias("max_core"))
    return base.crossJoin(comps).crossJoin(cores).select(  # one row each
        F.lit(name).alias("name"), "nodes", (F.col("ends") / 2).cast("long").alias("edges"), F.round(F.try_divide("ends", "nodes"), 4).alias("mean_degree"),
        F.round(F.try_divide("lone", "nodes"), 6).alias("isolated_share"), "components", "largest_component", "mean_component", F.col("max_core").cast("long").alias("max_core"))


def graph_summary(features: DataFrame, links: DataFrame, cap: int) -> DataFrame:
    """One row about an entity graph; the mean component is over linked entities."""
    from .entity import hub_drops

    linked = F.col("g_is_linked") == 1
    f = features.agg(
        F.count("*").alias("entities"), F.sum("g_degree").alias("edges"), F.round(F.avg(F.col("g_is_linked").cast("double")), 6).alias("linked_fraction"),
        F.max("g_component_size").alias("largest_component"), F.round(F.avg(F.when(linked, F.col("g_component_size"))), 4).alias("mean_component_of_linked"),
        F.max("g_core_number").alias("max_core"))
    return f.crossJoin(hub_drops(links, cap))  # one row by one row


def centrality_variance(ranks: DataFrame, labels: DataFrame) -> DataFrame:
    """Spread of PageRank and betweenness within components of two or more linked members.

    ``ranks``: uid, rank, betweenness; ``labels``: uid, component.
    """
    per = ranks.join(labels, "uid").groupBy("component").agg(
        F.count("*").alias("n"), F.stddev_pop("rank").alias("sd"), F.avg("rank").alias("mean"), F.avg(F.when(F.col("betweenness") == 0, 1.0).otherwise(0.0)).alias("zero"),
        F.count_if(F.col("betweenness") == 0).alias("zeros")).where("n >= 2").withColumn("cv", F.try_divide("sd", "mean"))
    per = Scratch(ranks.sparkSession, "variance").table(per, "components")
    median = (quantiles_of(per, "cv", [0.5]) or [None])[0]
    return per.agg(F.count("*").alias("components"), F.round(F.lit(median).cast("double"), 6).alias("median_cv"), F.round(F.avg("cv"), 6).alias("mean_cv"),
                   F.round(F.try_divide(F.sum("zeros"), F.sum("n")), 6).alias("zero_betweenness_share"))


def centrality_features(entities: DataFrame, edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(uid, g_pagerank, g_betweenness) of every entity, over the graph of all entities and attributes, isolated ones included."""
    s = Scratch(edges.sparkSession, "centrality")
    pairs = s.table(bipartite(edges), "pairs")
    names = entities.select(F.concat(F.lit("0|"), "uid").alias("node"))
    nodes = s.table(names.union(pairs.select(F.col("dst").alias("node"))).distinct(), "nodes")
    uid = F.substring("node", 3, 1 << 30).alias("uid")
    own = F.col("node").startswith("0|")
    ranks = pagerank(pairs, nodes, local=local).where(own).select(uid, F.col("rank").alias("g_pagerank"))
    between = betweenness(pairs, nodes.count(), local).where(own).select(uid, F.col("betweenness").alias("g_betweenness"))
    return entities.select("uid").join(ranks, "uid", "left").join(between, "uid", "left").withColumn("g_betweenness", F.coalesce("g_betweenness", F.lit(0.0)))


def centrality_for_split(train: DataFrame, test: DataFrame, columns: list[str], link_keys: dict, cap: int = 5, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """As features_for_split(), with centrality: train rows from the graph of train alone, test rows from that of both."""
    from .entity import entity_frame, links_long, suppressed_edges

    def features(rows: DataFrame) -> DataFrame:
        entities = entity_frame(rows, columns)
        return centrality_features(entities, suppressed_edges(links_long(entities, link_keys), cap), local)

    return attach(train, features(train)), attach(test, features(train.unionByName(test)))


def features_for_split(train: DataFrame, test: DataFrame, columns: list[str], link_keys: dict, cap: int = 5, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """Rows with features of two graphs: train rows from train alone, test rows from both; the train graph never sees a test row."""
    from .entity import entity_frame, links_long, suppressed_edges

    def features(rows: DataFrame) -> DataFrame:
        entities = entity_frame(rows, columns)
        return graph_features(entities, suppressed_edges(links_long(entities, link_keys), cap), local)

    return attach(train, features(train)), attach(test, features(train.unionByName(test)))
