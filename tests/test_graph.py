import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.operators import components, entity, graph, live
from riskloom.streaming.cores import Cores, maintained
from riskloom.streaming.core_tables import IncrementalCore


def gnm(n, m, seed):
    r = random.Random(seed)
    out = set()
    while len(out) < m:
        a, b = r.sample(range(n), 2)
        out.add((min(a, b), max(a, b)))
    return sorted(out)


def cores(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    core, k = {}, 0
    while near:
        v = min(near, key=lambda x: (len(near[x]), x))
        k = max(k, len(near[v]))
        core[v] = k
        for w in near.pop(v):
            near[w].discard(v)
    return core


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


SHAPES = {
    "random": gnm(60, 120, 1), "sparse": gnm(80, 60, 2), "path": [(i, i + 1) for i in range(30)],
    "barbell": [(a, b) for a in range(6) for b in range(a)] + [(5, 6), (6, 7), (7, 8)] + [(a + 8, b + 8) for a in range(6) for b in range(a)],
    "bipartite": [(a, 10 + b) for a in range(4) for b in range(7)],
}


@pytest.mark.parametrize("name", SHAPES)
def test_components_and_cores(spark, name):
    e = SHAPES[name]
    df = spark.createDataFrame(e, "src long, dst long")
    assert {r.node: r.component for r in graph.components(df).collect()} == roots(e)
    assert {r.node: r.core for r in graph.k_core(df).collect()} == cores(e)


def test_distributed_ways_agree(spark):
    e = SHAPES["random"]
    df = spark.createDataFrame(e + [(3, 3), (200, 200)], "src long, dst long")
    want = roots(e) | {200: 200}
    assert {r.node: r.component for r in components.connected_components(df).collect()} == want
    assert {r.node: r.core for r in graph.k_core(df, local=0).collect()} == cores(e)
    a = {r.node: r["rank"] for r in graph.pagerank(df, rounds=8).collect()}
    b = {r.node: r["rank"] for r in graph.pagerank(df, rounds=8, local=0).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a) and abs(sum(a.values()) - 1) < 1e-9


def test_betweenness_of_a_path(spark):
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "src long, dst long")
    got = {r.node: r.betweenness for r in graph.betweenness(df).collect()}
    assert [round(got[i], 6) for i in range(5)] == [0, 0.5, round(4 / 6, 6), 0.5, 0]


def plain_betweenness(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        depth, paths, order = {s: 0}, defaultdict(float, {s: 1.0}), [s]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    n = len(near)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


@pytest.mark.parametrize("dense,walk", [(192, 20_000_000), (3, 500)])
def test_betweenness_however_dealt(spark, monkeypatch, dense, walk):
    """Small components as matrices, and a large one's sources over many tasks."""
    monkeypatch.setattr(graph, "DENSE", dense)
    monkeypatch.setattr(graph, "WALK", walk)
    e = SHAPES["random"] + [(a + 1000, b + 1000) for a, b in SHAPES["barbell"]] + [(2000 + 3 * i, 2001 + 3 * i) for i in range(9)] + [(3000 + 5 * i + j, 3001 + 5 * i + j) for i in range(6) for j in range(3)]
    got = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(e, "src long, dst long")).collect()}
    want = plain_betweenness(e)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_centrality_keeps_the_future_out(spark):
    cols = "TransactionID long, TransactionDT long, card1 long, addr1 long, D1 long"
    a = entity.build_uid(spark.createDataFrame([(1, 0, 1, 7, 0), (9, 0, None, 7, 0)], cols))
    b = entity.build_uid(spark.createDataFrame([(2, 86400, 2, 7, 0), (3, 86400, 3, 8, 0)], cols))
    tr, te = graph.centrality_for_split(a, b, ["addr1"], {"addr1": ("addr1",)})
    first = {r.TransactionID: r for r in tr.collect()}
    later = {r.TransactionID: r for r in te.collect()}
    assert abs(first[1].g_pagerank - 1) < 1e-9 and first[1].g_betweenness == 0 and first[9].g_pagerank is None
    assert later[2].g_pagerank > later[3].g_pagerank > 0


def test_cores_follow_every_edge():
    r = random.Random(3)
    for name in SHAPES:
        e = [(str(a), str(b)) for a, b in SHAPES[name]]
        r.shuffle(e)
        c = Cores()
        for i, (a, b) in enumerate(e):
            before = dict(c.core)
            rose = c.insert(a, b)
            assert rose == {n for n, k in c.core.items() if k != before.get(n, 0)}
            assert i % 5 or c.matches_batch()
        assert c.matches_batch() and c.insert(*e[0]) == c.insert("x", "x") == set()
        seeded = Cores.of(e[:-1], ["lone"])
        seeded.insert(*e[-1])
        assert seeded.core == c.core | {"lone": 0}


def test_cores_as_the_state_of_a_stream(spark, tmp_path):
    e = gnm(12, 24, 8)
    (tmp_path / "in").mkdir()
    base = f"file://{tmp_path}"
    last = {}
    for i in range(2):
        spark.createDataFrame([("g", str(a), str(b)) for a, b in e[12 * i:12 * i + 12]] + [("h", "p", f"q{i}")], "graph string, src string, dst string").coalesce(1).write.mode("append").parquet(f"{base}/in")
        edges = spark.readStream.schema("graph string, src string, dst string").parquet(f"{base}/in")

        def each(batch, n):
            for x in batch.collect():
                last[x.graph, x.node] = x.core

        maintained(edges).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert {int(n): k for (g, n), k in last.items() if g == "g"} == cores(e) and last["h", "p"] == 1


def test_empty_graph(spark):
    df = spark.createDataFrame([], "src long, dst long")
    assert graph.components(df).count() == graph.k_core(df).count() == components.connected_components(df).count() == 0


ENTITIES = [(f"u{i}", c, a, e, 150, 226) for i, (c, a, e) in enumerate([(1000, 204, "a.com"), (1000, 204, "a.com"), (2000, 204, "b.com"), (3000, 299, "c.com"), (4000, 299, "c.com"), (5000, 325, "d.com")])]


def test_hub_cap_and_features(spark):
    df = spark.createDataFrame(ENTITIES, "uid string, card1 long, addr1 long, P_emaildomain string, card3 long, card5 long")
    links = entity.links_long(df)
    f = {r.uid: r for r in graph.graph_features(df, entity.suppressed_edges(links)).collect()}
    assert f["u0"].g_component == f["u1"].g_component == f["u2"].g_component == "u0"
    assert f["u3"].g_component_size == 2 and f["u5"].g_component_size == 1 and f["u5"].g_core_number == f["u5"].g_degree == 0
    assert entity.suppressed_edges(links, cap=2).where("uid = 'u2'").count() == 0
    assert entity.hub_drops(links, 2).first().dropped_hub_values == 1


def test_null_parts_give_no_uid(spark):
    df = spark.createDataFrame([(86400.0 * 10, 1.0, 2.0, 3.0), (0.0, None, 2.0, 3.0), (0.0, 1.0, 2.0, 3.0)], "TransactionDT double, card1 double, addr1 double, D1 double")
    assert [r.uid for r in entity.build_uid(df).collect()] == ["1_2_7", None, "1_2_-3"]


def test_first_value_is_taken_per_column(spark):
    df = spark.createDataFrame([("u", 2, 5, None, "b"), ("u", 1, 1, None, None), ("u", 3, 9, "x", "c")], "uid string, TransactionID long, TransactionDT long, p string, q string")
    assert tuple(entity.entity_frame(df, ["p", "q"]).first()) == ("u", "x", "b")


def test_projection_ignores_large_groups(spark):
    e = spark.createDataFrame([(f"u{i}", "k", "v") for i in range(5)] + [("u0", "k", "w"), ("u1", "k", "w")], "uid string, key_name string, value string")
    assert [tuple(r) for r in graph.project(e, 4).collect()] == [("u0", "u1")]


def test_live_entities(spark):
    e = spark.createDataFrame([("a", "x", None), ("b", "x", None), ("c", None, None)], "payer_key string, card_fingerprint string, vpa string")
    got = {r.payer_key: r for r in live.analyse_all(e, ("card_fingerprint", "vpa")).collect()}
    assert got["a"].linked_payers == ["b"] and got["a"].shared_attributes == ["card_fingerprint"] and got["c"].component_size == 1
    assert live.analyse(e, "c", attributes=("card_fingerprint",)).first().total_entities == 3


@pytest.mark.parametrize("buckets", [4, 256])
def test_incremental_core_equals_batch(spark, buckets):
    """Few buckets are all read, of many only those of the plateau; a batch may raise a node several times."""
    kept, e = IncrementalCore(spark, buckets=buckets), gnm(16, 50, 4)
    random.Random(1).shuffle(e)
    before = {}
    for i, j in ((0, 20), (20, 21), (21, 22), (22, 50)):
        rose = {int(r.node): r.core for r in kept.insert(spark.createDataFrame(e[i:j] + [(1, 1), e[0]], "src long, dst long")).collect()}
        now = {int(r.node): r.core for r in kept.state.collect()}
        assert now == cores(e[:j]) and rose == {k: v for k, v in now.items() if before.get(k) != v}
        before = now
    assert kept.matches_batch() and kept.edges.count() == 50


def test_core_state_outlives_its_process_and_its_failures(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/state"
    df = lambda *e: spark.createDataFrame(list(e), "src string, dst string")
    IncrementalCore(spark, path).insert(df(("a", "b"), ("b", "c")), 0)
    kept = IncrementalCore(spark, path)
    with monkeypatch.context() as m:
        m.setattr(kept.store, "commit", lambda n=None: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.insert(df(("a", "c")), 1)
    again = IncrementalCore(spark, path)
    assert {r.node: r.core for r in again.state.collect()} == {"a": 1, "b": 1, "c": 1}
    assert {r.node: r.core for r in again.insert(df(("a", "c")), 1).collect()} == {"a": 2, "b": 2, "c": 2}
    assert again.insert(df(("c", "d")), 1).count() == 0  # a number that was committed
    with pytest.raises(RuntimeError):
        kept.store.forget()
        kept.insert(df(("x", "y")), 1)  # another writer was first
    last = IncrementalCore(spark, path)
    assert last.insert(df(("c", "d")), 2).count() == 1 and last.matches_batch() and last.edges.count() == 4


def test_a_step_reads_and_writes_its_own_buckets(spark, monkeypatch):
    """An edge far from the rest leaves the other buckets alone, however many there are."""
    kept = IncrementalCore(spark, buckets=512)
    kept.insert(spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(300)], "src string, dst string"))
    reads, plain = [], kept.store.read
    monkeypatch.setattr(kept.store, "read", lambda name, own=None: (reads.append(512 if own is None else len(own)), plain(name, own))[1])
    at = {b: v for b, v in kept.store.at["core"].items()}
    kept.insert(spark.createDataFrame([("a7", "b9")], "src string, dst string"))
    assert max(reads) <= 8 and sum(kept.store.at["core"][b] != v for b, v in at.items()) <= 4


def test_long_chains_and_hubs(spark):
    """A path of 5,000 nodes in an order of its own, a star of 20,000 and a ring that hangs on the path."""
    e = [(i * 7919 % 5000, (i + 1) * 7919 % 5000) for i in range(4999)] + [(10_000, 10_001 + i) for i in range(20_000)]
    ring = [(40_000 + i, 40_000 + (i + 1) % 500) for i in range(500)]
    df = spark.createDataFrame(e + ring + [(0, 40_000)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == roots(e + ring + [(0, 40_000)])
    core = {r.node: r.core for r in graph.k_core(df).collect()}
    assert len(core) == 25_501 and all(c == (2 if n >= 40_000 else 1) for n, c in core.items())


@pytest.mark.parametrize("held", [3, 1 << 19])
def test_components_however_few_edges_a_task_holds(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD", held)
    r = random.Random(9)
    e = [(str(a), str(b)) for a, b in gnm(200, 150, 3)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)] + [("hub", f"h{i}") for i in range(100)] + [("z", "z")]
    r.shuffle(e)
    df = spark.createDataFrame(e + [(None, "q"), ("q", None)], "src string, dst string").repartition(7)
    assert {x.node: x.component for x in components.connected_components(df).collect()} == roots(e)


@pytest.mark.parametrize("local", [40, 10**6])
def test_ranks_of_large_and_small_components_stop_together(spark, local):
    e = gnm(60, 120, 1) + [(1000 + 3 * i, 1001 + 3 * i) for i in range(9)] + [(2000 + i, 2001 + i) for i in range(6)]
    nodes = spark.createDataFrame([(x,) for x in {n for p in e for n in p} | {9000, 9001, 9002}] + [(None,)], "n long")
    near = defaultdict(set)
    for a, b in e:
        near[a].add(b)
        near[b].add(a)
    every = [*near, 9000, 9001, 9002]
    rank, n = dict.fromkeys(every, 1 / len(every)), len(every)
    for done in range(100):
        lost = sum(rank[x] for x in (9000, 9001, 9002))
        new = {x: 0.15 / n + 0.85 * (sum(rank[y] / len(near[y]) for y in near.get(x, ())) + lost / n) for x in every}
        moved, rank = sum(abs(new[x] - rank[x]) for x in every), new
        if moved < 1e-4:
            break
    assert done < 60
    got = {r.node: r["rank"] for r in graph.pagerank(spark.createDataFrame(e, "src long, dst long"), nodes, tolerance=1e-4, local=local).collect()}
    assert got.keys() == rank.keys() and all(abs(got[k] - rank[k]) < 1e-12 for k in got)


def test_train_graph_never_sees_test_rows(spark):
    cols = "TransactionID long, TransactionDT long, card1 long, addr1 long, D1 long"
    a = spark.createDataFrame([(1, 0, 1, 7, 0)], cols)
    b = spark.createDataFrame([(2, 86400, 2, 7, 0)], cols)
    a, b = entity.build_uid(a), entity.build_uid(b)
    tr, te = graph.features_for_split(a, b, ["addr1"], {"addr1": ("addr1",)})
    assert tr.first().g_is_linked == 0 and te.first().g_is_linked == 1
    assert tr.where(F.col("g_component_size") != 1).count() == 0


@pytest.mark.parametrize("local", [0, 10**6])
def test_shape_of_a_graph_without_edges(spark, local):
    vertices, none = spark.range(3), spark.createDataFrame([], "src long, dst long")
    assert tuple(graph.describe_graph("g", vertices, none, local).first()) == ("g", 3, 0, 0.0, 1.0, 0, None, None, None)
