"""State on shared storage, dense numbers, and features under several hub caps."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import caps, entity, graph, ids, live
from riskloom.operators.random_graphs import random_edges
from riskloom.scratch import Scratch
from riskloom.streaming.buckets import FOLDERS, Store
from riskloom.streaming.core_tables import IncrementalCore, maintained_cores
from riskloom.streaming.decision_log import DecisionLog
from riskloom.streaming.live_index import LiveIndex


def test_store_keeps_what_was_committed(spark, tmp_path):
    path, schema = f"file://{tmp_path}/s", {"t": "k string, v long"}
    df = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    a = Store(spark, path, schema, 4)
    a.append("t", df(("x", 1), ("y", 2)))
    assert Store(spark, path, schema).read("t").count() == 0 and a.commit() == 0
    b = Store(spark, path, schema, 99)
    assert b.buckets == 4 and sorted(map(tuple, b.read("t").collect())) == [("x", 1), ("y", 2)]
    own = b.buckets_of(df(("x", 0)))
    b.replace("t", b.read("t", own).where("k <> 'x'").union(df(("x", 9))), own)
    assert sorted(map(tuple, a.read("t").collect())) == [("x", 1), ("y", 2)]
    b.commit(7)
    c = Store(spark, path, schema)
    assert c.number == 7 and sorted(map(tuple, c.read("t").collect())) == [("x", 9), ("y", 2)]
    for i in range(FOLDERS + 2):
        c.append("t", df(("x", i)))
        c.commit()
    assert len(c.at["t"][str(own[0])]) <= FOLDERS and c.read("t", own).where("k = 'x'").count() == FOLDERS + 3
    c.replace("t", df(), own)
    c.commit()
    assert c.read("t", own).count() == 0


def test_decisions_count_once_and_rise(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    df = lambda *r: spark.createDataFrame(list(r), "case_id string, decision string, reviewer string, at long").repartition(3)
    log = DecisionLog(spark, path)
    assert log.record(df(("a", "approved", " ", 2), ("b", "rejected", "me", 1)), ["at"], 0) == 2
    assert log.record(df(("a", "approved", "x", 9)), ["at"], 0) == 0
    other = DecisionLog(spark, path)
    assert other.record(df(("a", "rejected", "you", 1), ("c", "approved", None, 3)), ["at"], 1) == 2
    with pytest.raises(RuntimeError):
        log.record(df(("a", "approved", "late", 1)), ["at"], 1)
    for bad in (("", "approved", "x", 1), (None, "approved", "x", 1), ("a", "maybe", "x", 1), ("a", None, "x", 1)):
        with pytest.raises(Exception, match="required"):
            other.record(df(bad), ["at"])
    last = DecisionLog(spark, path)
    got = sorted((r.id, r.case_id, r.decision, r.reviewer) for r in last.rows().collect())
    assert got == [(1, "b", "rejected", "me"), (2, "a", "approved", "unattributed"), (3, "a", "rejected", "you"), (4, "c", "approved", "unattributed")]
    assert {r.id for r in last.rows(spark.createDataFrame([("a",), ("z",)], "case_id string")).collect()} == {2, 3}


def test_live_index_equals_the_whole(spark, tmp_path):
    """After every batch, one that comes again included, its payers have the rows that all events so far give them."""
    r = random.Random(5)
    rows = [(f"p{r.randrange(40)}", f"c{r.randrange(30)}" if r.random() < 0.6 else None, None, f"t{r.randrange(60)}" if r.random() < 0.4 else None, "v|x" if r.random() < 0.05 else None) for _ in range(120)] + [(None, "c1", None, None, None)]
    schema = "payer_key string, card_fingerprint string, email_domain string, contact string, vpa string"
    path, plain = f"file://{tmp_path}/live", lambda df: {x.payer_key: tuple(x) for x in df.collect()}
    for n, (i, j) in enumerate(((0, 60), (60, 62), (62, 121))):
        batch = spark.createDataFrame(rows[i:j], schema)
        want = {k: v for k, v in plain(live.analyse_all(spark.createDataFrame(rows[:j], schema))).items() if k in {x[0] for x in rows[i:j]}}
        index = LiveIndex(spark, path, buckets=16)
        assert plain(index.take(batch, n)) == want
        if n == 1:
            assert plain(LiveIndex(spark, path).take(batch, n)) == want
    assert index.total() == len({x[0] for x in rows} - {None}) and index.take(batch.where("payer_key is null")) is None


def test_a_batch_reads_the_buckets_it_touches(spark, monkeypatch):
    index = LiveIndex(spark, buckets=512)
    df = lambda rows: spark.createDataFrame(rows, "payer_key string, card_fingerprint string, email_domain string, contact string, vpa string")
    index.take(df([(f"p{i}", f"c{i // 2}", None, None, None) for i in range(600)]))
    reads, read = [], index.store.read
    monkeypatch.setattr(index.store, "read", lambda name, own=None: (reads.append(512 if own is None else len(own)), read(name, own))[1])
    got = index.take(df([("new", "c7", None, None, None)])).first()
    assert got.linked_payers == ["p14", "p15"] and max(reads) <= 3


@pytest.mark.parametrize("parts", [1, 7])
def test_dense_numbers(spark, parts):
    r = random.Random(2)
    names = [f"u{r.randrange(10**9)}" for _ in range(3000)]
    got = ids.numbered(spark.createDataFrame([(n,) for n in names], "uid string").repartition(parts), ["uid"], start=5).collect()
    assert [x.uid for x in sorted(got, key=lambda x: x.id)] == sorted(names) and sorted(x.id for x in got) == list(range(5, 3005))
    assert ids.numbered(spark.createDataFrame([], "uid string"), ["uid"]).count() == 0
    assert [tuple(x) for x in ids.entity_index(spark.createDataFrame([("b",), ("a",)], "uid string"), spark.range(3)).orderBy("id").collect()] == [("a", 0, 2, 3), ("b", 1, 2, 3)]


@pytest.mark.parametrize("local", [3, 10**6])
def test_caps_equal_separate_graphs(spark, local):
    r = random.Random(7)
    links = sorted({(f"u{r.randrange(60):02}", k, str(int(r.paretovariate(0.7)) % 25)) for k in ("x", "y") for _ in range(90)})
    s = Scratch(spark, "test")
    df = s.table(spark.createDataFrame(links, "uid string, key_name string, value string"), "links")
    entities = s.table(spark.createDataFrame([(f"u{i:02}",) for i in range(62)], "uid string"), "entities")
    got = caps.features_by_cap(entities, df, (2, 4, 30), local)
    found = {}
    for x in got.collect():
        found.setdefault(x.cap, set()).add(tuple(x)[1:])
    for c in (2, 4, 30):
        assert found[c] == set(map(tuple, graph.graph_features(entities, entity.suppressed_edges(df, c)).select(got.columns[1:]).collect()))
    with pytest.raises(ValueError):
        caps.features_by_cap(entities, df, (4, 2))
    none = caps.features_by_cap(entities, df.limit(0), (2, 5))
    assert none.count() == 124 and none.where("g_is_linked = 1 or g_component <> uid").isEmpty()


def test_cap_report(spark):
    links = spark.createDataFrame([("a", "k", "1"), ("b", "k", "1"), ("c", "k", "2"), ("d", "k", "2"), ("e", "k", "2")], "uid string, key_name string, value string")
    entities = spark.createDataFrame([(u,) for u in "abcdef"], "uid string")
    rows = spark.createDataFrame([("a", 1, 0.9, 0.1), ("b", 0, 0.5, 0.5), ("c", 1, 0.2, 0.7), ("f", 0, 0.1, 0.1), (None, 1, 0.5, 0.5)], "uid string, y int, s double, v double")
    got = {r.cap: r for r in caps.cap_report(caps.features_by_cap(entities, links, (2, 3)), rows, (2, 3)).collect()}
    assert (got[2].edges, got[2].linked_entities, got[2].components, got[2].largest_component, got[2].row_coverage, got[2].linked_rows, got[2].linked_fraud, got[2].base_ap) == (2, 2, 1, 2, 0.4, 2, 1, 1.0)
    assert (got[3].edges, got[3].linked_entities, got[3].components, got[3].row_coverage, got[3].linked_fraud) == (5, 5, 2, 0.6, 2) and abs(got[3].variant_ap - (0.5 + 0.5 * 2 / 3)) < 1e-6
    bare = caps.cap_report(caps.features_by_cap(entities, links.limit(0), (2, 3)), rows, (2, 3)).collect()
    assert all(r.linked_rows == 0 and r.base_ap is None for r in bare)


def test_edges_counted_by_cap(spark):
    links = spark.createDataFrame([(f"u{i}", "k", str(i % 3)) for i in range(10)], "uid string, key_name string, value string")
    assert caps.levelled_edges(links, (3, 4)).groupBy("level").count().orderBy("level").select(F.col("count")).collect() == [(6,), (4,)]


@pytest.mark.parametrize("nodes,edges", [(2, 1), (3, 3), (50, 735), (50, 1225), (1000, 5000), (7, 0), (3_000_000_000, 200)])
def test_random_edges_are_distinct_and_as_many_as_asked(spark, nodes, edges):
    got = [tuple(r) for r in random_edges(spark, nodes, edges, 3).collect()]
    assert len(got) == len(set(got)) == edges and all(0 <= a < b < nodes for a, b in got)
    assert got == [tuple(r) for r in random_edges(spark, nodes, edges, 3).collect()]
    if edges == 5000:
        assert set(got) != {tuple(r) for r in random_edges(spark, nodes, edges, 4).collect()} and len({x for p in got for x in p}) > 990
    with pytest.raises(ValueError):
        random_edges(spark, 4, 7)


def test_a_stream_keeps_cores(spark, tmp_path):
    base = f"file://{tmp_path}"
    (tmp_path / "in").mkdir()
    changes = {}
    for i, edges in enumerate(([("a", "b"), ("b", "c"), ("a", "a")], [("a", "c"), ("c", "d"), ("a", "b")])):
        spark.createDataFrame(edges, "src string, dst string").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("src string, dst string").parquet(f"{base}/in")
        maintained_cores(stream, f"{base}/state", f"{base}/out", f"{base}/c", 4).awaitTermination(120)
        changes[i] = {r.node: r.core for r in spark.read.parquet(f"{base}/out/batch={i}").collect()}
    assert changes == {0: {"a": 1, "b": 1, "c": 1}, 1: {"a": 2, "b": 2, "c": 2, "d": 1}}
    kept = IncrementalCore(spark, f"{base}/state")
    assert kept.matches_batch() and kept.store.number == 1
