"""The permutation index against all pairs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import neighbours as nn


def brute(rows, every=20, nearest=20):
    ok = [(k, np.array(v, float)) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            near = sorted((-float(np.einsum("ij,j->i", c[None], v)[0]), k) for k, c in ok if k != q and len(c) == len(v))
            out += [(q, i + 1, k, -s) for i, (s, k) in enumerate(near[:nearest])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x", 2.0) for k, v in rows], "vec_id long, embedding array<double>, rep int, cell string, bound double").repartition(3)


def result(df):
    return sorted(map(tuple, df.collect()))


def recall(got, want):
    found = {(q, k) for q, _, k, _ in got}
    return np.mean([(q, k) in found for q, _, k, _ in want])


def test_awkward_vectors(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.integers(-3, 4, 3).astype(float).tolist()) for i in range(30)]  # ties are many
    rows += [(40, None), (60, []), (80, [0.0, 0.0, 0.0]), (100, [1.0, None, 2.0]), (120, [1.0, float("nan"), 0.0]), (140, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    rows += [(200, [1.0, 2.0]), (201, [3.0, -1.0]), (220, [5.0]), (240, [1e-300, 0.0, 2e-300]), (41, rows[3][1]), (42, rows[3][1])]
    assert result(nn.nearest_neighbours(table(spark, rows))) == brute(rows)
    assert nn.nearest_neighbours(table(spark, rows).limit(0)).count() == 0
    assert nn.nearest_neighbours(table(spark, rows).where("vec_id = 60")).count() == 0
    with pytest.raises(ValueError):
        nn.nearest_neighbours(table(spark, rows).withColumnRenamed("vec_id", "rank"), key="rank")


def test_copies_and_repeated_rows(spark):
    r = np.random.default_rng(1)
    hot = r.normal(size=4).tolist()
    rows = [(i, hot if i % 3 else r.normal(size=4).tolist()) for i in range(300)]
    assert result(nn.nearest_neighbours(table(spark, rows))) == brute(rows)
    twice = result(nn.nearest_neighbours(table(spark, rows[:40] + rows[:1])))
    assert [x[:3] for x in twice if x[0] == 0] == sorted([x[:3] for x in brute(rows[:40]) if x[0] == 0] * 2)


@pytest.mark.parametrize("kind", ["even", "groups", "norms"])
def test_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(nn, "PART", 256)
    monkeypatch.setattr(nn, "SAMPLE", 1024)
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 24))
    if kind == "groups":
        x = r.normal(size=(12, 24))[r.integers(0, 12, 3000) * (r.random(3000) < 0.6)] + 0.05 * x
    if kind == "norms":
        x *= r.lognormal(0, 0.3, (3000, 1))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got, want = result(nn.nearest_neighbours(table(spark, rows), every=40)), brute(rows, 40)
    assert len(got) == len(want) and recall(got, want) > 0.92
    exact = {(i, j): None for i, _, j, _ in got}
    assert all(s == float(np.einsum("ij,j->i", x[j][None], x[i])[0]) for i, _, j, s in got) and len(exact) == len(got)


def test_a_query_that_meets_too_few_is_compared_with_all(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(400, 8)).tolist())]
    plain = nn.fit

    def narrow(*a, **k):
        index = plain(*a, **k)
        index.asked, index.limit, index.sample = 1, 0, index.sample[:1]
        return index

    monkeypatch.setattr(nn, "fit", narrow)
    assert result(nn.nearest_neighbours(table(spark, rows))) == brute(rows)


def test_footrule():
    r = np.random.default_rng(4)
    orders = np.stack([r.permutation(40) for _ in range(50)])
    there = nn.places_of(orders, 40, 12)
    for q in orders[:10]:
        want = [sum(abs((list(q[:12]).index(p) if p in q[:12] else 12) - (list(o[:12]).index(p) if p in o[:12] else 12)) for p in range(40)) for o in orders]
        assert nn.footrule(there, q, 12).tolist() == want


def test_sql_on_few_rows(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted((q, k, round(s, 9)) for q, _, k, s in con.sql(nn.oracle()).fetchall())
    got = nn.nearest_neighbours(spark.read.parquet(f"{sf}/embeddings.parquet")).select("query_id", "vec_id", F.round("score", 9))
    assert len(set(map(tuple, got.collect())) & set(want)) > 0.98 * len(want)
