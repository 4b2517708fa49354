"""The registered resampling queries draw as often as the original workload."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from riskloom.operators import resample
from riskloom.operators.metrics import average_precision


@pytest.mark.parametrize("name", ["bootstrap_vdr_delta_hash", "bootstrap_exact"])
def test_bootstraps_take_400_draws(spark, sf, name):
    assert driver.queries()[name](spark, sf).first().draws == 400


def test_permutation_queries_take_200(spark, sf, monkeypatch):
    seen = []
    permuted = resample.permuted_bits
    monkeypatch.setattr(resample, "permuted_bits", lambda df, key, label, draws, *more: seen.append(draws) or permuted(df, key, label, draws, *more))
    for name in ("ring_permutation_hash", "homophily_permutation_hash"):
        driver.queries()[name](spark, sf)
    assert seen == [200, 200]


def drawn(df, key, draws):
    """A row for every row and draw."""
    return df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", resample.poisson(F.col(key), F.col("b")))


def exploded_aps(df, key, draws, scores):
    """A row for every row, draw and score."""
    rows = drawn(df.select(key, "y", *scores), key, draws)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(c).alias("x")) for m, c in enumerate(scores)])).alias("o")
    return average_precision(rows.select("b", "y", "w", each).select("b", "y", "w", "o.m", "o.x"), "y", "x", "w", ("b", "m"))


@pytest.mark.parametrize("size", [50, 300, resample.RANGE])
def test_draws_without_a_row_each(spark, size):
    r = random.Random(1)
    # long keys, negative and missing ones, missing labels and scores, one score of many rows
    rows = [(None if i % 50 == 0 else "k" * (i % 70) + str(i - 9), r.choice([0, 0, 0, 1, None]), r.choice([round(r.random(), 1), None, 0.3]), r.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, y int, s double, v double").repartition(3)
    told = lambda d: sorted((x.m, x.b, round(x.ap, 10)) for x in d.collect())
    wanted = told(exploded_aps(df, "id", 30, ["s", "v"]))
    assert told(resample.draw_aps(df, "id", 30, ["s", "v"], size=size)) == wanted


def plain_metrics(rows):
    """(ap, auc) of rows (y, s, weight), one score at a time."""
    pos, neg = sum(w * y for y, _, w in rows), sum(w * (1 - y) for y, _, w in rows)
    ap = auc = above = seen = 0.0
    for x in sorted({s for _, s, _ in rows}, reverse=True):
        p, n = sum(w * y for y, s, w in rows if s == x), sum(w * (1 - y) for y, s, w in rows if s == x)
        above, seen = above + p, seen + p + n
        ap += p * above / seen if seen else 0
        auc += n * (above - p / 2)
    return ap / pos if pos else None, auc / pos / neg if pos and neg else None


@pytest.mark.parametrize("size", [40, resample.RANGE])
def test_weighted_metrics_by_group(spark, size):
    """Real weights, zeros among them, groups, a null group and a group of one class."""
    r = random.Random(4)
    rows = [(i, r.choice([0, 1, 2, None]), r.choice([0, 0, 1]), r.choice([round(r.random(), 1), r.random()]), r.choice([0.0, r.random() * 9, None])) for i in range(400)]
    rows = [(i, g, 0 if g == 2 else y, s, v) for i, g, y, s, v in rows]
    df = spark.createDataFrame(rows, "id long, g int, y int, s double, v double").repartition(3)
    weight = {(x.id, x.b): x.w for x in drawn(df.select("id"), "id", 7).collect()}
    want = {(g, b): plain_metrics([(y, s, v * weight[i, b]) for i, h, y, s, v in rows if h == g and v is not None]) for g in (0, 1, 2, None) for b in range(1, 8)}
    got = {(x.g, x.b): (x.ap, x.auc) for x in resample.draw_metrics(df, "id", 7, ["s"], weight="v", by=("g",), size=size).collect()}
    near = lambda a, b: a is b or a is not None and b is not None and abs(a - b) < 1e-12
    assert got.keys() == want.keys() and all(near(a, b) for k in got for a, b in zip(got[k], want[k]))
    with pytest.raises(Exception, match="negative"):
        resample.draw_metrics(df.withColumn("v", F.lit(-1.0)), "id", 2, ["s"], weight="v").collect()


def test_few_scores_are_added_up_in_tasks(spark, monkeypatch):
    """As by carried weights, in groups and under two weightings, without a table of weighed rows."""
    r = random.Random(6)
    rows = [(None if i == 9 else i, r.choice([0, 1, None]), r.choice([0, 0, 1, None]), r.choice([0.1, 0.5, None, float("nan")]), r.choice([0.0, -0.0, 1.0]), r.choice([0.0, r.random() * 9])) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, g int, y int, s double, v double, amount double").repartition(3)

    def told(weight, by, classes):
        found = resample.draw_metrics(df, "id", 7, ["s", "v"], weight=weight, by=by, classes=classes)
        return {tuple(x[c] for c in found.columns[:-2]): (x.ap, x.auc) for x in found.collect()}

    carried = {(str(w), by): told(w, by, 0) for w in (None, [None, "amount"]) for by in ((), ("g",))}
    monkeypatch.setattr(resample, "with_weights", None)
    for w, by in ((None, ()), (None, ("g",)), ([None, "amount"], ()), ([None, "amount"], ("g",))):
        got, want = told(w, by, resample.CLASSES), carried[str(w), by]
        assert got.keys() == want.keys() and len(got) == 14 * (2 if w else 1) * (3 if by else 1)
        assert all(abs(a - b) < 1e-12 for k in got for a, b in zip(got[k], want[k]))


def test_sums_of_draws(spark):
    df = spark.createDataFrame([(None if i == 5 else i, float(i % 7), None if i % 3 else 2.0) for i in range(200)], "id long, a double, c double").repartition(4)
    want = {x.b: (x.n, x.a, x.c) for x in drawn(df, "id", 9).groupBy("b").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("a")).alias("a"), F.sum(F.col("w") * F.col("c")).alias("c")).collect()}
    assert {x.b: (x.n, x.a, x.c) for x in resample.draw_sums(df, "id", 9, {"a": F.col("a"), "c": F.col("c")}).collect()} == want


def test_bits_are_the_first_by_hash(spark):
    """More draws than one number holds, against a sort of all keys; few keys and many."""
    import hashlib

    for n, ones in ((300, 40), (3, 2), (9, 0), (9, 9)):
        df = spark.createDataFrame([(f"u{i}", int(i < ones), i % 5) for i in range(n)], "uid string, fraud int, component long")
        got = {x.uid: (x.component, [w % (1 << 64) for w in x.bits]) for x in resample.permuted_bits(df, "uid", "fraud", 70, ("component",)).collect()}
        for b in range(1, 71):
            first = {f"u{i}" for _, i in sorted((hashlib.md5(f"u{i}:{b}".encode()).hexdigest(), i) for i in range(n))[:ones]}
            assert {u for u, (_, w) in got.items() if w[(b - 1) // 64] >> (b - 1) % 64 & 1} == first
        assert all(c == int(u[1:]) % 5 for u, (c, _) in got.items())


def test_exact_draws_of_counts_are_those_of_rows(spark, monkeypatch):
    r = random.Random(2)
    rows = [(r.randrange(2), r.randrange(5) / 4, r.randrange(3) / 2) for _ in range(500)]
    df = spark.createDataFrame(rows, "y int, s double, v double")
    monkeypatch.setattr(resample, "INDEXES", 64)
    mean = lambda y, s: float((y * s).mean())
    keyed = df.select("*", F.xxhash64("s", "v", "y").alias("k")).toPandas().sort_values("k")
    rng, deltas = np.random.default_rng(0), []
    for _ in range(30):
        i = rng.integers(0, 500, 500)
        y, a, b = (keyed[c].to_numpy()[i] for c in ("y", "s", "v"))
        deltas.append(mean(y, b) - mean(y, a))
    wanted = (30, *(round(float(x), 6) for x in (np.mean(deltas), np.quantile(deltas, 0.025), np.quantile(deltas, 0.975))))
    assert tuple(resample.exact_bootstrap(df, mean, draws=30).first())[:4] == wanted
    counted = lambda y, s, n: float((y * s * n).sum() / n.sum())
    assert tuple(resample.exact_bootstrap(df, counted, draws=30, counted=True).first())[:4] == wanted
