import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics, resample, split
from riskloom.operators.ranges import parts, quantiles, quantiles_of

ROWS = [(1, .90, 1000.0), (1, .30, 2000.0), (0, .80, 5000.0), (0, .20, 300.0), (0, .10, 400.0), (1, .95, 1500.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "y int, s double, amount_inr double")


def test_costs_worked_by_hand(rows):
    r = metrics.at_thresholds(rows, [0.5]).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2)
    assert (r.caught_inr, r.missed_inr, r.insult_cost_inr, r.total_cost_inr) == (2500.0, 3200.0, 600.0, 3800.0)
    assert abs(r.insult_rate - 1 / 3) < 1e-5


def test_threshold_is_inclusive(rows):
    assert metrics.at_thresholds(rows, [0.9]).first().tp == 2


def scores(n, seed):
    r = random.Random(seed)
    return [(int(r.random() < .2), round(r.random(), 1 + seed % 2), r.random() * 100) for _ in range(n)]


def ap(rows, weighted=False):
    out, tp, seen, total = 0.0, 0.0, 0.0, sum(y * (w if weighted else 1) for y, _, w in rows)
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        gain = sum(y * (w if weighted else 1) for y, s, w in rows if s == t)
        tp, seen = tp + gain, seen + sum(w if weighted else 1 for _, s, w in rows if s == t)
        out += gain / total * tp / seen
    return out


@pytest.mark.parametrize("seed", range(3))
def test_average_precision_and_auc_with_ties(spark, seed):
    data = scores(200, seed)
    df = spark.createDataFrame(data, "y int, s double, w double")
    assert abs(metrics.average_precision(df).first().ap - ap(data)) < 1e-9
    assert abs(metrics.average_precision(df, weight="w").first().ap - ap(data, True)) < 1e-9
    pos, neg = [s for y, s, _ in data if y], [s for y, s, _ in data if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(metrics.roc_auc(df).first().auc - auc) < 1e-9


def test_negative_weights_are_refused(spark):
    with pytest.raises(Exception, match="negative"):
        metrics.average_precision(spark.createDataFrame([(1, .5, -1.0)], "y int, s double, w double"), weight="w").first()


def test_no_positives_is_null(spark):
    assert metrics.average_precision(spark.createDataFrame([(0, .5)], "y int, s double")).first().ap is None


def test_sweep_equals_single_points(spark):
    df = spark.createDataFrame(scores(300, 5), "y int, s double, amount_inr double")
    for r in metrics.threshold_sweep(df, extra=(0.5,)).collect()[::9]:
        assert metrics.at_thresholds(df, [r.threshold]).first() == r


def test_quantiles_are_exact(spark):
    r = random.Random(2)
    for data in ([r.random() ** 9 for _ in range(501)], [1.0] * 40 + [2.0], [3.0], [r.randrange(3) / 7 for _ in range(100)] + [None, float("nan")]):
        df = spark.createDataFrame([(x, i % 2) for i, x in enumerate(data)], "x double, side int").repartition(5)
        levels = metrics.linspace(0, 1, 13)
        clean = [x for x in data if x is not None and x == x]
        assert np.allclose(quantiles_of(df, "x", levels), np.quantile(clean, levels), rtol=0, atol=1e-12)
        for (side,), got in quantiles(df, "x", levels, ("side",)).items():
            own = [x for i, x in enumerate(data) if i % 2 == side and x is not None and x == x]
            assert np.allclose(got, np.quantile(own, levels), rtol=0, atol=1e-12)
    assert quantiles_of(df.limit(0), "x", [0.5]) == []


def test_candidates_are_scores_not_rounded_ones(spark):
    """A threshold rounded down would let in scores that the exact one does not, rounded up lose its own."""
    df = spark.createDataFrame([(i % 2, 0.123456789 + i * 1e-9, 1.0) for i in range(50)], "y int, s double, amount_inr double")
    found = metrics.candidates(metrics.by_score(df), 0.0, 1.0, 50)
    assert len(found) == 50 and np.allclose(found, [0.123456789 + i * 1e-9 for i in range(50)], rtol=0, atol=1e-15)


def test_no_part_holds_most_bunched_scores(spark):
    """Nine in ten scores lie below 0.001."""
    r = random.Random(7)
    df = spark.createDataFrame([(r.random() ** 40,) for _ in range(4000)], "s double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [x["count"] for x in parts(df, ["s"]).groupBy("_part").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and max(sizes) < 2000


def test_evaluation_in_one_pass(spark):
    df = spark.createDataFrame(scores(400, 3), "y int, s double, amount_inr double")
    report, points, curve = metrics.evaluate("m", df)
    r, p = report.first(), {x.point: x for x in points.collect()}
    assert abs(r.auc_pr - metrics.average_precision(df).first().ap) < 1e-6 and abs(r.auc_roc - metrics.roc_auc(df).first().auc) < 1e-6
    assert (r.cost_threshold, r.cap_total_inr) == (p["cost"].threshold, p["cap"].total_cost_inr)
    assert p["cost"].total_cost_inr == metrics.threshold_by_cost(df).first().total_cost_inr <= p["cap"].total_cost_inr
    assert sorted(map(tuple, curve.fillna(-1).collect())) == sorted(map(tuple, metrics.pr_curve(df).fillna(-1).collect()))
    assert metrics.summary_lines(report, points).count() == 3


def test_lines_round_as_printf_does(spark):
    report = spark.createDataFrame([("m", 0.03125, 1.25, 0.90625)], "name string, auc_pr double, lift double, auc_roc double")
    assert metrics.report_line(report).first().line == "m: AUC-PR 0.0312 (1.2x prevalence), AUC-ROC 0.9062"
    point = spark.createDataFrame([("cost", 0.5, 0.53125, 0.21875, 3, 4, 5, 0.000625, 2.125, 0.375, 1e13 + 0.015625)],
                                  "point string, threshold double, precision double, recall double, tp long, fn long, fp long, insult_rate double, missed_inr double, insult_cost_inr double, total_cost_inr double")
    assert metrics.point_lines(point).first().line == (
        "cost at 0.5000: precision 0.5312, recall 0.2188, 3 caught and 4 missed, 5 legitimate declined (0.062%), Rs 2.12 missed, Rs 0.38 insult cost, Rs 10000000000000.02 in all")


def test_worst_psi_of_equals_is_the_first_by_name(spark):
    worst = lambda rows: tuple(metrics.worst_psi(spark.createDataFrame(rows, "feature string, psi double")).first())
    assert worst([("b", 0.5), ("a", 0.5), ("c", None), ("d", 0.1)]) == ("a", 0.5)
    assert worst([("b", None), ("a", None)]) == ("a", None)


def test_drift_report_and_trend(spark):
    r = random.Random(4)
    rows = [(i, i * 100, int(r.random() < .2), r.random(), r.random() + (i > 300)) for i in range(600)]
    rows = [(i, t, y, min(1.0, s + (.6 * y if i < 300 else 0)), x) for i, t, y, s, x in rows]
    df = spark.createDataFrame(rows, "id long, TransactionDT long, y int, s double, x double")
    got = {w.window: w for w in metrics.drift_report(df, df.where("id < 100"), ["x"], n=3, draws=60).collect()}
    assert len(got) == 3 and got[0].auc_roc > got[2].auc_roc and got[2].worst_feature == "x" and got[2].worst_psi > got[0].worst_psi
    assert all(w.auc_pr_low <= w.auc_pr <= w.auc_pr_high and w.auc_roc_low <= w.auc_roc <= w.auc_roc_high for w in got.values())
    windows = metrics.drift_report(df, df, ["x"], n=3, draws=60)
    assert metrics.trend(windows, "auc_roc").first().distinguishable
    same = spark.createDataFrame([(0, .1, .3), (1, .2, .4)], "window int, m_low double, m_high double")
    assert not metrics.trend(same, "m").first().distinguishable and not metrics.trend(same.limit(1), "m").first().distinguishable


def test_intervals_skip_draws_of_one_class(spark):
    df = spark.createDataFrame([(i, int(i == 0), i / 10) for i in range(8)], "id long, y int, s double")
    got = resample.metric_interval(df, "id", "auc", 50).first()
    assert 0 < got.draws < 50 and got.low is not None


def test_calibration_of_perfect_scores(spark):
    df = spark.createDataFrame([(i % 2, float(i % 2)) for i in range(40)], "y int, s double")
    r = metrics.calibration_report("m", df).first()
    assert (r.brier, r.ece) == (0.0, 0.0)


def test_psi(spark):
    a = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    assert metrics.psi(a, a, "x").first().psi == 0
    assert metrics.psi(a, a.select((F.col("x") + 60).alias("x")), "x").first().psi > 0.25
    assert metrics.psi(a, a.limit(0), "x").first().psi is None
    flat = a.select(F.lit(1.0).alias("x"))
    assert metrics.psi(flat, flat, "x").first().psi == 0


def test_split_leaks_nothing(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, r.randrange(10), 0) for i in range(100)], "TransactionID long, TransactionDT long, isFraud int")
    a, b = split.temporal_split(df)
    assert a.agg(F.max("TransactionDT")).first()[0] < b.agg(F.min("TransactionDT")).first()[0]
    assert a.count() + b.count() == 100
    with pytest.raises(ValueError):
        split.temporal_split(df, 1.0)
    with pytest.raises(ValueError):
        split.temporal_split(df.where("TransactionDT = 3"))


def test_time_features_floor_before_the_origin(spark):
    r = split.add_time_features(spark.createDataFrame([(-1,)], "TransactionDT long")).first()
    assert (r.tx_hour, r.tx_dayofweek, r.tx_day) == (23, 6, -1)


def test_poisson_weights(spark):
    w = [r[0] for r in spark.range(4000).select(resample.poisson(F.col("id"), F.lit(3))).collect()]
    assert abs(np.mean(w) - 1) < 0.06 and abs(np.var(w) - 1) < 0.12


def test_permutation_keeps_the_labels(spark):
    df = spark.createDataFrame([(f"u{i}", int(i < 7)) for i in range(40)], "uid string, fraud int")
    for r in resample.permuted(df, "uid", "fraud", 5).groupBy("b").agg(F.sum("fraud").alias("f"), F.count("*").alias("n")).collect():
        assert (r.f, r.n) == (7, 40)
    import hashlib
    for b in (1, 4):
        order = sorted((hashlib.md5(f"u{i}:{b}".encode()).hexdigest(), f"u{i}") for i in range(40))
        got = {r.uid for r in resample.permuted(df, "uid", "fraud", 5).where(f"b = {b} and fraud = 1").collect()}
        assert got == {u for _, u in order[:7]}
    assert resample.permuted(df.withColumn("fraud", F.lit(0)), "uid", "fraud", 2).agg(F.sum("fraud")).first()[0] == 0


def test_planted_rings_stand_out(spark):
    rows = [(f"p{c}.{i}", c, int(c < 15)) for c in range(200) for i in range(3)]
    z = resample.ring_test(spark.createDataFrame(rows, "uid string, component long, fraud int"), draws=30).first()
    assert z.all_fraud == 15 and z.z > 5


def test_effective_sample_size(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "weight double")
    assert abs(metrics.effective_sample_size(df).first().ess - 16 / 6) < 1e-3
    assert metrics.effective_sample_size(df.limit(0)).first().ess == 0


def test_value_detection_rate_without_fraud(spark):
    assert metrics.value_detection_rate(spark.createDataFrame([(0, .5, 1.0)], "y int, s double, amount_inr double"), .5).first().vdr == 0
    assert math.isclose(metrics.linspace(0.5, 0.9999, 200)[-1], 0.9999)
