import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics, model, values

INPUTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    data = []
    for i in range(1200):
        a, b = r.random(), r.random()
        data.append((i, i * 60, int(r.random() < (0.6 if a > 0.7 and b > 0.4 else 0.03)), a if r.random() > 0.1 else None, b, r.random(), 10.0 + b))
    return spark.createDataFrame(data, "TransactionID long, TransactionDT long, isFraud int, a double, b double, c double, TransactionAmt double")


@pytest.fixture(scope="module")
def trained(rows):
    return model.train(rows.where("TransactionDT < 50000"), INPUTS, maxIter=6, maxDepth=3)


def test_model_ranks_and_survives_saving(spark, rows, trained, tmp_path):
    assert 1 <= trained.rounds <= 6 and trained.validation_ap > 0.2 and {x for x, _ in model.importances(trained)[:2]} == {"a", "b"}
    late = rows.where("TransactionDT >= 50000")
    got = model.predict(trained, late).join(late, "TransactionID").groupBy((F.coalesce("a", F.lit(0.0)) > 0.7) & (F.col("b") > 0.4)).agg(F.avg("score").alias("s")).collect()
    by = {r[0]: r.s for r in got}
    assert by[True] > 2 * by[False]
    trained.save(f"file://{tmp_path}/m")
    again = model.Trained.load(spark, f"file://{tmp_path}/m")
    assert (again.rounds, again.features) == (trained.rounds, INPUTS)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(model.predict(again, late)) == key(model.predict(trained, late))


def test_fewer_trees_are_a_prefix(rows, trained):
    all_trees = trained.pipeline.stages[-1].getNumTrees
    whole = model.Trained(trained.pipeline, INPUTS, all_trees, 0.0)
    sums = model.by_rounds(trained.pipeline, model.prepared(rows, INPUTS)).select("TransactionID", F.round(1 / (1 + F.exp(-2 * F.col("sums")[all_trees - 1])), 6).alias("p"))
    both = model.predict(whole, rows).join(sums, "TransactionID")
    assert both.where("abs(score - p) > 2e-6").count() == 0 and both.count() == 1200


def test_payments_without_inputs_or_model(spark, trained):
    df = spark.createDataFrame([(1, 0.9), (2, None)], "id long, x double")
    got = {r.id: r for r in model.score_payments(trained, df, F.struct(F.col("x").alias("a"), F.lit(1).alias("unknown"))).collect()}
    assert (got[1].features_present, got[1].features_total, got[2].features_present) == (1, 3, 0) and 0 < got[2].score < 1 and abs(got[1].coverage_pct - 100 / 3) < 1e-9
    none = model.score_payments(None, df, F.struct("x")).first()
    assert none.score is None and not none.available


def test_variants_are_fitted_once_and_compared(spark, rows, tmp_path, monkeypatch):
    early, late = rows.where("TransactionDT < 50000"), rows.where("TransactionDT >= 50000")
    sets, cache = {"plain": ["c"], "full": INPUTS}, f"file://{tmp_path}/scores"
    scores = model.variants(early, late, sets, cache, maxIter=4, maxDepth=3)
    monkeypatch.setattr(model, "train", lambda *a, **k: pytest.fail("fitted again"))
    assert model.variants(early, late, sets, cache).count() == 2 * late.count()
    got = {r.name: r for r in model.compare(scores, late, "plain", draws=60).collect()}
    assert got["plain"].delta is None and got["full"].auc_pr > got["plain"].auc_pr and got["full"].low <= got["full"].delta <= got["full"].high and got["full"].verdict == "better"


def test_variants_are_weighed_once(spark, monkeypatch):
    """And as in pairs, also where a variant lacks rows."""
    late = spark.createDataFrame([(i, int(i % 3 == 0), 10.0) for i in range(200)], "TransactionID long, isFraud int, TransactionAmt double")
    scores = [(v, i, (i * k % 97) / 97 + (i % 3 == 0) * w) for v, k, w in (("plain", 31, 0.1), ("a", 57, 0.2), ("b", 83, 0.0)) for i in range(200)]
    weighed, draw_aps = [], model.draw_aps
    monkeypatch.setattr(model, "draw_aps", lambda df, key, draws, names: weighed.append(len(names)) or draw_aps(df, key, draws, names))
    whole = spark.createDataFrame(scores, "variant string, TransactionID long, score double")
    got = {r.name: r for r in model.compare(whole, late, "plain", draws=40).collect()}
    assert weighed == [3] and got["plain"].delta is None
    lacking = whole.where("variant <> 'b' or TransactionID > 0")
    some = {r.name: r for r in model.compare(lacking, late, "plain", draws=40).collect()}
    assert weighed == [3] and got["a"] == some["a"] and some["b"].delta != got["b"].delta


def test_variants_by_value(spark):
    """Against plain Python: a variant that finds the dear frauds is better by value, and thresholds keep the cap."""
    r = random.Random(3)
    late = [(i, int(i % 10 == 0), 1000.0 if i % 20 == 0 else 10.0) for i in range(2000)]
    high = {"plain": lambda y, a: 0.3 * y, "dear": lambda y, a: 0.9 * y * (a > 100) + 0.1 * y}
    scored = {n: [round(r.random() * 0.7 + f(y, a), 4) for _, y, a in late] for n, f in high.items()}
    scores = spark.createDataFrame([(n, i, s) for n, x in scored.items() for i, s in enumerate(x)], "variant string, TransactionID long, score double")
    rows = spark.createDataFrame(late, "TransactionID long, isFraud int, TransactionAmt double")
    got = {(x.name, x.measure): x for x in model.compare_by_value(scores, rows, "plain", draws=50).collect()}
    assert len(got) == 6 and all(got["plain", m].delta is None and got["plain", m].cap_more_inr == 0 for m in ("count", "value", "vdr"))
    for n, x in scored.items():
        t = got[n, "vdr"].cap_threshold
        caught, whole = (sum(a for (_, y, a), s in zip(late, x) if y and s >= least) for least in (t, -1))
        assert abs(got[n, "vdr"].observed - caught / whole) < 1e-6
        for m, w in (("count", lambda a: 1), ("value", lambda a: a)):  # average precision by its definition, ties at once
            ap = sum(y * w(a) * sum(v * w(b) for (_, v, b), u in zip(late, x) if u >= s) / sum(w(b) for (_, _, b), u in zip(late, x) if u >= s) for (_, y, a), s in zip(late, x) if y)
            assert abs(got[n, m].observed - ap / sum(y * w(a) for _, y, a in late)) < 1e-6
        assert got[n, "vdr"].cap_insult_rate <= 0.01 and abs(got[n, "count"].cap_insult_rate - sum(1 - y for (_, y, _), s in zip(late, x) if s >= t) / 1800) < 1e-6
    for m in ("value", "vdr"):
        x = got["dear", m]
        assert x.significant and x.corrected_low <= x.low <= x.delta <= x.high <= x.corrected_high and x.delta > 0
    assert got["dear", "vdr"].cap_more_inr < 0


def test_no_variants_by_value(spark):
    none = spark.createDataFrame([], "id long, y int, amount_inr double, s double, v double")
    assert values.compare_values(none, "id", {"s": "s", "v": "v"}, "s", draws=5).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, 0.2), (1, 1, 5.0, 0.4, None), (2, 0, 3.0, 0.1, 0.9), (None, 0, 3.0, 0.1, 0.1)], "id long, y int, amount_inr double, s double, v double")
    got = values.compare_values(odd.withColumns({"m": F.lit("clash"), "name": F.lit("clash")}), "id", {"s": "s", "v": "v"}, "s", draws=5).collect()
    assert len(got) == 6 and {x.observed for x in got if x.name == "s"} == {1.0}


def test_weighted_rows_train_another_model(spark, rows):
    early, late = rows.where("TransactionDT < 50000"), rows.where("TransactionDT >= 50000")
    weighed = metrics.cost_weights(early, "isFraud", "TransactionAmt")
    got = model.variants(weighed, late, {"plain": INPUTS, "cost": INPUTS}, weights={"cost": "weight"}, maxIter=4, maxDepth=3)
    assert got.groupBy("TransactionID").agg(F.count_distinct("score").alias("n")).where("n = 2").count() > 0.5 * late.count()


def test_training_spreads_rows_and_counts_them_before_the_rounds(rows, monkeypatch):
    written, parts, table, fit = {}, [], model.Scratch.table, model.Pipeline.fit

    def kept(self, df, name):
        found = table(self, df, name)
        written[name] = found
        return found

    monkeypatch.setattr(model.Scratch, "table", kept)
    monkeypatch.setattr(model.Pipeline, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or fit(self, df))
    monkeypatch.setattr(model, "PER_TASK", 60, raising=False)
    found = model.train(rows.where("TransactionDT < 50000"), ["c"], maxIter=3, maxDepth=2)
    late = written["rows"].where("_late")
    assert parts[0] == written["rows"].where("not _late").count() // 60 + 1
    assert written["rounds"].count() < late.count() == written["rounds"].agg(F.sum("n")).first()[0]
    plain = model.by_rounds(found.pipeline, late).select("label", F.posexplode("sums").alias("k", "m"))
    best = metrics.average_precision(plain, "label", "m", by=("k",)).orderBy(F.desc("ap"), "k").first()
    assert (found.rounds, found.validation_ap) == (best["k"] + 1, pytest.approx(best["ap"]))


def test_both_weightings_are_drawn_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, int(i % 5 == 0), i % 7 / 7, i % 3 / 3, float(i)) for i in range(300)], "id long, y int, s double, v double, amount_inr double")
    drawn, draw_aps = [], values.draw_aps
    monkeypatch.setattr(values, "draw_aps", lambda *a, **k: drawn.append(1) or draw_aps(*a, **k))
    got = {r.measure: r for r in values.compare_values(df, "id", {"s": "s", "v": "v"}, "s", 20).where("name = 'v'").collect()}
    monkeypatch.undo()
    for measure, weight in (("count", None), ("value", "amount_inr")):
        from riskloom.operators.resample import ap_delta

        wanted = ap_delta(df, "id", 20, weight=weight).first()
        assert (got[measure].delta, got[measure].low, got[measure].high) == pytest.approx((wanted.delta, wanted.low, wanted.high))
    assert len(drawn) == 1


def test_many_rows_are_counted_by_bins_before_training(spark, rows, monkeypatch):
    """Every row counts, few parts are trained on, and the model ranks as well as one of single rows."""
    fitted, fit = [], model.GBTClassifier._fit
    monkeypatch.setattr(model.GBTClassifier, "_fit", lambda self, df: fitted.append(df) or fit(self, df))
    monkeypatch.setattr(model, "COUNTED", 100, raising=False)
    monkeypatch.setattr(model, "PARTS", 200, raising=False)
    data = metrics.cost_weights(rows.where("TransactionDT < 50000").withColumns({c: F.round(c, 1) for c in INPUTS}), "isFraud", "TransactionAmt")
    early = data.where(F.col("TransactionDT") < model.cutoff(data, 0.8))
    late = rows.where("TransactionDT >= 50000").withColumns({c: F.round(c, 1) for c in INPUTS})
    for features, weight, total in ((["a", "b"], None, early.count()), (["a", "b"], "weight", early.agg(F.sum("weight")).first()[0])):
        found = model.train(data, features, weight=weight, maxIter=6, maxDepth=3, minInstancesPerNode=5)
        assert fitted[-1].count() < early.count() and fitted[-1].agg(F.sum("_w")).first()[0] == pytest.approx(total)
        with monkeypatch.context() as m:
            m.setattr(model, "COUNTED", 10**9)
            single = model.train(data, features, weight=weight, maxIter=6, maxDepth=3, minInstancesPerNode=5)
        ap = [metrics.average_precision(model.probability(x, late), "isFraud", "score").first().ap for x in (found, single)]
        assert ap[0] > 0.9 * ap[1] > 0.3
        late_rows = data.where(F.col("TransactionDT") >= model.cutoff(data, 0.8))
        margins = model.by_rounds(found.pipeline, model.prepared(late_rows, features)).select("isFraud", F.posexplode("sums").alias("k", "m"))
        best = metrics.average_precision(margins, "isFraud", "m", by=("k",)).orderBy(F.desc("ap"), "k").first()
        assert (found.rounds, found.validation_ap) == (best["k"] + 1, pytest.approx(best["ap"]))


def test_bins_part_few_values_singly_and_frequent_ones_once():
    assert model.edges([1.0, 1.0, 2.0, 4.0]) == [1.5, 3.0] and model.edges([3.0, 3.0]) == [3.0] and model.edges([]) == [0.0] and model.edges([-math.inf, 1.0, 2.0, math.inf]) == [1.5]
    most = model.edges([1.0] * 900 + [float(i) for i in range(2, 102)])
    assert most[0] == 1.5 and len(most) == 31 and most == sorted(set(most)) and max(b - a for a, b in zip(most, most[1:])) <= 4
