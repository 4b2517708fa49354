"""Boosting that goes on from a kept margin."""

import random

import pytest

from riskloom.operators import boosting
from riskloom.operators.metrics import average_precision


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    out = []
    for i in range(900):
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        out.append((i, i * 3600, a, b if i % 7 else None, int(a * (b if i % 7 else 0) + 0.3 * r.gauss(0, 1) > 0.9)))
    return spark.createDataFrame(out, "TransactionID long, TransactionDT long, a double, b double, isFraud int")


def test_it_stops_and_takes_up_where_it_was(spark, rows, tmp_path, monkeypatch):
    options = {"rounds": 40, "patience": 6, "block": 3, "maxDepth": 3, "minInstancesPerNode": 5}
    path, kept = f"file://{tmp_path}/m", boosting.Run.go_on
    calls = []

    def killed(self, *a):
        if len(calls) == 2:
            raise KeyboardInterrupt
        calls.append(0)
        return kept(self, *a)

    monkeypatch.setattr(boosting.Run, "go_on", killed)
    with pytest.raises(KeyboardInterrupt):
        boosting.boost(rows, ["a", "b"], path=path, **options)
    fitted = []
    monkeypatch.setattr(boosting.Run, "go_on", lambda self, *a: (fitted.append(self.path), kept(self, *a))[1])
    model = boosting.boost(rows, ["a", "b"], path=path, **options)
    searched = len([p for p in fitted if p.endswith("search")]) + 2
    assert 3 * searched < 40 and 3 * searched - model.rounds >= 6 and 1 <= model.rounds  # ended early, and then fitted the best number
    score = model.probability(rows)
    assert score.columns == [*rows.columns, "score"] and score.where("score is null or score < 0 or score > 1").isEmpty()
    assert average_precision(score, "isFraud", "score").first().ap > 0.6 and model.validation_ap > 0.4
    fitted.clear()
    again = boosting.boost(rows, ["a", "b"], path=path, **options)
    assert not fitted and again.rounds == model.rounds
    assert score.exceptAll(again.probability(rows)).isEmpty()


def test_without_late_positives_all_rounds_are_fitted(spark, rows):
    early = rows.where("TransactionDT < 700 * 3600 or isFraud = 0")
    model = boosting.boost(early, ["a"], rounds=2, block=2, maxDepth=2)
    assert model.rounds == 2 and model.validation_ap != model.validation_ap
