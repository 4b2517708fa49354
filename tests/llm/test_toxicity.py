"""The lattice against all its paths, and the classifier on texts it has not seen."""

import random
import time

import numpy as np

from riskloom.llm import toxicity


def counts(words):
    out = {}
    for w in words:
        w = f"^^{w}$"
        for i in range(len(w) - 2):
            out[w[i:i + 3]] = out.get(w[i:i + 3], 0) + 1
    return out


def paths(d, token):
    """(output, cost) of every reading of a token."""
    out = [("^^", "", 0.0, "")]  # last two letters, output, cost, sign before
    for c in token:
        reads = [(c, 0.0)] if c.isalpha() else [(x, toxicity.COST_LOOK) for x in toxicity.LOOKS.get(c, "")]
        ahead = []
        for last, text, cost, before in out:
            for x, more in reads:
                ahead.append((last[1] + x, text + x, cost + more + d.cost(last + x), c))
            if not reads:
                ahead.append((last, text, cost + toxicity.COST_FILL, before))
                if c.isspace() and last != "^^":
                    ahead.append(("^^", text + " ", cost + d.cost(last + "$"), before))
            elif c == before and last[1] in [x for x, _ in reads]:
                ahead.append((last, text, cost + toxicity.COST_REPEAT, c))
        out = ahead
    return [(text, cost + (0.0 if last == "^^" else d.cost(last + "$"))) for last, text, cost, _ in out]


def test_decoding_takes_the_cheapest_path():
    d = toxicity.Decoder(counts(["idiot"] * 9 + ["stupid"] * 5 + ["silly", "total", "is", "a", "an"] * 20))
    r = random.Random(1)
    for _ in range(400):
        token = "".join(r.choice("idot1 0.sl|!") for _ in range(r.randrange(1, 9))).strip() or "a"
        every = paths(d, token)
        least = min(c for _, c in every)
        assert any(t == d.decode(token) and c <= least + 1e-9 for t, c in every), token
    assert d.decode("1d10t") == "idiot" and d.decode("i d i o t").replace(" ", "") == "idiot"


def test_long_tokens_take_linear_time():
    d = toxicity.Decoder(counts(["idiot", "stupid"]))
    began = time.time()
    assert len(d.decode("1d10t." * 30_000)) <= 180_000 and d.restored("1" * 200_000 + "x") and d.restored("a b " * 50_000)
    assert time.time() - began < 20


def test_spaced_words_beside_others():
    m = toxicity.Model(counts(["idiot", "stupid", "you", "are", "an", "loser"] * 5), {"idiot": 6.0, "stupid": 6.0, "loser": 6.0}, -4.0)
    for t in ("you are an i d i o t y o u", "a s t u p i d one", "i d i o t, yes", "IDDIOT", "stuupid", "$tup1d!", "l.o.s.e.r"):
        assert m.score(t) > 0.7, t
    for t in ("a b c d e f g", "", None, "you are", "1 2 3 4 5"):
        assert m.score(t) < 0.1, t


def test_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").toPandas()
    y, s = got["toxic"] == 1, got["score"]
    assert got["predicted"][y].mean() > 0.88 and got["predicted"][~y].mean() < 0.02
    rank = s.rank()
    assert (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) > 0.94
    assert s[~y].nunique() > 5


def test_repeated_rows_score_alike(spark):
    docs = spark.createDataFrame([(i % 20, "mud" if i % 20 < 10 else "sky blue") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(20)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == 60 and got.groupby("doc_id")["score"].nunique().max() == 1


def test_fit_orders_features_by_worth():
    w, bias = toxicity.logistic([[0], [0], [0, 1], [1], [1], []] + [[]] * 20, [1, 1, 1, 1, 0, 0] + [0] * 20, 2)
    assert w[0] > w[1] > 0 and bias < -2 and np.isfinite(w).all()
