"""Each stage of the corpus pipeline against plain Python on its own input."""

from collections import Counter

import corpus_pipeline
from riskloom.llm import language, packing, toxicity
from riskloom.scratch import Scratch


def shingles(text):
    """Distinct five-word shingles; a shorter text is one."""
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, sf):
    docs, s = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark, "stages")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "best_fit_packing"]
    inputs = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = now
        now = s.table(stage(spark, now, sf), name)
        if name != "best_fit_packing":
            assert now.columns == docs.columns
    texts = {k: {r.doc_id: r.text for r in v.collect()} for k, v in inputs.items()}

    model = toxicity.Model(*toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    assert set(texts["language_id"]) == {k for k, t in texts["toxicity"].items() if model.score(t) < 0.7}

    rows = inputs["language_id"]
    learned = language.fit(rows, ~language.held_out("doc_id", 5, 0))
    known = language.Model(learned)
    kept = {k for k, t in texts["language_id"].items() if (p := known.predict(t))[0] != "und" and p[2] > learned.margin}
    assert set(texts["simhash_near_dedup"]) == kept and len(kept) > 0.95 * len(texts["language_id"])

    keys = sorted(texts["simhash_near_dedup"])
    sets = [shingles(texts["simhash_near_dedup"][k]) for k in keys]
    root = list(range(len(keys)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if root[i] != root[j] and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((root[i], root[j]))
                root = [low if k == high else k for k in root]
    assert set(texts["best_fit_packing"]) == {keys[i] for i in range(len(keys)) if root[i] == i}

    total = Counter()
    for r in now.collect():
        total[r.doc_id] += r.n_tokens
        assert r.offset + r.n_tokens <= r.capacity and r.capacity in packing.CAPACITIES
    assert total == {k: len((t or "").encode().split()) + 1 for k, t in texts["best_fit_packing"].items()}


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "n_tokens", "bin_id", "capacity", "offset"]
