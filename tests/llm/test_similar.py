"""Near-dedup of the pipeline against all pairs of distinct shingle sets."""

import random

import numpy as np
import pytest

from riskloom.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root[i], root[j]))
                root = [x if k == y else k for k in root]
    return dict(enumerate(root))


def found(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {x.doc_id: x.component_id for x in simhash.similar_documents(df, **options).collect()}


def words(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def test_links_are_of_whole_sets(spark):
    r = random.Random(1)
    passage, line = words(r, 330), words(r, 10)
    texts = [" ".join(passage + words(r, n)) for n in [70] * 40 + [60] * 20 + [30] * 10]  # of one passage, similarity 0.69 to 0.84
    texts += [" ".join(words(r, 104) + line * 30) for _ in range(10)]  # a line repeated, little else in common
    base = words(r, 204)
    texts += [" ".join(base), " ".join(base[:-20] + words(r, 20)), " ".join(base[:-22] + words(r, 22)), " ".join(base[:-23] + words(r, 23)), "", " ", "one two", "one  TWO", "one three"]
    want = brute(texts)
    assert len(set(want.values())) > 60 and len(set(want.values())) < len(texts) - 10
    assert found(spark, texts) == want


@pytest.mark.parametrize("group", [3, 1000])
def test_no_group_is_too_large(spark, group):
    """One key holds 150 texts; whatever the bound of a task, every pair of them is compared."""
    r = random.Random(2)
    passage, texts = words(r, 300), []
    for _ in range(50):
        own = words(r, 80)
        texts += [" ".join(passage + own), " ".join(passage + own[:-8] + words(r, 8)), " ".join(passage + words(r, 75))]
    assert found(spark, texts, group=group) == brute(texts)


def test_recall_at_the_similarity_wanted():
    """Of pairs at 0.8 just about all share a key."""
    r, met = np.random.default_rng(3), 0
    for _ in range(2000):
        n = int(r.integers(20, 600))
        both = -(-8 * n // 9)
        x = r.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
        met += bool((simhash.band_keys(np.sort(x[:n])) == simhash.band_keys(np.sort(x[n - both:]))).any())
    assert met >= 1996


def test_recall_of_wide_fingerprints():
    """Of pairs at 0.8, of small sets and large ones, 99 in 100 stay within the bits that the index searches."""
    r = np.random.default_rng(4)
    for low, high in ((5, 12), (12, 40), (40, 150), (150, 1200)):
        near, many = 0, 1500
        for _ in range(many):
            n = int(r.integers(low, high))
            both = -(-8 * n // 9)
            x = r.integers(0, 1 << 63, 2 * n - both).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            a, b = (simhash.wide_fingerprint(np.sort(v)) for v in (x[:n], x[n - both:]))
            near += int(np.bitwise_count(a ^ b).sum()) <= simhash.SIMILAR_BITS
        print(low, high, near / many)
        assert near >= 0.99 * many


def test_index_of_several_words_finds_every_component():
    r, g = random.Random(6), np.random.default_rng(6)
    base = g.integers(0, 1 << 63, (5, 3)).astype(np.uint64)
    codes = []
    for _ in range(200):
        c = base[r.randrange(5)].copy()
        for _ in range(r.randrange(9)):
            c[r.randrange(3)] ^= np.uint64(1 << r.randrange(64))
        codes.append(c)
    codes = np.unique(np.array(codes), axis=0)
    index = simhash.GrayIndex(codes)
    want = np.arange(len(codes))
    far = np.bitwise_count(index.codes[:, None] ^ index.codes[None]).sum(2)
    want = simhash.merge(want, *np.nonzero(far <= 6))
    assert (index.forest(6) == want).all() and (simhash.leaves(np.zeros(len(codes)), index.codes, 6) == want).all()
    assert (index.forest(6, simhash.first_of(np.arange(len(codes)) % 2 == 0))[::2] == 0).all()


def test_awkward_texts(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "one", 0), (4, "one", 1), (None, "one", 2), (5, "x" * 100_000, 3), (6, "w " * 60_000, 4), (7, "w " * 30_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, g int")
    got = sorted((x.doc_id or 0, x.component_id or 0) for x in simhash.similar_documents(df).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 6), (7, 6)]
    assert simhash.similar_documents(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(x.doc_id or 0 for x in kept.collect()) == [0, 1, 4, 5, 6]


def test_one_key_with_several_texts(spark):
    """Texts are linked for themselves, whatever keys they share, and no document is lost, in any order of the rows."""
    r = random.Random(6)
    a, b = words(r, 100), words(r, 100)
    near = lambda w: " ".join(w + words(r, 4))
    rows = [(1, " ".join(a)), (5, near(a)), (5, " ".join(b)), (9, near(b)), (7, "x y"), (7, "x y"), (7, "z")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([(k, t, {"m": t}) for k, t in rows], "doc_id long, text string, extra map<string,string>").repartition(3)
        got = sorted((x.doc_id, x.component_id) for x in simhash.similar_documents(df).collect())
        assert got == [(1, 1), (5, 1), (5, 5), (7, 7), (7, 7), (7, 7), (9, 5)]
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        assert sorted((x.doc_id, x.text, x.extra["m"]) for x in kept.collect()) == sorted((k, t, t) for k, t in {(1, " ".join(a)), (5, " ".join(b)), (7, "x y"), (7, "z")})
    least = spark.createDataFrame([(2, near(b)) if k == 9 else (k, t) for k, t in rows], "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.keep_one(least).collect()) == [1, 2, 7, 7]
    one = spark.createDataFrame([(3, " ".join(a)), (3, near(a)), (4, "x")], "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.keep_one(one).collect()) == [3, 4] and len({x.text for x in simhash.keep_one(one).collect() for _ in range(3)}) == 2


def test_keys_of_text(spark):
    df = spark.createDataFrame([("b", "one two"), ("a", "ONE two"), (None, "one two"), ("c", None)], "doc_id string, text string")
    assert sorted((x.doc_id or "", x.component_id) for x in simhash.similar_documents(df).collect()) == [("", None), ("a", "a"), ("b", "a"), ("c", "c")]
    assert sorted(x.doc_id or "" for x in simhash.keep_one(df).collect()) == ["", "a", "c"]
