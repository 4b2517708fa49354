"""Periodic runs against a scan of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from riskloom.llm import periodic


def brute_runs(x):
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            n = i + q - s
            if n >= max(6, 4 * q) and not any(all(x[j] == x[j + p] for j in range(s, s + n - p)) for p in range(1, q)):
                out.append((s, n, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(key, text):
    words = [w for w in (text or "").encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").split(b" ") if w]
    n, h = len(words), zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    top = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[0] if found else (None,) * 3
    digest = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in found).encode(), b" ".join(kept))]
    return (key, len(found), *top, top[1] and 1000 * top[1] // top[2], *digest)


def test_runs_equal_a_scan():
    r = random.Random(3)
    for _ in range(3000):
        x = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randrange(60))]
        if x and r.random() < 0.6:
            a, p = r.randrange(len(x)), r.randrange(1, 12)
            for i in range(a, min(len(x), a + p * r.randrange(2, 8))):
                x[i] = x[a + (i - a) % p]
        assert periodic.runs(np.array(x, np.int64)) == brute_runs(x), x


def test_the_automaton_alone_finds_every_period():
    r = random.Random(5)
    for _ in range(300):
        x = [r.randrange(2) for _ in range(r.randrange(2, 50))]
        assert {q for _, _, q in brute_runs(x)} <= periodic.square_periods(x)


def test_ordered_sets_in_blocks():
    r = random.Random(1)
    order = r.sample(range(20_000), 9000)
    s, plain = periodic.Ends(order[0]), [order[0]]
    for x in order[1:]:
        at = np.searchsorted(plain, x)
        assert s.add(x) == (plain[at - 1] if at else -1, plain[at] if at < len(plain) else -1)
        plain.insert(at, x)
    assert list(s) == plain and s.count == len(plain) and len(s.blocks) > 4


def test_rows(spark):
    r = random.Random(8)
    texts = [None, "", " \t\n", "a", "a " * 6, "a b " * 4, "a b " * 3, "é\xa0x é\xa0x é\xa0x é\xa0x é\xa0x é\xa0x", "x\x0bx\x0cx\rx\nx\tx", "w" * 100_000]
    texts += [" ".join(r.choice("abcd") for _ in range(r.randrange(80))) for _ in range(60)]
    rows = [(i, t, "q", 1) for i, t in enumerate(texts)] + [(4, texts[4], "q", 1), (None, "a " * 9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, k int").repartition(3)
    want = sorted((brute_row(k, t) for k, t, *_ in rows), key=str)
    got = periodic.periodic_runs(df)
    assert sorted((tuple(x)[:8] for x in got.collect()), key=str) == want
    assert sorted((tuple(x) for x in periodic.periodic_runs(df, digest=True).collect()), key=str) == want
    one = got.where("doc_id is null").first()
    assert one.collapsed == "a" and [tuple(x) for x in one.runs] == [(0, 9, 1)]
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(df.withColumnRenamed("doc_id", "n_runs"), key="n_runs")


def test_long_texts():
    r = random.Random(2)
    base = [r.randrange(4000) for _ in range(20_000)]
    assert periodic.runs(np.array(base * 7, np.int64)) == [(0, 140_000, 20_000)]
    assert periodic.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
