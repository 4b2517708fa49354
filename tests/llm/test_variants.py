"""Spelling variants against all pairs of words, and against the SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb

from riskloom.llm import variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for k, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    form, close = {}, {}
    for w in n:
        close[w] = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form[w] = close[w][0] if close[w] and n[close[w][0]] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def corpus(seed, letters="abÀé"):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randrange(6, 10))) for _ in range(60)] + ["straßen", "STRASSEN", "strassen", "×÷×÷×÷×"]
    weight = [r.choice([1, 1, 2, 30, 400]) for _ in words]
    return [(i, " ".join(r.choices(words, weight, k=120))) for i in range(40)]


def test_against_all_pairs_and_sql(spark):
    rows = corpus(1) + [(None, "nullkeyword nullkeyword"), (3, None), (4, ""), (4, "  \n"), (9, "ab1234567 abcdef")]
    rows += [(5, rows[5][1])] * 2 + [(100 + i, "chained " * 2 + "chainned " * 30 + "chainnedd " * 400) for i in range(3)]
    df = spark.createDataFrame([(k, t, "w", 1) for k, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = brute(rows)
    assert any(r[1] and r[2] != r[1] for r in want) and got(variants.spelling_variants(df)) == want
    con = duckdb.connect()
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841
    con.sql("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents")
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({variants.oracle()})").fetchall()) == want


def test_long_words_meet_as_short_ones_do(spark):
    r = random.Random(2)
    words = []
    for size in (62, 63, 64, 65, 66, 67, 5000):
        w = "".join(r.choice("abc") for _ in range(size))
        at = r.randrange(size)
        words += [w, w[:at] + w[at + 1:], w[:at] + "z" + w[at + 1:], w + "a", "y" + w]
    words += ["a" * 64, "a" * 65, "a" * 66, "a" * 20_000, "a" * 20_001]
    rows = [(i, f"{w} " * (1 + i % 25)) for i, w in enumerate(words)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(variants.spelling_variants(df)) == brute(rows)


def test_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, "a b"), (3, "onlyoncehere")], "doc_id long, text string")
    assert got(variants.spelling_variants(df)) == got(variants.spelling_variants(df.limit(0))) == []


def test_roots_of_a_long_chain(spark):
    from riskloom.scratch import Scratch

    forms = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(100)], "word string, form string")
    assert {r.root for r in variants.roots_of(forms, Scratch(spark)).collect()} == {"w100"}
