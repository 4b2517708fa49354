"""Spelling variants by symmetric deletion.

Every word emits itself and its distinct single deletions. Words that share such a
key meet in an equi-join whose condition checks that they are at distance one, so
no other pair leaves it. A group is small by its nature: words that share a key are
that key with at most one letter more. Keys are hashed to eight bytes, and the check
of whole words makes collisions harmless. Near words are aggregated to a form, and
forms are followed to their roots by joins that double the way in each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import Scratch
from .common import bounded_batches

#: Letters of a word, least code points and occurrences of one, and how much oftener a form is. Fixed values.
LETTERS, LEAST, OFTEN, RATIO = "A-Za-zÀ-ÿ", 7, 2, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points up to which deletions are written out; the keys of longer words are made from hashes of their two parts.
SHORT = 64
MODULUS, BASE = (1 << 61) - 1, 1_000_003


def without(word: Column, at: Column) -> Column:
    """The word without its code point ``at``, from 0."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def counted_words(df: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31) -> DataFrame:
    """(word, n): words of at least LEAST code points met at least OFTEN times.

    Runs of letters are lower-cased (A-Z only). If ``every`` divides the crc32 of
    ``<key>:<run>``, the run loses the code point at that number modulo its length.
    A null key reads as empty, a null text has no words.
    """
    # shorter runs cannot become words
    run = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{LEAST},}}"), F.lit(0))
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(run).alias("r")).select("k", F.translate("r", UPPER, LOWER).alias("r"))
    rows = rows.withColumn("h", F.crc32(F.concat("k", F.lit(":"), "r")))
    word = F.when(F.col("h") % every == 0, without(F.col("r"), (F.col("h") % F.length("r")).cast("int"))).otherwise(F.col("r"))
    return rows.select(word.alias("word")).where(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


def deletion_keys(word: Column) -> Column:
    """Hashes of the word and of its distinct single deletions."""
    cut = F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.xxhash64(without(word, i)))
    return F.array_distinct(F.concat(F.array(F.xxhash64(word)), cut))


def long_keys(word: str) -> set[int]:
    """As deletion_keys(), of a long word: numbers from the hashes of what is before and after the gap."""
    power, before = [1], [0]
    for c in map(ord, word):
        before.append((before[-1] * BASE + c) % MODULUS)
        power.append(power[-1] * BASE % MODULUS)
    n, whole = len(word), before[-1]
    keys = {whole}
    for i in range(n):
        after = (whole - before[i + 1] * power[n - i - 1]) % MODULUS
        keys.add((before[i] * power[n - i - 1] + after) % MODULUS)
    return keys


def near_words(words: DataFrame) -> DataFrame:
    """(a, m, b, n): ordered pairs of words at distance one, each once, with the counts of both. ``words``: word, n.

    Both sides of the join have the same columns, so one exchange of the keys serves both.
    """
    size = F.length("word")
    short = words.where(size <= SHORT + 1).select(F.explode(deletion_keys(F.col("word"))).alias("key"), "word", "n")
    met = short.alias("x").join(short.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.word") != F.col("y.word")) & (F.levenshtein("x.word", "y.word", 1) == 1))
    pairs = met.select(F.col("x.word").alias("a"), F.col("x.n").alias("m"), F.col("y.word").alias("b"), F.col("y.n").alias("n"))
    if (words.agg(F.max(size)).first()[0] or 0) > SHORT:
        pairs = pairs.union(_near_long(words.where(size > SHORT)))
    # a pair may share several keys
    return pairs.repartition("a").dropDuplicates(["a", "b"])


def _near_long(words: DataFrame) -> DataFrame:
    """Pairs of long words; keys travel with a number for the word, since a word has as many as letters."""
    bounded_batches(words)
    named = words.withColumn("id", F.xxhash64("word"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, w in zip(pdf["id"], pdf["word"]):
                keys = list(long_keys(w))
                for at in range(0, len(keys), 1 << 16):
                    yield pd.DataFrame({"key": keys[at:at + (1 << 16)], "id": i})

    keys = named.select("id", "word").mapInPandas(spread, "key long, id long")
    ids = keys.withColumnRenamed("id", "i").join(keys.withColumnRenamed("id", "j"), "key").where("i <> j").select("i", "j").distinct()
    one = named.select(F.col("id").alias("i"), F.col("word").alias("a"), F.col("n").alias("m"))
    other = named.select(F.col("id").alias("j"), F.col("word").alias("b"), "n")
    return ids.join(one, "i").join(other, "j").where(F.levenshtein("a", "b", 1) == 1).select("a", "m", "b", "n")


def roots_of(forms: DataFrame, s: Scratch, max_rounds: int = 64) -> DataFrame:
    """(word, root) of words that have a form: the last of their forms. Counts grow along the way, so it ends."""
    at = s.table(forms.select("word", F.col("form").alias("root")), "way0")
    for r in range(max_rounds):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = s.table(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"way{r + 1}")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.drop("moved")
    raise RuntimeError("roots did not settle")


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of counted_words().

    n_near counts the words at distance one. The form is the most frequent of them (ties: the
    first in code-point order) if it is at least ``ratio`` times as frequent, else null, as is
    form_n. The root is the last form of the chain, the word itself without one. Null and
    empty texts add nothing, an empty table gives no rows, repeated rows count each, and other
    columns play no part.
    """
    s = Scratch(df.sparkSession, "variants")
    words = s.table(counted_words(df, key, text, every), "words")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("b").alias("b")))
    near = near_words(words).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.max("m").alias("m"), best.alias("best"))
    often = -F.col("best.n") >= ratio * F.col("m")
    near = near.select("word", "n_near", F.when(often, F.col("best.b")).alias("form"), F.when(often, -F.col("best.n")).alias("form_n"))
    named = s.table(words.join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long")), "forms")
    roots = roots_of(named.where("form is not null"), s)
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL of spelling_variants() over ``documents``; it has no crc32, so the table of that is made first (polynomial fixed by the format)."""
    return f"""WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
r AS (SELECT doc_id, translate(w, '{UPPER}', '{LOWER}') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]{{{LEAST},}}')) AS w FROM documents) GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM r),
h AS (SELECT w, n, xor(list_reduce(list_transform(list_prepend(4294967295, bytes), lambda x: CAST(x AS BIGINT)), lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])), 4294967295) AS h FROM b, crc),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS w, n FROM h) WHERE length(w) >= {LEAST} GROUP BY w HAVING sum(n) >= {OFTEN}),
d AS (SELECT w, n, i, substr(w, 1, i) || substr(w, i + 2) AS k FROM (SELECT w, n, unnest(range(length(w))) AS i FROM v)),
p AS (SELECT x.w AS a, y.w AS b, y.n FROM d x JOIN d y ON x.i = y.i AND x.k = y.k AND x.w <> y.w
  UNION SELECT d.w, v.w, v.n FROM d JOIN v ON d.k = v.w UNION SELECT v.w, d.w, d.n FROM d JOIN v ON d.k = v.w),
g AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS bn FROM p GROUP BY a),
f AS (SELECT v.w AS word, v.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.bn >= {RATIO} * v.n THEN g.b END AS form, CASE WHEN g.bn >= {RATIO} * v.n THEN g.bn END AS form_n FROM v LEFT JOIN g ON g.a = v.w),
c(word, root, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word) z ON z.word = f.word"""
