"""Language identification by compression with per-language dictionaries.

Each learned language has a raw-content zstandard dictionary of sample texts. A
text is cut into blocks, every block is compressed with every dictionary, and the
language with the fewest bytes in all wins; a text is rejected where the runner-up
comes too close.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import Scratch
from .common import keep_rows, map_rows, own_columns

#: Parameters of the fit, per language: texts in the dictionary, further texts that the margin is fitted on, and the longest text
#: that is taken whole as a sample; longer ones are predicted like any others.
SAMPLES, TRIALS, LONGEST = 40, 160, 20_000
#: Characters in a compressed block; a text's blocks are all counted.
BLOCK = 2000
LEVEL = 9
#: A lead of fewer bytes is measured again with so many parts of each dictionary.
NARROW, PARTS = 5, 8
#: The least margin, where the sample asks for none: this share of bytes.
MARGIN = 0.015
UNKNOWN = "und"
LETTER, OTHER = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]+")


class Learned(dict):
    """Dictionary text and share of the training rows by language, with the margin up to which guesses are rejected."""

    margin = MARGIN

    def __reduce__(self):
        return rebuilt, (dict(self), self.margin)


def rebuilt(values: dict, margin: float) -> Learned:
    out = Learned(values)
    out.margin = margin
    return out


def fit(df: DataFrame, train: Column, text: str = "text", lang: str = "lang", samples: int = SAMPLES, trials: int = TRIALS) -> Learned:
    """Dictionaries, shares and margin from the rows where ``train`` holds and text and lang are not null.

    Each language keeps the text of least hash in each of samples + trials hash classes, of
    those up to LONGEST characters: an aggregation that combines before its shuffle and
    gives copies of one text no more room than one. At most that many whole texts a language
    reach the driver. The margin is the one at which the trial texts have the fewest wrong
    guesses accepted and right ones rejected, and MARGIN at least.
    """
    rows = df.where(train & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    held = Scratch(df.sparkSession, "language").table(
        rows.groupBy("lang", F.pmod("h", F.lit(samples + trials)).alias("c")).agg(
            F.min(F.when(F.length("text") <= LONGEST, F.col("h"))).alias("h"), F.count("*").alias("n")), "least")
    # bounded by classes x languages rows
    least = held.where("h is not null").select("lang", "h", "c")
    picked = rows.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h", "c").agg(F.min("text").alias("t")).collect()
    shares = {r["lang"]: r["n"] for r in held.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    found: dict[str, list[str]] = {k: [] for k in shares}
    tried = []
    for r in sorted(picked, key=lambda r: (r["lang"], r["c"])):
        if len(found[r["lang"]]) < samples:
            found[r["lang"]].append(plain(r["t"]))
        else:
            tried.append((r["lang"], r["t"]))
    # a raw dictionary has 8 bytes at least
    learned = Learned({k: ("\n".join(v).encode().ljust(8), shares[k] / sum(shares.values())) for k, v in found.items()})
    model = Model(learned)
    guesses = sorted((m, k == lang) for lang, t in tried if LETTER.search(t) for k, _, m in [model.predict(t)])
    cost = least_cost = 0
    for m, ok in guesses:  # against accepting all: a wrong guess less, or a right one
        cost += 1 if ok else -1
        if cost < least_cost:
            least_cost, learned.margin = cost, max(MARGIN, m)
    return learned


def plain(text: str) -> str:
    """Lowered letters with single spaces between words."""
    return OTHER.sub(" ", text.lower())


class Model:
    """Compressed sizes of a text under each language."""

    def __init__(self, learned: dict[str, tuple[bytes, float]]):
        self.langs = sorted(learned)
        self.coders = [coder(learned[k][0]) for k in self.langs]
        self.priors = [-math.log2(learned[k][1]) / 8 for k in self.langs]
        cuts = {k: len(learned[k][0]) // PARTS for k in self.langs}
        self.parts = [[coder(learned[k][0][i * cuts[k]:(i + 1) * cuts[k]].ljust(8)) for i in range(PARTS)] for k in self.langs]

    def sizes(self, text: str) -> list[float]:
        """Bytes by language; where the least two are within NARROW bytes, with the mean over parts of the dictionaries added."""
        text = plain(text)
        blocks = [text[i:i + BLOCK].encode() for i in range(0, len(text), BLOCK)]
        found = [sum(len(c.compress(b)) for b in blocks) for c in self.coders]
        if len(found) > 1 and (low := sorted(found))[1] - low[0] < NARROW:
            found = [n + sum(len(c.compress(b)) for c in parts for b in blocks) / PARTS for n, parts in zip(found, self.parts)]
        return found

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin: the language's share of the corpus breaks near-ties, but a margin is of bytes only."""
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        costs = [n + prior for n, prior in zip(sizes, self.priors)]
        order = sorted(range(len(costs)), key=lambda i: (costs[i], self.langs[i]))
        best, won = costs[order[0]], sizes[order[0]]
        if len(order) == 1:
            return self.langs[order[0]], 1.0, 1.0
        score = 1 / sum(math.exp(40 * (best - c) / best) for c in costs)
        return self.langs[order[0]], score, max(0.0, (min(sizes[i] for i in order[1:]) - won) / won)


def coder(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)


def identify(df: DataFrame, learned: Learned, key: str = "doc_id", text: str = "text", margin: float | None = None) -> DataFrame:
    """key, lang_pred, score (0 to 1), margin, accepted: one row per input row.

    ``und`` with score 0 marks null texts, texts without a letter, and every text
    where nothing was learned. Ties go to the language first by name. Equal texts
    get equal rows; other columns are not read; nothing is shuffled. A text is accepted
    over the fitted margin, or over ``margin``.
    """
    margin = learned.margin if margin is None else margin
    own_columns(key, ["lang_pred", "score", "margin", "accepted"])
    made: list[Model] = []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(Model(learned))
        out = pd.DataFrame([made[0].predict(t) for t in pdf["t"]], columns=["lang_pred", "score", "margin"])
        out["accepted"] = (out["lang_pred"] != UNKNOWN) & (out["margin"] > margin)
        out.insert(0, key, pdf[key].to_numpy())
        return out

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, F.col(text).alias("t")), f"`{key}` {kind}, lang_pred string, score double, margin double, accepted boolean", run)


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls in the fold; never for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)) == fold, F.lit(False))


def language_id(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows outside fold 0 of 5, predict all: key, held_out, lang_pred, score, margin, accepted."""
    model = fit(df, ~held_out(key, 5, 0) & F.col(key).isNotNull(), text, lang)
    return identify(df, model, key, text).withColumn("held_out", held_out(key, 5, 0))


def keep_known(df: DataFrame, learned: Learned, text: str = "text", margin: float | None = None) -> DataFrame:
    """Rows of an accepted language, all columns as they are."""
    margin = learned.margin if margin is None else margin
    made: list[Model] = []

    def wanted(texts: list) -> list[bool]:
        if not made:
            made.append(Model(learned))
        found = [made[0].predict(t) for t in texts]
        return [k != UNKNOWN and m > margin for k, _, m in found]

    return keep_rows(df, text, wanted)
