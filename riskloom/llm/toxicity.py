"""Toxicity by noisy-channel deobfuscation.

Words written with look-alike signs, spaced letters or stretched letters become a
lattice of characters: a sign reads as the letters it looks like, a sign or space
between letters may mean nothing, a space may also end a word, and a repeated letter
may stand for one. Viterbi decoding under a character trigram model, counted over all
documents, picks the likeliest plain words. The restored text is scored by a logistic
model over its words and word beginnings. The model is fitted on whole texts and on
single features, so that one word left in the open, or restored, counts for what it is
worth alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch
from .common import bounded_batches, keep_rows, map_rows, own_columns
from .language import held_out

#: Parameters of the fit: the classifier learns from at most so many labelled texts, those least by hash; a feature needs so many
#: distinct toxic texts among them and this share of toxic texts; the features of the most evidence enter, at most so many; and the
#: penalty on squared weights. CANDIDATES bounds the words that toxic texts offer to the count over clean ones.
SAMPLE, SUPPORT, PURITY, FEATURES, PENALTY, CANDIDATES = 30_000, 4, 0.5, 2000, 0.02, 200_000
#: A feature counts alone too if this share of its texts is toxic and it is in this share of all toxic texts (copies share rare
#: words, which explain nothing); so many clean texts are then added to its own.
SURE, COMMON, DOUBT = 0.95, 0.03, 2.0
#: A trigram rarer than this among all trigrams of the corpus is left to its last two letters; so the model has at most 1 / SHARE entries.
SHARE = 1e-6
THRESHOLD = 0.7
#: What a sign may stand for. Fixed values.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Signs that may stand between letters and mean nothing.
FILL = set(".-_*'`~^/\\,:;#%&")
COST_LOOK, COST_FILL, COST_REPEAT, COST_BACK, UNSEEN = 1.0, 0.3, 0.5, 4.0, 12.0
WORD = re.compile(r"[^\W\d_]+")
#: Four or more signs that stand alone, whatever their separators, up to a space or a mark.
SPACED = re.compile(r"(?<!\S)(?:(?:[^\W_]|[@$!|+€£])[\s.\-_*]+){3,}(?:[^\W_]|[@$!|+€£])(?=[\s.,;:!?]|\Z)")
GAP = re.compile(r"[\s.\-_*]+")
STRETCH = re.compile(r"([^\W\d_])\1")
RUN = re.compile(r"(.)\1+")
EDGE = re.compile(r"^[^\w@$!|+(€£¡]+|[^\w@$!|+(€£¡]+$|(?:(?<=\w)[!|+(,.]+$)|([@$!|+(€£¡])\1+$")
INNER = re.compile(r"[^\W\d_]")
#: Letters of a beginning that is a feature.
LENGTHS = range(3, 9)
#: Tokens up to this length are remembered, so many words and tokens of a task, and so many trigrams before it passes them on.
KEEP, CACHE, TURN = 64, 300_000, 300_000


def marks(words: set[str], size: int) -> set[str]:
    """Features of some of a text's ``size`` words: words, and beginnings of 3 to 8 letters.

    A beginning of 2 or more words has two stars, of 4 or more three, if it also has one word in 200.
    """
    out = set(words)
    for n in LENGTHS:
        for x, many in Counter(w[:n] for w in words if len(w) > n).items():
            out.update(x + "*" * i for i, least in ((1, 1), (2, 2), (3, 4)) if many >= least and (i == 1 or 200 * many >= size))
    return out


class Decoder:
    """Likeliest plain spelling of a token, or of a run of spaced signs, under a character trigram model."""

    def __init__(self, counts: dict[str, int]):
        before, after, pairs = Counter(), Counter(), Counter()
        for k, n in counts.items():
            before[k[:2]] += n
            pairs[k[1:]] += n
            after[k[1]] += n
        self.three = {k: -math.log(n / before[k[:2]]) for k, n in counts.items()}
        self.two = {k: COST_BACK - math.log(n / after[k[0]]) for k, n in pairs.items()}
        self.short = lru_cache(20_000)(self._decode)
        # tokens and words that decode to nothing else, and what others decode to
        self.plain: set[str] = set()
        self.single: set[str] = set()
        self.odd: dict[str, tuple[str, ...]] = {}
        self.double: dict[str, str] = {}

    def cost(self, gram: str) -> float:
        found = self.three.get(gram)
        return self.two.get(gram[1:], UNSEEN) if found is None else found

    def decode(self, token: str) -> str:
        return self.short(token) if len(token) <= KEEP else self._decode(token)

    def _decode(self, token: str) -> str:
        # state: the last two letters out -> cost and path, a chain of letters back to the start
        states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
        previous = ""
        for c in token:
            ahead: dict[str, tuple[float, tuple | None]] = {}

            def step(to: str, cost: float, path: tuple | None) -> None:
                if to not in ahead or cost < ahead[to][0]:
                    ahead[to] = (cost, path)

            reads = [(c, 0.0)] if c.isalpha() else [(x, COST_LOOK) for x in LOOKS.get(c, "")]
            for last, (cost, path) in states.items():
                for x, more in reads:
                    step(last[1] + x, cost + more + self.cost(last + x), (path, x))
                if not reads:
                    step(last, cost + COST_FILL, path)
                    if c.isspace() and last != "^^":
                        step("^^", cost + self.cost(last + "$"), (path, " "))
                elif c == previous and last[1] in [x for x, _ in reads]:
                    step(last, cost + COST_REPEAT, path)
            states = ahead
            if reads:
                previous = c
        _, path = min(((cost + (0.0 if last == "^^" else self.cost(last + "$")), path) for last, (cost, path) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    def read(self, text: str, wanted=None) -> tuple[set[str], set[str], list[str]]:
        """Of a lowered text its words, what obfuscated tokens decode to, and runs of spaced signs.

        ``wanted`` says of a word without its repetitions whether its decoding can matter;
        decoding never changes that form. Tokens and words seen before are not looked at again.
        """
        words, tokens, found = set(WORD.findall(text)), set(text.split()), set()
        if len(self.plain) > CACHE:
            self.plain.clear()
            self.odd.clear()
        for token in tokens.difference(self.plain):
            known = self.odd.get(token)
            if known is None:
                known = ()
                core = token.lstrip(".,;:?\"'").rstrip(".,;:!?\"'*#%&")
                if not core.isalpha():
                    core = EDGE.sub("", core)
                    if core and not core.isalpha() and INNER.search(core):
                        known = tuple(WORD.findall(self.decode(core)))
                if known and len(token) <= KEEP:
                    self.odd[token] = known
                elif not known and len(token) <= KEEP:
                    self.plain.add(token)
            found.update(known)
        if len(self.single) > CACHE:
            self.single.clear()
            self.double.clear()
        for w in words.difference(self.single):
            known = self.double.get(w)
            if known is None:
                if not STRETCH.search(w) or wanted is not None and not wanted(RUN.sub(r"\1", w)):
                    if len(w) <= KEEP:
                        self.single.add(w)
                    continue
                known = self.decode(w)
                if len(w) <= KEEP:
                    self.double[w] = known
            found.add(known)
        runs = [m[0] for m in SPACED.finditer(text)]
        for run in runs:
            found.update(self.decode(run).split())
        return words, found, runs

    def restored(self, text: str) -> set[str]:
        """The words of a text, with what obfuscated tokens decode to."""
        words, found, _ = self.read(text.lower())
        return words | found


class Features:
    """Which of some features texts have."""

    def __init__(self, known):
        self.known = set(known)
        self.sizes = sorted({len(k) for k in self.known if not k.endswith("*") and len(k) > 3})
        self.stems = {n: {x for k in self.known if k.endswith("*") and len(x := k.rstrip("*")) == n} for n in LENGTHS}
        self.stems = {n: x for n, x in self.stems.items() if x}
        self.far: set[str] = set()
        self.near: set[str] = set()
        # the same without repeated letters
        self.single = {RUN.sub(r"\1", k) for k in self.known if not k.endswith("*")}
        self.begins = {RUN.sub(r"\1", x) for stems in self.stems.values() for x in stems}
        self.spans = sorted({len(x) for x in self.begins})

    def matters(self, word: str) -> bool:
        """Whether a word without its repetitions may be, or begin with, a feature."""
        return word in self.single or any(word[:n] in self.begins for n in self.spans)

    def of(self, words: set[str]) -> set[str]:
        if len(self.far) > CACHE:
            self.far.clear()
        for w in words.difference(self.far, self.near):
            if w in self.known or any(w[:n] in x for n, x in self.stems.items()):
                self.near.add(w)
            elif len(w) <= KEEP:
                self.far.add(w)
        near = words & self.near
        return self.known & marks(near, len(words)) if near else set()


class Model:
    """Restores a text's words and scores them."""

    def __init__(self, counts: dict[str, int], weights: dict[str, float], bias: float):
        self.decoder, self.features, self.weights, self.bias = Decoder(counts), Features(weights), weights, bias

    def restored(self, text: str) -> set[str]:
        return self.decoder.restored(text)

    def score(self, text: str | None) -> float:
        total = self.bias
        if text:
            words, found, runs = self.decoder.read(text.lower(), self.features.matters)
            hits = self.features.of(words | found if found else words)
            for run in runs:
                # nothing tells where words begin in a run: known words count anywhere in it
                run = self.decoder.decode(GAP.sub("", run))
                hits |= self.features.known & {run[i:i + n] for n in self.features.sizes for i in range(len(run) - n + 1)}
            total += sum(self.weights[h] for h in sorted(hits))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


@lru_cache(1)
def letters() -> np.ndarray:
    """Of every code point whether it is a letter of words."""
    return np.fromiter((WORD.match(chr(i)) is not None for i in range(0x110000)), bool, 0x110000)


def grams_of(texts: list[str]) -> dict[str, int]:
    """How often three characters follow one another in the words of texts; ^^ begins and $ ends a word."""
    codes = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[0, 0], np.where(letters()[codes], codes, 0), [0]]).astype(np.int64)
    alphabet = np.flatnonzero(np.bincount(codes))  # 0 first: outside of words, or before them
    if len(alphabet) < 2:
        return {}
    place = np.zeros(int(alphabet[-1]) + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    c, n = place[codes], len(alphabet) + 1
    at = np.flatnonzero(c[2:]) + 2
    one, two = c[at - 1], c[at - 2]
    keys = (np.where(one == 0, 0, two) * n + one) * n + c[at]
    last = at[c[at + 1] == 0]
    keys = np.concatenate([keys, (c[last - 1] * n + c[last]) * n + n - 1])
    if n <= 256:
        counts = np.bincount(keys, minlength=1)
        found = np.flatnonzero(counts)
        counts = counts[found]
    else:
        found, counts = np.unique(keys, return_counts=True)
    names = ["^", *map(chr, alphabet[1:].tolist()), "$"]
    return {names[k // n // n] + names[k // n % n] + names[k % n]: v for k, v in zip(found.tolist(), counts.tolist())}


def trigrams(df: DataFrame, text: str) -> dict[str, int]:
    """How often three characters follow one another in the words of all texts, for those of SHARE or more; ^^ begins and $ ends a word."""

    def count(batches):
        grams: Counter[str] = Counter()
        for pdf in batches:
            texts, held, size = [], [], 0
            for t in pdf["t"]:
                if t:
                    held.append(t)
                    size += len(t)
                    if size > 1 << 20:
                        texts.append(held)
                        held, size = [], 0
            for own in [*texts, held]:
                grams.update(grams_of(own))
            if len(grams) > TURN:
                yield pd.DataFrame(list(grams.items()), columns=["gram", "n"])
                grams.clear()
        yield pd.DataFrame(list(grams.items()), columns=["gram", "n"])

    bounded_batches(df)
    made = df.select(F.col(text).alias("t")).mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    made = Scratch(df.sparkSession, "trigrams").table(made, "all")
    total = made.agg(F.sum("n")).first()[0] or 0
    # at most 1 / SHARE rows
    found = made.where((F.col("n") >= SHARE * total) & (F.col("n") > 0)).toArrow()
    return dict(sorted(zip(found.column("gram").to_pylist(), found.column("n").to_pylist())))


def apart(kept: list[str], same: list[tuple]) -> list[str]:
    """Of features that begin one another and are in the same texts, only the first: the rest would count one word again and again."""
    chosen, seen = [], set()
    for f, texts in zip(kept, same):
        own = {(f.rstrip("*")[:n], texts) for n in range(3, len(f) + 1)}
        if not own & seen:
            chosen.append(f)
            seen |= own
    return chosen


def logistic(texts: list[list[int]], toxic: list[int], many: int) -> tuple[np.ndarray, float]:
    """Weights of at least 0 that fit features to labels, by damped Newton steps along each weight, and the bias.

    The bias is the log-odds of texts without any feature. Every text counts as it is and
    once more for each of its SURE features alone, to which DOUBT clean texts are added, so
    that a feature of few texts decides nothing alone.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    cols = np.array([i for x in texts for i in x], np.int64)
    y = np.array(toxic, float)
    bias = math.log((y[sizes == 0].sum() + 0.5) / ((1 - y)[sizes == 0].sum() + 0.5))
    single, rows = np.repeat(y, sizes), np.repeat(np.arange(len(texts)), sizes)
    held = np.bincount(cols, single, many)
    pure = (held >= SURE * np.bincount(cols, minlength=many)) & (held >= COMMON * y.sum())
    sure, alone = pure[cols], np.flatnonzero(pure)
    rows = np.concatenate([rows, len(texts) + np.arange(sure.sum() + len(alone))])
    cols, y = np.concatenate([cols, cols[sure], alone]), np.concatenate([y, single[sure], np.zeros(len(alone))])
    times = np.ones(len(y))
    times[len(y) - len(alone):] = DOUBT
    w, width = np.zeros(many), np.maximum(1, np.bincount(rows, minlength=len(y)))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, w[cols], len(y)), -30, 30)))
        off, curve = times * (p - y), times * np.maximum(p * (1 - p), 1e-3)
        # the curve of a text counts once for each of its features, which keeps joint steps from overshooting
        step = (np.bincount(cols, off[rows], many) + PENALTY * w) / (np.bincount(cols, (curve * width)[rows], many) + PENALTY)
        w = np.maximum(0.0, w - np.clip(step, -1, 1))
    return w, bias


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> tuple[dict[str, int], dict[str, float], float]:
    """Trigram counts of all texts; feature weights and bias from labelled rows outside fold 1 of 3.

    Rows with a null key, label or text teach nothing; a key labelled both ways counts
    as toxic. At most ``sample`` labels are used and joined as a broadcast of that
    bounded size, and copies of one text count once. What reaches the driver is bounded
    by SHARE, CANDIDATES, FEATURES and ``sample``. Without labels nothing scores.
    """
    spark, s = df.sparkSession, Scratch(df.sparkSession, "toxicity")
    grams = trigrams(df, text)
    chosen = labels.where(~held_out(key, 3, 1) & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(chosen), "k")
    once = texts.groupBy(F.xxhash64("t").alias("h"), F.length("t").alias("n")).agg(F.max("y").alias("y"), F.min("k").alias("k"))
    texts = s.table(texts.join(F.broadcast(once.select("k", F.col("y").alias("label"))), "k").select("t", F.col("label").alias("y")).dropDuplicates(), "texts")
    sizes = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    if not sizes.get(1):
        return grams, {}, -30.0
    shared = spark.sparkContext.broadcast(grams)
    made: list[Decoder] = []

    def words(pdf: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(Decoder(shared.value))
        return pd.DataFrame({"y": pdf["y"], "words": [sorted(made[0].restored(t)) for t in pdf["t"]]})

    read = s.table(map_rows(texts, "y int, words array<string>", words), "words")

    def in_toxic(pdf: pd.DataFrame) -> pd.DataFrame:
        found = Counter(f for x in pdf["words"] for f in marks(set(x), len(x)))
        return pd.DataFrame(list(found.items()), columns=["f", "n"])

    offered = map_rows(read.where("y = 1").select("words"), "f string, n long", in_toxic).groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT)
    offered = {r["f"]: r["n"] for r in offered.orderBy(F.desc("n"), F.length("f"), "f").limit(CANDIDATES).collect()}
    candidates = spark.sparkContext.broadcast(set(offered))

    def in_clean(pdf: pd.DataFrame) -> pd.DataFrame:
        found = Counter(f for x in pdf["words"] for f in candidates.value & marks(set(x), len(x)))
        return pd.DataFrame(list(found.items()), columns=["f", "n"])

    clean = {r["f"]: r["n"] for r in map_rows(read.where("y = 0").select("words"), "f string, n long", in_clean).groupBy("f").agg(F.sum("n").alias("n")).collect()}
    base = sizes[1] / sum(sizes.values())

    def evidence(f: str) -> float:
        """Log-likelihood that the feature gains over the share of toxic texts."""
        k, n = offered[f], offered[f] + clean.get(f, 0)
        return k * math.log(k / n / base) + ((n - k) * math.log((1 - k / n) / (1 - base)) if n > k else 0.0)

    # of so many features tried, about one in seven times does any reach this evidence by chance
    least = math.log(max(2, len(offered))) + 2
    kept = [f for f, n in offered.items() if n >= PURITY * (n + clean.get(f, 0)) and n / (n + clean.get(f, 0)) > base and evidence(f) >= least]
    kept = sorted(kept, key=lambda f: (-evidence(f), -len(f.rstrip("*")), f))[:2 * FEATURES]
    place = {f: i for i, f in enumerate(kept)}

    def have(pdf: pd.DataFrame) -> pd.DataFrame:
        features = Features(place)
        return pd.DataFrame({"y": pdf["y"], "f": [sorted(place[f] for f in features.of(set(x))) for x in pdf["words"]]})

    # at most ``sample`` lists of at most 2 x FEATURES places
    found = map_rows(read, "y int, f array<int>", have).toArrow()
    rows, holders = found.column("f").to_pylist(), [[] for _ in kept]
    for n, x in enumerate(rows):
        for i in x:
            holders[i].append(n)
    chosen = apart(kept, [tuple(x) for x in holders])[:FEATURES]
    at = {place[f]: i for i, f in enumerate(chosen)}
    weights, bias = logistic([[at[i] for i in x if i in at] for x in rows], found.column("y").to_pylist(), len(chosen))
    return grams, {f: float(w) for f, w in zip(chosen, weights) if w > 0}, bias


def score(df: DataFrame, model: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted: one row per input row.

    Null and empty texts get the score of a text without any feature. Equal texts get
    equal scores; other columns are not read; nothing is shuffled.
    """
    own_columns(key, ["score", "predicted"])
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most 1 / SHARE trigrams and FEATURES weights
    made: list[Model] = []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(Model(*shared.value))
        s = [made[0].score(t) for t in pdf["t"]]
        return pd.DataFrame({key: pdf[key], "score": s, "predicted": [int(x >= THRESHOLD) for x in s]})

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, F.col(text).alias("t")), f"`{key}` {kind}, score double, predicted int", run)


def toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Learn outside fold 1 of 3, score all: key, held_out, score, predicted."""
    return score(df, fit(df, labels, key, text, label), key, text).withColumn("held_out", held_out(key, 3, 1))


def keep_clean(df: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """Rows whose score stays under the threshold, all columns as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most 1 / SHARE trigrams and FEATURES weights
    made: list[Model] = []

    def wanted(texts: list) -> list[bool]:
        if not made:
            made.append(Model(*shared.value))
        return [made[0].score(t) < THRESHOLD for t in texts]

    return keep_rows(df, text, wanted)
