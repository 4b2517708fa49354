"""Periodic runs of words, by a suffix automaton.

The end positions of an automaton's states are merged up the tree of its suffix links,
the smaller ordered set into the larger. A position that is merged in has two new
neighbours; a distance d to one that is not over the state's length means that d words
are followed by the same d words, a square, which is extended to the run around it.

Words outside of any run are told first, exactly: each word of a run of at least four
periods occurs four times, and three words in a row (of six or more) three times in the
stretch the run lies in. Texts are cut where that fails, again and again, and automata
are built of what is left.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import map_rows, own_columns

#: Least words and periods of a run.
LEAST, PERIODS = 6, 4
#: Positions in a block of an ordered set.
BLOCK = 1024


class Automaton:
    """The suffix automaton of a sequence of numbers: lengths, suffix links and first ends of its states.

    Most states have one way on, which is kept in two arrays; only further ones take a dictionary.
    """

    def __init__(self, word: list[int]):
        self.length, self.link, self.end = array("q", [0]), array("q", [-1]), array("q", [-1])
        self.sign, self.to, self.more = array("q", [-1]), array("q", [-1]), {}
        last = 0
        for i, c in enumerate(word):
            last = self.extend(last, c, i)

    def state(self, length: int, link: int, end: int) -> int:
        for store, x in ((self.length, length), (self.link, link), (self.end, end), (self.sign, -1), (self.to, -1)):
            store.append(x)
        return len(self.length) - 1

    def go(self, s: int, c: int) -> int:
        if self.sign[s] == c:
            return self.to[s]
        return self.more[s].get(c, -1) if s in self.more else -1

    def put(self, s: int, c: int, t: int) -> None:
        if self.sign[s] in (-1, c):
            self.sign[s], self.to[s] = c, t
        else:
            self.more.setdefault(s, {})[c] = t

    def extend(self, last: int, c: int, i: int) -> int:
        new, s = self.state(self.length[last] + 1, 0, i), last
        while s >= 0 and (t := self.go(s, c)) < 0:
            self.put(s, c, new)
            s = self.link[s]
        if s >= 0:
            if self.length[t] == self.length[s] + 1:
                self.link[new] = t
            else:
                twin = self.state(self.length[s] + 1, self.link[t], -1)  # ends where its children end
                self.sign[twin], self.to[twin] = self.sign[t], self.to[t]
                if t in self.more:
                    self.more[twin] = dict(self.more[t])
                while s >= 0 and self.go(s, c) == t:
                    self.put(s, c, twin)
                    s = self.link[s]
                self.link[t] = self.link[new] = twin
        return new


class Ends:
    """An ordered set of positions in blocks, so that an insertion moves few of them."""

    def __init__(self, first: int):
        self.blocks, self.least, self.count = [[first]], [first], 1

    def __iter__(self):
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> tuple[int, int]:
        """Takes a position; its neighbours before and after, or -1."""
        blocks, at = self.blocks, max(0, bisect_left(self.least, x) - 1)
        own = blocks[at]
        i = bisect_left(own, x)
        before = own[i - 1] if i else -1
        after = own[i] if i < len(own) else blocks[at + 1][0] if at + 1 < len(blocks) else -1
        own.insert(i, x)
        self.count += 1
        if not i:
            self.least[at] = x
        if len(own) > BLOCK:
            half = len(own) // 2
            blocks[at:at + 1] = [own[:half], own[half:]]
            self.least[at:at + 1] = [own[0], own[half]]
        return before, after


def square_periods(word: list[int]) -> set[int]:
    """Lengths of squares such that every run's smallest period is among them."""
    a = Automaton(word)
    held: dict[int, Ends] = {}
    found: set[int] = set()
    link, length, end = a.link, a.length, a.end
    order = np.argsort(np.frombuffer(length, np.int64), kind="stable")[:0:-1].tolist()
    for s in order:
        own = held.pop(s, None)
        if end[s] >= 0:
            if own is None:
                own = Ends(end[s])
            else:
                _meet(own, (end[s],), length[s], found)
        up = link[s]
        if not up:
            continue  # nothing is shared
        theirs = held.get(up)
        if theirs is None:
            held[up] = own
        elif theirs.count < own.count:
            _meet(own, theirs, length[up], found)
            held[up] = own
        else:
            _meet(theirs, own, length[up], found)
    return found


def _meet(larger: Ends, smaller, length: int, found: set[int]) -> None:
    for x in smaller:
        before, after = larger.add(x)
        if before >= 0 and x - before <= length:
            found.add(x - before)
        if 0 <= after and after - x <= length:
            found.add(after - x)


def stretches(good: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of stretches of true values of at least that length."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    long = b - a >= least
    return list(zip(a[long].tolist(), b[long].tolist()))


def repeated_parts(x: np.ndarray) -> list[tuple[int, int]]:
    """Parts (start, end) of a sequence that together hold every run; each run lies in one of them."""
    # every word of a run occurs once a period
    todo, done = stretches(np.bincount(x)[x] >= PERIODS, LEAST) if len(x) else [], []
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        _, y = np.unique(x[a:b], return_inverse=True)
        two = np.unique(y[:-1] * (int(y.max()) + 1) + y[1:], return_inverse=True)[1]
        # numbers of pairs, so that three words never overflow
        _, at, n = np.unique(two[:-1] * (int(two.max()) + 1) + two[1:], return_inverse=True, return_counts=True)
        parts = [(a + s, a + e + 2) for s, e in stretches(n[at] >= PERIODS - 1, LEAST - 2)]
        if parts == [(a, b)]:
            done.append((a, b))
        else:
            todo += parts
    return sorted(done)


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least LEAST words and PERIODS smallest periods, by start, then period."""
    out = []
    for a, b in repeated_parts(x):
        part = x[a:b]
        kept: list[tuple[int, int, int]] = []
        for d in sorted(square_periods(part.tolist())):
            if PERIODS * d > len(part):
                break
            for s, e in stretches(part[d:] == part[:-d], max(LEAST, PERIODS * d) - d):
                # the same words may have a smaller period, which divides this one
                if not any(d % q == 0 and i <= s and e + d <= j for i, j, q in kept):
                    kept.append((s, e + d, d))
        out += [(a + s, e - s, d) for s, e, d in kept]
    return sorted(out, key=lambda r: (r[0], r[2]))


def rewritten(words: list[bytes], key: str) -> list[bytes]:
    """The words of a text whose key's crc32 is divisible by ten go on from some place with a period."""
    h, n = zlib.crc32(key.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed, runs: one row per input row.

    ``digest`` leaves the last two out.

    Words are what ASCII white space parts, numbered from 0; some texts are rewritten first, see
    rewritten(). A run is a longest stretch of words with smallest period q and at least LEAST
    words and PERIODS periods. start to exponent_milli tell of the longest run (ties: first, then
    of smaller period) and are null without one. ``runs`` lists all as (start, length, period), and
    ``collapsed`` is the text without the words that follow a run's first period. Null and empty
    texts have no words and no runs; a text under a null key is not rewritten. Equal keys and texts
    have equal results. A part that repeats takes some 300 bytes a word in its task.
    """
    made = dict(x.split(":") for x in ("n_runs:long", "start:long", "length:long", "period:long", "exponent_milli:long", "runs_sha256:string", "collapsed_sha256:string"))
    if not digest:
        made |= {"collapsed": "string", "runs": "array<struct<start long, length long, period long>>"}
    own_columns(key, list(made))

    def one(k, t) -> tuple:
        words = (t or "").encode("utf-8", "surrogatepass").split()
        if k is not None:
            words = rewritten(words, k)
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        found = runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        if found:
            covered = np.zeros(len(words) + 1, np.int64)
            for s, n, q in found:
                covered[s + q] += 1
                covered[s + n] -= 1
            words = [w for w, c in zip(words, np.cumsum(covered).tolist()) if not c]
        rest = b" ".join(words)
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        first = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
        out = (len(found), *first, hashlib.sha256(listed).hexdigest(), hashlib.sha256(rest).hexdigest())
        return out if digest else (*out, rest.decode("utf-8", "replace"), [{"start": s, "length": n, "period": q} for s, n, q in found])

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([one(k, t) for k, t in zip(pdf["k"], pdf["t"])], columns=list(made))
        for c in ("start", "length", "period", "exponent_milli"):
            out[c] = out[c].astype("Int64")
        out.insert(0, "k", pdf["k"].to_numpy())
        return out

    kind = df.schema[key].dataType.simpleString()
    schema = ", ".join(["k string", *(f"{c} {k}" for c, k in made.items())])
    rows = df.selectExpr(f"cast(`{key}` as string) as k", f"`{text}` as t")
    return map_rows(rows, schema, judge).selectExpr(f"cast(k as {kind}) as `{key}`", *made)
