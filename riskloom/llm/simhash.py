"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within ``bits`` differences agree on whole blocks: of ``blocks`` blocks at
least ``blocks - bits`` are equal, so every choice of that many blocks gives a table of
groups in which each close pair meets. A task receives whole groups, sorts a
group's fingerprints by Gray rank, factors the bits that neighbours share into
nodes over nodes, and searches downwards: differences on the shared bits add up
along the path and a node is dropped, with all below it, once they exceed ``bits``.
A node whose members are already in the query's component is dropped too, so a
dense group costs about its size, not its square. A group leaves its task as a
forest of links; only connected components join the forests of all groups.

``similar_documents`` uses the same index for texts of a given similarity of their
shingle sets: on fingerprints of several words, with a bound on their differences that
such texts keep, and with an exact comparison of the sets that follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..scratch import Scratch
from .common import map_rows, own_columns

SHINGLE, BITS, BLOCKS = 3, 3, 5
SEED = 42
FANOUT = 8
#: Distinct fingerprints that one task indexes at once; a larger group is dealt anew by its other bits.
GROUP = 1 << 16
#: With so few bits not shared, a group has at most 65536 distinct codes and is never dealt anew.
LEAST_FREE = 16
#: Shingles hashed at a time; longer texts take several turns.
TURN = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """64 bits: each is 1 if set in over half the XXH64 values of the text's word shingles.

    A-Z are lowered, words are runs of other than ASCII white space, repeats count,
    a text of fewer words is one shingle, and a text of none has fingerprint 0.
    """
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(tokens))
    starts, ends = starts[:len(tokens) - k + 1].tolist(), ends[k - 1:].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), TURN):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + TURN], ends[i:i + TURN])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str, text: str, words: int = SHINGLE) -> DataFrame:
    """key, fp (64 bits as a signed long); null texts have fingerprint 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: pdf[key], "fp": np.array([fingerprint(t, words) for t in pdf["t"]], np.uint64).view(np.int64)})

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, F.col(text).alias("t")), f"`{key}` {kind}, fp long", run)


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(s)
    return v


def gray_order(codes: np.ndarray) -> np.ndarray:
    """Order of codes of several words, the first word highest, in the Gray sequence."""
    ranks, odd = [], np.zeros(len(codes), bool)
    for word in codes.T:
        r = gray_rank(word)
        ranks.append(np.where(odd, ~r, r))
        odd = (ranks[-1] & np.uint64(1)).astype(bool)
    return np.lexsort(ranks[::-1])


class GrayIndex:
    """Fingerprints of one or more 64-bit words, one a row, in Gray order under nodes of shared bits."""

    def __init__(self, codes: np.ndarray):
        self.order = gray_order(codes)
        self.codes = codes[self.order]
        # levels, leaves' parents first: shared mask, pattern on it, and the bits not yet factored out below
        full = np.full_like(self.codes, ~np.uint64(0))
        levels, mask, pattern = [], full, self.codes
        while len(pattern) > FANOUT:
            cut = np.arange(0, len(pattern), FANOUT)
            differ = np.bitwise_or.reduceat(pattern, cut) & ~np.bitwise_and.reduceat(pattern & mask, cut)
            shared = np.bitwise_and.reduceat(mask, cut) & ~differ
            levels.append((mask, pattern))
            mask, pattern = shared, pattern[cut] & shared
        levels.append((mask, pattern))
        self.levels = levels[::-1]

    def forest(self, bits: int, root: np.ndarray | None = None) -> np.ndarray:
        """For each code, in index order, the place of a code of its component (a root for all of one).

        ``root``: what is known to be connected, as places in index order of the first code of each component.
        """
        n = len(self.codes)
        root = np.arange(n) if root is None else root
        depth = len(self.levels) - 1
        spans = [FANOUT ** (depth - i) for i in range(depth + 1)]
        begin, step = 0, 8
        while begin < n:
            stop = min(n, begin + step)
            # a node is of one component if the least and greatest roots below it agree
            low = [np.minimum.reduceat(root, np.arange(0, n, s)) for s in spans]
            high = [np.maximum.reduceat(root, np.arange(0, n, s)) for s in spans]
            q = np.repeat(np.arange(begin, stop), len(self.levels[0][1]))
            node = np.tile(np.arange(len(self.levels[0][1])), stop - begin)
            far = np.zeros(len(q), np.int64)
            above = np.zeros((len(q), self.codes.shape[1]), np.uint64)
            for i, (mask, pattern) in enumerate(self.levels):
                # first what needs no bits: nodes before the query, and nodes of its own component
                keep = ((low[i][node] != root[q]) | (high[i][node] != root[q])) & ((node + 1) * spans[i] > q)
                q, node, far, above = q[keep], node[keep], far[keep], above[keep]
                far = far + np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node] & ~above).sum(1, dtype=np.int64)
                keep = far <= bits
                q, node, far = q[keep], node[keep], far[keep]
                if i < depth:
                    above = mask[node]
                    width = np.minimum(FANOUT, len(self.levels[i + 1][1]) - node * FANOUT)
                    first = np.repeat(node * FANOUT, width)
                    q, far, above = np.repeat(q, width), np.repeat(far, width), np.repeat(above, width, axis=0)
                    node = first + np.arange(len(first)) - np.repeat(np.cumsum(width) - width, width)
            if len(q):
                root = merge(root, q, node)
            begin, step = stop, min(128, 2 * step)
        return root


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking a[i] with b[i]: least roots spread until nothing changes."""
    root = root.copy()
    while True:
        x, y = root[a], root[b]
        keep = x != y
        if not keep.any():
            return root
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        to = np.arange(len(root))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while True:
            nearer = to[to]
            if (nearer == to).all():
                break
            to = nearer
        root = to[root]


@lru_cache(None)
def masks(used: int, bits: int, blocks: int) -> tuple[int, ...]:
    """Of the bits that ``used`` leaves free, every choice of blocks that some close pair has equal; joined with ``used``."""
    free = [i for i in range(64) if not used >> i & 1]
    blocks = min(blocks, len(free))
    edges = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:])]
    return tuple(used | sum(c) for c in combinations(parts, blocks - bits))


def deal(used: np.ndarray, fp: np.ndarray, bits: int, blocks: int) -> pd.DataFrame:
    """Each code once for each of its next groups: used (the equal bits), g (a hash of them), fp."""
    out = []
    for u in np.unique(used):
        own = fp[used == u]
        for m in masks(int(u), bits, blocks):
            name = np.uint64(m * 0x9E3779B97F4A7C15 % (1 << 64))
            m = np.uint64(m)
            g = ((own & m) ^ name) * np.uint64(0xD6E8FEB86659FD93)
            out.append((np.full(len(own), m), g ^ (g >> np.uint64(32)), own))
    used, g, fp = (np.concatenate(x).view(np.int64) for x in zip(*out))
    return pd.DataFrame({"used": used, "g": g, "fp": fp})


def search(batches: Iterator[pd.DataFrame], bits: int, group: int) -> Iterator[pd.DataFrame]:
    """Forest links of each group from rows sorted by group; codes of a group over the bound pass with src = dst."""
    held: list[np.ndarray] = []
    name, passing = None, False

    def ended() -> Iterator[pd.DataFrame]:
        if not passing and sum(map(len, held)) > 1:
            index = GrayIndex(np.concatenate(held)[:, None])
            root = index.forest(bits)
            at = np.flatnonzero(root != np.arange(len(root)))
            if len(at):
                yield pd.DataFrame({"src": index.codes[root[at], 0].view(np.int64), "dst": index.codes[at, 0].view(np.int64), "used": 0})

    for pdf in batches:
        used, g, fp = (pdf[c].to_numpy(np.int64) for c in ("used", "g", "fp"))
        cut = np.concatenate([[0], np.flatnonzero((np.diff(g) != 0) | (np.diff(used) != 0)) + 1, [len(g)]])
        many = np.diff(cut) > 1
        many[[0, -1]] = True  # may go on in another batch
        for a, b in zip(cut[:-1][many].tolist(), cut[1:][many].tolist()):
            if name != (used[a], g[a]):
                yield from ended()
                held, passing, name = [], False, (used[a], g[a])
            held.append(fp[a:b].view(np.uint64))
            wide = 64 - int(used[a]).bit_count() if used[a] >= 0 else 64 - (int(used[a]) + (1 << 64)).bit_count()
            if passing or wide > LEAST_FREE and sum(map(len, held)) > group:
                rest, passing, held = np.concatenate(held).view(np.int64), True, []
                yield pd.DataFrame({"src": rest, "dst": rest, "used": used[a]})
    yield from ended()


def links(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """(src, dst) of distinct fingerprints within ``bits``, as forests: every close pair is connected.

    ``fps`` has one column ``fp`` of distinct values. A group over ``group`` codes is
    dealt out anew by the bits it does not share yet, which ends because LEAST_FREE
    free bits leave few distinct codes.
    """
    if not 0 < bits < blocks:
        raise ValueError("blocks must exceed bits")
    s = Scratch(fps.sparkSession, "simhash")

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield deal(pdf["used"].to_numpy(np.int64).view(np.uint64), pdf["fp"].to_numpy(np.int64).view(np.uint64), bits, blocks)

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from search(batches, bits, group)

    rows, found, level = fps.select("fp", F.lit(0).cast("long").alias("used")), None, 0
    while found is None or not rows.isEmpty():
        groups = rows.mapInPandas(dealt, "used long, g long, fp long").repartition("used", "g").sortWithinPartitions("used", "g")
        made = s.table(groups.mapInPandas(searched, "src long, dst long, used long"), f"links{level}")
        own = made.where("src <> dst").select("src", "dst")
        found = own if found is None else found.union(own)
        rows, level = made.where("src = dst").select(F.col("src").alias("fp"), "used"), level + 1
    return found


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, bits: int = BITS, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (smallest key reachable): one row per input row.

    Null and empty texts share fingerprint 0 and are linked like any others. Rows
    with a null key are fingerprinted and linked but cannot name a component; one of
    null keys alone has a null component_id. Repeated rows stay. Copies are one
    fingerprint from the start, so a group of copies of any size costs one row.
    """
    own_columns(key, ["fingerprint", "component_id", "fp"])
    s = Scratch(df.sparkSession, "fingerprints")
    prints = s.table(fingerprints(df, key, text, words), "prints")
    distinct = s.table(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    linked = connected_components(links(distinct.select("fp"), bits, blocks, group))
    named = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(least, "c").select("fp", "component_id")
    return prints.join(named, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Similar texts: sets of distinct word shingles of Jaccard similarity SIMILARITY or more.

SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Words of a text's fingerprint, and the bits in which fingerprints of similar texts differ at most. At 0.8 two differ in 15 % of
#: their bits, with a deviation of 8 bits of 512.
WORDS, SIMILAR_BITS = 8, 104
#: Keys that deal fingerprints into groups: their number and the least hashes in one. Equal blocks of bits, as ``links`` uses,
#: cannot: 16 equal bits are shared by 7 % of the pairs at 0.8. Two texts of similarity s share a key with probability
#: 1 - (1 - s^ROWS)^BANDS: 0.9999 at 0.8.
BANDS, ROWS = 32, 6
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
MIX = [np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) % (1 << 64)) for j in range(WORDS)]
#: Fingerprints of a part, and shingles of a part; a task compares the members of two parts.
PART, PART_SHINGLES = 1024, 1 << 20
#: Groups of so few fingerprints are a single leaf of the index; the leaves of a batch are searched at once.
LEAF = 32


def shingle_set(text: str | None, words: int = SIMILAR_SHINGLE) -> np.ndarray:
    """XXH64 values of the text's distinct word shingles, sorted; words and shingles are those of ``fingerprint``."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(tokens))
    starts, ends = starts[:len(tokens) - k + 1].tolist(), ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.concatenate([np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + TURN], ends[i:i + TURN])], np.uint64) for i in range(0, len(starts), TURN)]))


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits: each bit is 1 if set in over half of a set's hashes, for the words after the first of remixed hashes."""
    total = np.zeros((WORDS, 64), np.int64)
    for i in range(0, len(own), TURN):
        h = own[i:i + TURN]
        for j in range(WORDS):
            x = h
            if j:
                x = (h ^ (h >> np.uint64(31))) * MIX[j]
                x = (x ^ (x >> np.uint64(29))) * MIX[0]
                x ^= x >> np.uint64(32)
            total[j] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(own), axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key a band from the least values of the shingles' remixed hashes; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    x, least = (own >> np.uint64(32)).astype(np.uint32), np.full(len(FACTORS), ~np.uint32(0))
    for i in range(0, len(x), 512):
        least = np.minimum(least, (x[i:i + 512, None] * FACTORS).min(0))
    g = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX[0]
    for v in least.reshape(BANDS, ROWS).T:
        g = (g ^ v.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
    return g.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def leaves(cell: np.ndarray, codes: np.ndarray, bits: int) -> np.ndarray:
    """Roots of fingerprints sorted by cell, small cells all: pairs of one cell within ``bits`` are linked."""
    root, at, step = np.arange(len(cell)), np.arange(len(cell)), 1
    while len(at := at[:np.searchsorted(at, len(cell) - step)]):
        at = at[cell[at] == cell[at + step]]
        near = at[np.bitwise_count(codes[at] ^ codes[at + step]).sum(1, dtype=np.int64) <= bits]
        root = merge(root, near, near + step)
        step += 1
    return root


def by_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole cells (g, i, j) from rows sorted by cell, many at a time; a cell is never torn."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf[["g", "i", "j"]].to_numpy(np.int64)
        last = (last == last[-1]).all(1)
        new = held and tuple(held[-1][["g", "i", "j"]].iloc[-1]) != tuple(pdf[["g", "i", "j"]].iloc[0])
        if new:
            yield pd.concat(held)
            held = []
        if not last.all():
            cut = int(np.flatnonzero(~last)[-1]) + 1
            yield pd.concat([*held, pdf.iloc[:cut]])
            held, pdf = [], pdf.iloc[cut:]
        held.append(pdf)
    if held:
        yield pd.concat(held)


def cells_of(pdf: pd.DataFrame) -> np.ndarray:
    """Number of each row's cell."""
    ids = pdf[["g", "i", "j"]].to_numpy(np.int64)
    return np.concatenate([[0], np.cumsum((np.diff(ids, axis=0) != 0).any(1))])


def forest_links(node: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    at = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"src": node[root[at]], "dst": node[at]})


def first_of(same: np.ndarray) -> np.ndarray:
    """Roots that connect the marked places."""
    root = np.arange(len(same))
    if same.any():
        root[same] = np.flatnonzero(same)[0]
    return root


def near_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forest links of fingerprints within SIMILAR_BITS, cell by cell; a cell's members ``near`` its first are connected already."""
    for pdf in by_cell(batches):
        cell, node = cells_of(pdf), pdf["node"].to_numpy(np.int64)
        codes = np.frombuffer(b"".join(pdf["code"]), np.uint64).reshape(-1, WORDS)
        near, size = pdf["near"].to_numpy(bool), np.bincount(cell)
        small = size[cell] <= LEAF
        if small.any():
            yield forest_links(node[small], leaves(cell[small], codes[small], SIMILAR_BITS))
        ends = np.cumsum(size)
        for n in np.flatnonzero(size > LEAF).tolist():
            own = slice(ends[n] - size[n], ends[n])
            index = GrayIndex(codes[own])
            yield forest_links(node[own][index.order], index.forest(SIMILAR_BITS, first_of(near[own][index.order])))


def similar_forest(sets: list[np.ndarray], codes: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Roots where the pairs of SIMILARITY or more are linked; a pair is compared unless its sizes or fingerprints rule it out or it is connected."""
    size = np.array([len(x) for x in sets])
    starts = np.cumsum(size) - size
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    have = np.zeros(len(values), bool)
    for a in range(len(sets) - 1):
        rest = np.arange(a + 1, len(sets))
        rest = rest[(root[rest] != root[a]) & (size[rest] >= SIMILARITY * size[a] - 1e-6) & (size[a] >= SIMILARITY * size[rest] - 1e-6)]
        rest = rest[np.bitwise_count(codes[rest] ^ codes[a]).sum(1, dtype=np.int64) <= SIMILAR_BITS]
        if not len(rest):
            continue
        own, step = ids[starts[a]:starts[a] + size[a]], 8
        have[own] = True
        while len(rest := rest[root[rest] != root[a]]):
            b, rest, step = rest[:step], rest[step:], min(512, 8 * step)
            ends = np.cumsum(size[b])
            at = np.arange(ends[-1]) + np.repeat(starts[b] - ends + size[b], size[b])
            both = np.add.reduceat(have[ids[at]], ends - size[b], dtype=np.int64)
            b = b[both / (size[a] + size[b] - both) >= SIMILARITY]
            if len(b):
                joined = np.unique(root[np.append(b, a)])
                root[np.isin(root, joined)] = joined[0]
        have[own] = False
    return root


def near_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forest links of similar sets, cell by cell."""
    for pdf in by_cell(batches):
        cell, node = cells_of(pdf), pdf["node"].to_numpy(np.int64)
        codes = np.frombuffer(b"".join(pdf["code"]), np.uint64).reshape(-1, WORDS)
        near, own = pdf["near"].to_numpy(bool), pdf["own"].tolist()
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                sets = [np.frombuffer(x, np.uint64) for x in own[a:b]]
                yield forest_links(node[a:b], similar_forest(sets, codes[a:b], first_of(near[a:b])))


def in_cells(rows: DataFrame) -> DataFrame:
    """Rows (g, node, near, weight and more) dealt into cells (g, i, j), sorted by cell within partitions.

    ``weight`` is the share of a part that a row takes up. A group of one part is one cell.
    In a larger group, members ``near`` the leader are connected with it, so pairs are open only
    where one side is not: part i of those meets part j of all. Every open pair meets in a cell, and
    a group whose members are all near its leader has none.
    """
    sizes = rows.groupBy("g").agg(F.ceil(F.sum("weight")).cast("int").alias("parts"), F.ceil(F.sum(F.when(~F.col("near"), F.col("weight")).otherwise(0))).cast("int").alias("open"))
    rows = rows.join(sizes, "g").where("open > 0")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    rows = rows.withColumn("own_i", place("open")).withColumn("own_j", place("parts"))
    as_any = F.transform(F.sequence(F.lit(0), F.col("open") - 1), lambda i: F.struct(i.alias("i"), F.col("own_j").alias("j")))
    as_open = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("own_j")), lambda j: F.struct(F.col("own_i").alias("i"), j.alias("j")))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("near"), as_any).otherwise(F.concat(as_any, as_open))))
    return rows.select("*", "cell.i", "cell.j").drop("cell", "own_i", "own_j", "parts", "open", "weight").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two numbers."""
    import xxhash

    return np.array([[(d := xxhash.xxh3_128_intdigest(x.tobytes())) >> 64, d & ((1 << 64) - 1)] for x in sets], np.uint64).reshape(-1, 2).view(np.int64)


def similar_classes(df: DataFrame, s: Scratch, key: str, text: str, group: int) -> tuple[DataFrame, DataFrame]:
    """Rows (k, h0, h1) with the name of their set, and classes (h0, h1, least, c): equal sets, their least key, and the number of the component of similar sets."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t) for t in pdf["t"]]
        names = set_names(sets)
        return pd.DataFrame({"k": pdf["k"], "h0": names[:, 0], "h1": names[:, 1], "n": [len(x) for x in sets],
                             "bands": [band_keys(x) for x in sets], "code": [wide_fingerprint(x).tobytes() for x in sets]})

    texts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = s.table(map_rows(texts, f"k {kind}, h0 long, h1 long, n long, bands array<long>, code binary", run), "rows")
    # a class is one set whatever keys it has, so its number comes from neither
    classes = s.table(rows.groupBy("h0", "h1").agg(
        F.min("k").alias("least"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("code").alias("code")).withColumn("node", F.monotonically_increasing_id()), "classes")
    code = classes.select("node", "code")

    # groups: keys that two classes or more share, each with the code of its least node, the leader
    met = classes.select("node", F.explode("bands").alias("g"))
    shared = met.groupBy("g").agg(F.min("node").alias("leader"), F.count("*").alias("many")).where("many > 1")
    member = s.table(met.join(shared, "g").join(code, "node"), "members")
    large = member.where(F.col("many") > group)
    lead = large.where("node = leader").select("g", F.col("code").alias("lead"))

    def to_leader(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.frombuffer(b"".join(pdf[c]), np.uint64).reshape(-1, WORDS) for c in ("code", "lead"))
        return pdf[["g", "node", "leader", "code"]].assign(near=np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= SIMILAR_BITS)

    led = s.table(map_rows(large.join(lead, "g").select("g", "node", "leader", "code", "lead"), "g long, node long, leader long, code binary, near boolean", to_leader), "led")
    every = member.where(F.col("many") <= group).select("g", "node", "code", F.lit(False).alias("near"), F.lit(1e-9).alias("weight")).union(
        led.select("g", "node", "code", "near", F.lit(1 / group)))
    links = s.table(in_cells(every).mapInPandas(near_codes, "src long, dst long"), "near")
    links = links.union(led.where("near and node <> leader").select(F.col("leader").alias("src"), F.col("node").alias("dst")))

    # families: whole sets of their members
    family = s.table(connected_components(links).select("node", F.col("component").alias("g")), "families")
    weights = family.join(classes.select("node", "least", "h0", "h1", "n", "code"), "node").withColumn("weight", F.greatest(F.lit(1 / group), F.col("n") / PART_SHINGLES))
    heavy = weights.groupBy("g").agg((F.sum("weight") > 1).alias("heavy"))
    weights = weights.join(heavy, "g").select("node", "least", "h0", "h1", "g", "code", "weight", "heavy")
    # merged at every size: the families grow with the documents; repeated rows are read once
    whole = texts.join(weights.hint("merge"), F.col("k") == F.col("least")).dropDuplicates(["least", "node", "t"]).select("node", "h0", "h1", "g", "code", "weight", "heavy", "t")

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t) for t in pdf["t"]]
        # a key may have other texts too
        own = (set_names(sets) == pdf[["h0", "h1"]].to_numpy()).all(1)
        return pdf[["node", "g", "code", "weight", "heavy"]].assign(own=[x.tobytes() for x in sets])[own]

    # nor is a set that several texts of one key have compared twice
    sets = s.table(map_rows(whole, "node long, g long, code binary, weight double, heavy boolean, own binary", again).dropDuplicates(["node"]), "sets")
    large = sets.where("heavy")
    lead = large.where("node = g").select("g", F.col("own").alias("lead"))

    def by_set(pdf: pd.DataFrame) -> pd.DataFrame:
        near = [jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= SIMILARITY for a, b in zip(pdf["own"], pdf["lead"])]
        return pdf[["g", "node"]].assign(near=near)

    # the leader's set is on every row only while a task reads it
    led = s.table(map_rows(large.join(lead, "g").select("g", "node", "own", "lead"), "g long, node long, near boolean", by_set), "led_sets")
    every = sets.where("not heavy").select("g", "node", "code", "own", F.lit(False).alias("near"), F.lit(1e-9).alias("weight")).union(
        large.join(led, ["g", "node"]).select("g", "node", "code", "own", "near", "weight"))
    found = s.table(in_cells(every).mapInPandas(near_sets, "src long, dst long"), "links")
    found = found.union(led.where("near and node <> g").select(F.col("g").alias("src"), F.col("node").alias("dst")))
    linked = connected_components(found)
    return rows.select("k", "h0", "h1"), classes.select("h0", "h1", "least", "node").join(linked, "node", "left").select("h0", "h1", "least", F.coalesce("component", "node").alias("c"))


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", group: int = PART) -> DataFrame:
    """key, component_id (smallest key reachable): texts linked where their sets of five-word shingles have Jaccard similarity 0.8.

    Texts that share a key of least hashes are a group. Each group's fingerprints are searched
    by the Gray-order index for pairs within SIMILAR_BITS; what is linked so, directly or
    through others, is a family. Within a family pairs are compared on whole shingle sets,
    and only those of 0.8 or more are linked. In a group of over ``group`` texts, and in a
    family of over ``group`` texts or PART_SHINGLES shingles, all members first meet the
    leader, and the pairs that this leaves open meet in cells of two parts, each a task's
    work; so no group is too large and none is cut short. Equal sets are one from the start.
    Texts without words are equal. A key may be of any ordered type; with several texts it has a
    row of each, linked each for itself. Rows with a null key link with nothing and have a null
    component_id.
    """
    own_columns(key, ["component_id"])
    rows, classes = similar_classes(df, Scratch(df.sparkSession, "similar"), key, text, group)
    named = classes.join(classes.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("h0", "h1", "component_id")
    return rows.join(named, ["h0", "h1"]).select(F.col("k").alias(key), "component_id").union(
        df.where(F.col(key).isNull()).select(F.col(key), F.lit(None).cast(df.schema[key].dataType)))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", group: int = PART) -> DataFrame:
    """Of similar documents the one of least key, all columns as they are.

    Of several texts of that key in one component the one first by the name of its set stays, and
    of repeated rows of it one, the first by a hash of all its columns; other texts of the key are
    documents of their own. Rows with a null key cannot be told apart by it and stay.
    """
    s = Scratch(df.sparkSession, "kept")
    rows, classes = similar_classes(df, s, key, text, group)
    first = classes.groupBy("c").agg(F.min(F.struct("least", "h0", "h1")).alias("f")).select(F.col("f.least").alias("k"), "f.h0", "f.h1")
    found = s.table(first, "found")
    # merged at every size: the keys grow with the documents
    kept = df.join(found.select(F.col("k").alias(key)).distinct().hint("merge"), key, "left_semi").select(df.columns)
    again = s.table(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").join(found.select("k").distinct(), "k", "left_semi").select(F.col("k").alias(key)), "again")
    if not again.isEmpty():
        kept = kept.join(again, key, "left_anti").select(df.columns).union(_first_rows(kept.join(again, key, "left_semi").select(df.columns), found, key, text))
    return kept.union(df.where(F.col(key).isNull()))


def _first_rows(rows: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """Of rows of keys that come again, one of each (k, h0, h1) found."""
    kind = rows.schema[key].dataType.simpleString()

    def names(pdf: pd.DataFrame) -> pd.DataFrame:
        made = set_names([shingle_set(t) for t in pdf["t"]])
        return pd.DataFrame({"k": pdf["k"], "th": pdf["th"], "h0": made[:, 0], "h1": made[:, 1]})

    plain = [c for c, t in rows.dtypes if not t.startswith("map")]
    row = F.struct(*rows.columns)
    each = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("th"), F.xxhash64(*plain).alias("rh"), row.alias("row"))
    named = map_rows(each.select("k", "th", "t").dropDuplicates(["k", "th"]), f"k {kind}, th long, h0 long, h1 long", names)
    named = named.join(found, ["k", "h0", "h1"], "left_semi")
    return each.join(named, ["k", "th"]).groupBy("k", "h0", "h1").agg(F.min_by("row", "rh").alias("row")).select("row.*")
