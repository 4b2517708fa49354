"""Embedding near-duplicates with randomised-rotation binary codes.

A unit vector is rotated at random and stored as the signs of its coordinates,
with the factor f = <code, vector> that makes <code, query> / f an unbiased estimate
of their inner product. The estimate's error for a pair at the threshold has a
known scale, so a confidence bound drops pairs and only the rest are
recomputed exactly, in double precision. Pairs meet in the groups of several hash
tables made of the signs of further random projections; their number follows the
count of vectors and the wanted recall. A pair counts in the first table in which
it meets. Groups too large for a task are cut into cells, each a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..scratch import Scratch
from .common import bounded_batches, own_columns
from .simhash import merge

COSINE, RECALL = 0.95, 0.995
SEED = 20240917
#: Wanted vectors in a group; a group over CELL is cut into cells of two parts of PART vectors.
GROUP, CELL, PART = 64, 4096, 1024
#: Deviations of the estimate's error within which a pair is recomputed.
DEVIATIONS = 4.5


@lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine; made once a worker, as every cell needs it."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(4)
def planes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim, count)).standard_normal((dim, count))


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Signs in a key and number of tables for n vectors."""
    signs = max(4, min(31, math.ceil(math.log2(max(2, n) / GROUP))))
    agree = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes and correction factors of unit vectors."""
    turned = vectors @ rotation(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / math.sqrt(vectors.shape[1])


def normed(vectors: pd.Series) -> np.ndarray:
    """Unit vectors in double precision, whatever their scale."""
    raw = np.stack(vectors.to_numpy()).astype(np.float64)
    raw /= np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def close_pairs(unit: np.ndarray, code: np.ndarray, factor: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (left, right) with cosine at the threshold or above, in blocks."""
    dim = unit.shape[1]
    turned = (unit @ rotation(dim)).astype(np.float32)
    signs = np.unpackbits(code[right], axis=1, count=dim).astype(np.float32) * 2 - 1
    signs /= (math.sqrt(dim) * factor[right, None]).astype(np.float32)
    slack = DEVIATIONS * math.sqrt(1 - cosine * cosine) * np.sqrt(np.maximum(0, 1 - factor[right] ** 2)) / factor[right] / math.sqrt(max(1, dim - 1)) + 1e-4
    floor = (cosine - slack).astype(np.float32)
    for i in range(0, len(left), 512):
        a, b = np.nonzero(turned[left[i:i + 512]] @ signs.T >= floor)
        a, b = left[a + i], right[b]
        own = a < b if left is right else a != b
        a, b = a[own], b[own]
        for j in range(0, len(a), 1 << 18):
            x, y = a[j:j + (1 << 18)], b[j:j + (1 << 18)]
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
            if near.any():
                yield x[near], y[near]


def in_cells(batches: Iterator[pd.DataFrame], cosine: float) -> Iterator[pd.DataFrame]:
    """Links of each cell from rows sorted by cell: per vector its count (other = null) and a forest of links."""
    held: list[pd.DataFrame] = []

    def ended() -> Iterator[pd.DataFrame]:
        cell = pd.concat(held) if len(held) > 1 else held[0]
        if len(cell) < 2:
            return
        unit = normed(cell["v"])
        code = np.stack([np.frombuffer(c, np.uint8) for c in cell["code"]])
        factor, keys, weight = cell["factor"].to_numpy(), np.stack(cell["keys"].to_numpy()), cell["copies"].to_numpy()
        part, t = cell["part"].to_numpy(), int(cell["t"].iloc[0])
        i, j = int(cell["i"].iloc[0]), int(cell["j"].iloc[0])
        left = np.flatnonzero(part == i)
        right = left if i == j else np.flatnonzero(part == j)
        count, root = np.zeros(len(cell), np.int64), np.arange(len(cell))
        for a, b in close_pairs(unit, code, factor, left, right, cosine):
            new = ~(keys[a, :t] == keys[b, :t]).any(1)
            a, b = a[new], b[new]
            count += np.bincount(a, weight[b], len(cell)).astype(np.int64) + np.bincount(b, weight[a], len(cell)).astype(np.int64)
            root = merge(root, a, b)
        rep = cell["rep"].to_numpy()
        own, tied = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(root)))
        if len(own):
            yield pd.DataFrame({"rep": np.concatenate([rep[own], rep[tied]]), "links": np.concatenate([count[own], np.zeros(len(tied), np.int64)]),
                                "other": pd.array([None] * len(own) + rep[root[tied]].tolist(), "Int64")})

    name = None
    for pdf in batches:
        ids = list(zip(pdf["dim"], pdf["t"], pdf["key"], pdf["i"], pdf["j"]))
        cuts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if name != ids[a]:
                if held:
                    yield from ended()
                held, name = [], ids[a]
            held.append(pdf.iloc[a:b])
    if held:
        yield from ended()


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """key, n_links, component_id, kept: one row per input row.

    n_links counts other rows linked directly, component_id is the smallest key
    reachable, kept marks the row that names its component. Vectors that are null,
    zero, empty, or hold null or non-finite components link with nothing; vectors of
    different length do not link; a row with a null key links with nothing, has a
    null component_id and is not kept. Equal vectors are one class from the start
    (repeated rows included): it enters the search once with its number of copies.
    Rows that share a key but not a vector are one node of the graph.
    """
    own_columns(key, ["n_links", "component_id", "kept"])
    spark = df.sparkSession
    s = Scratch(spark, "embeddings")
    bounded_batches(df)
    v = F.col(vector).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), F.when(F.coalesce(sound, F.lit(False)) & F.col(key).isNotNull(), F.col(vector)).alias("v"))
    rows = rows.withColumn("h", F.xxhash64("v"))
    classes = s.table(rows.where("v is not null").groupBy("h", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    signs, many = plan(classes.count(), cosine, recall)
    # shipped as they came, in single precision where they are: doubles would be twice the shuffle
    kind = df.schema[vector].dataType.simpleString()

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby(pdf["v"].map(len)):
                unit = normed(own["v"])
                code, factor = encode(unit)
                bits = (unit @ planes(dim, signs * many) > 0).reshape(len(own), many, signs)
                keys = (bits << np.arange(signs)).sum(2)
                yield pd.DataFrame({"rep": own["rep"].to_numpy(), "copies": own["copies"].to_numpy(), "dim": dim, "v": own["v"].to_numpy(), "code": [c.tobytes() for c in code], "factor": factor, "keys": list(keys)})

    codes = s.table(classes.mapInPandas(coded, f"rep long, copies long, dim int, v {kind}, code binary, factor double, keys array<int>"), "codes")
    met = codes.select("dim", F.posexplode("keys").alias("t", "key"))
    large = s.table(met.groupBy("dim", "t", "key").count().where(F.col("count") > CELL).select("dim", "t", "key", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "large")
    dealt = codes.select("*", F.posexplode("keys").alias("t", "key")).join(large, ["dim", "t", "key"], "left")
    parts = F.coalesce("parts", F.lit(1))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn(
        "cell", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.struct(F.least("part", x).alias("i"), F.greatest("part", x).alias("j")))))
    dealt = dealt.select("dim", "t", "key", "cell.i", "cell.j", "part", "rep", "copies", "v", "code", "factor", "keys")
    cells = dealt.repartition("dim", "t", "key", "i", "j").sortWithinPartitions("dim", "t", "key", "i", "j")
    found = s.table(cells.mapInPandas(lambda b: in_cells(b, cosine), "rep long, links long, other long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tied = connected_components(found.where("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    named = classes.select("h", "v", "rep", "copies").join(links, "rep", "left").join(tied.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.where("v is not null").join(named, ["h", "v"]).select("id", "n", "c").union(
        rows.where("v is null").select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(False)).alias("kept"))


def oracle(cosine: float = COSINE) -> str:
    """DuckDB SQL of near_duplicates() over ``embeddings``, by all pairs."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
r(x, y) AS (SELECT a, b FROM p UNION SELECT r.x, p.b FROM r JOIN p ON r.y = p.a),
c AS (SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links, coalesce((SELECT min(y) FROM r WHERE r.x = v.vec_id), v.vec_id) AS component_id FROM v)
SELECT vec_id, n_links, least(vec_id, component_id) AS component_id, vec_id <= component_id AS kept FROM c"""
