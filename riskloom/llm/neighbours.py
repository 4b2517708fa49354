"""Nearest neighbours by inner product with a permutation index.

A vector is represented by its nearest pivots in order. It is posted, with that order,
in the inverted files of the first of them; a query visits the files of its own first
pivots. There the files' vectors are ranked by footrule distance, the sum over pivots
of the differences of their places in both orders, and those near enough are compared
exactly, in double precision. Pivots are rows of a bounded sample, more of them for
more rows, so files follow the density of the data. How many files a query visits and
the footrule distance up to which vectors are compared are measured on the sample for a
wanted recall. Files of pivots near each other share a cell, and a cell of many vectors
is split into parts, which every visiting query meets.

Inner products become distances by one more coordinate, which brings all vectors to
one norm and is zero in queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..scratch import Scratch
from .common import bounded_batches, own_columns

NEAREST, EVERY, RECALL = 20, 20, 0.97
#: Rows that a model is fitted on and dimensions that get one; vectors of rarer dimensions form one file each. Bounds of what is broadcast.
SAMPLE, ASKING, DIMENSIONS = 4096, 512, 16
#: Places of an order that count, files in which a vector is posted, vectors of a part, queries compared at once.
PLACES, POSTED, PART, AT_ONCE = 32, 2, 4096, 256
SEED = 20250311


@dataclass
class Index:
    """What one dimension's vectors are indexed by. ``cell``: of each pivot; ``asked``: files a query visits; ``limit``: footrule."""

    pivots: np.ndarray
    cell: np.ndarray
    asked: int
    limit: int
    norm: float
    sample: np.ndarray

    @property
    def places(self) -> int:
        return min(PLACES, len(self.pivots))

    def orders(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Numbers of the nearest pivots, in order (ties: smaller number): all of a query's, the first ``places`` of another's."""
        near = lifted(vectors, self.norm, query) @ lifted(self.pivots, self.norm, False).T
        order = np.argsort(-near, axis=1, kind="stable")
        return order if query else order[:, :max(self.places, POSTED)]


def lifted(vectors: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Vectors of that norm: others by a further coordinate, queries by scale."""
    own = np.sqrt((vectors * vectors).sum(1))
    if query:
        return np.hstack([vectors / np.maximum(own, 1e-300)[:, None] * norm, np.zeros((len(vectors), 1))])
    return np.hstack([vectors, np.sqrt(np.maximum(0, norm * norm - own * own))[:, None]])


def places_of(orders: np.ndarray, pivots: int, places: int) -> np.ndarray:
    """(pivot, vector): the pivot's place in the vector's order, ``places`` where it is further back."""
    out = np.full((pivots, len(orders)), places, np.int8)
    for i in range(places):
        out[orders[:, i], np.arange(len(orders))] = i
    return out


def footrule(places: np.ndarray, order: np.ndarray, many: int) -> np.ndarray:
    """Footrule distances of one order to all columns of places_of(); pivots further back count as at place ``many``."""
    order = order[:many]
    own = places[order]
    shared = own < many
    moved = np.abs(own - np.arange(many, dtype=np.int8)[:, None])
    # both orders without each other, less what the shared pivots save
    saved = np.where(shared, (many - np.arange(many, dtype=np.int16))[:, None] + (many - own) - moved, 0)
    return many * (many + 1) - saved.sum(0, dtype=np.int32)


def scale(vectors: np.ndarray) -> np.ndarray:
    """Doubles whose squares cannot overflow; the index alone uses them."""
    return np.clip(np.asarray(vectors, np.float64), -1e100, 1e100)


def fit(sample: np.ndarray, rows: int, recall: float = RECALL, nearest: int = NEAREST) -> Index:
    """The index of about ``rows`` vectors from a sample of them: pivots, and how far a query has to look."""
    sample = scale(sample)
    rng = np.random.default_rng((SEED, len(sample)))
    many = min(len(sample), 1 << max(4, math.ceil(math.log2(math.sqrt(max(1, rows))))))
    norm = float(np.sqrt((sample * sample).sum(1)).max())
    index = Index(sample[np.sort(rng.permutation(len(sample))[:many])], np.zeros(many, np.int64), many, 0, norm, sample)
    # a walk to the nearest pivot not met yet brings those near each other together
    walk, left, at = [], np.ones(many, bool), 0
    close = index.pivots @ index.pivots.T
    for _ in range(many):
        walk.append(at)
        left[at] = False
        at = int(np.argmax(np.where(left, close[at], -np.inf)))
    wide = max(1, min(many, round(PART * many / (POSTED * max(1, rows)))))
    index.cell[walk] = np.arange(many) // wide
    asking = rng.permutation(len(sample))[:ASKING]
    score = sample[asking] @ sample.T
    score[np.arange(len(asking)), asking] = -np.inf
    # so many of the sample are what ``nearest`` are of all rows, or farther
    k = max(1, min(len(sample) - 1, round(nearest * len(sample) / max(1, rows))))
    if len(sample) < 2:
        return index
    true = np.argsort(-score, axis=1, kind="stable")[:, :k]
    orders, asked = index.orders(sample, False), index.orders(sample[asking], True)
    place = np.empty_like(asked)
    np.put_along_axis(place, asked, np.arange(many)[None, :].repeat(len(asked), 0), 1)
    best = np.stack([place[i][orders[true[i]][:, :POSTED]].min(1) for i in range(len(asking))])
    index.asked = int(np.quantile(best, recall, method="higher")) + 1
    there = places_of(orders, many, index.places)
    far = np.stack([footrule(there, asked[i], index.places)[true[i]] for i in range(len(asking))])
    index.limit = int(np.quantile(far, recall, method="higher"))
    return index


def sound(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def fitted(classes: DataFrame, sizes: dict[int, int], recall: float, nearest: int) -> dict[int, Index]:
    """An index for each of the commonest dimensions, from the rows first by hash."""
    most = sorted(sizes, key=lambda d: (-sizes[d], d))[:DIMENSIONS]
    first = Window.partitionBy("dim").orderBy("h", "least")
    taken = classes.where(F.col("dim").isin(most)).select("dim", "h", "least", "v").withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE)
    held: dict[int, list] = {}
    for r in taken.select("dim", "r", F.col("v").cast("array<double>").alias("v")).sort("dim", "r").toLocalIterator():
        held.setdefault(r["dim"], []).append(r["v"])
    return {d: fit(np.array(x), sizes[d], recall, nearest) for d, x in held.items()}


def posted(rows: DataFrame, indexes, nearest: int, ask: str | None = None) -> DataFrame:
    """(dim, cell, rep, least, v, code, bound): rows at the cells of their files; queries, ``ask``, at those of the "near" or of "all" files.

    A near query's bound is a score that as many rows reach as are wanted: those of the sample.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                index, n = indexes.value.get(dim), len(own)
                bound, codes, cells = np.full(n, -np.inf), [b""] * n, [np.zeros(1, np.int32)] * n
                if index is not None:
                    v = np.stack(own["v"].to_numpy()).astype(np.float64)
                    orders = index.orders(scale(v), ask is not None)
                    codes = [c.tobytes() for c in orders[:, :index.places].astype(np.uint16)]
                    visited = {None: POSTED, "near": index.asked, "all": len(index.cell)}[ask]
                    cells = [np.unique(c).astype(np.int32) for c in index.cell[orders[:, :visited]]]
                    if ask == "near" and len(index.sample) > nearest:
                        # one more than wanted, as the query may be of the sample; scores made there may differ in their last bits
                        scores = scale(v) @ index.sample.T
                        bound = np.partition(scores, -nearest - 1, axis=1)[:, -nearest - 1] - 1e-9 * np.sqrt((scale(v) ** 2).sum(1)) * index.norm
                yield pd.DataFrame({"dim": dim, "cells": cells, "rep": own["rep"].to_numpy(), "least": own["least"].to_numpy(), "v": own["v"].to_numpy(), "code": codes, "bound": bound})

    kind = rows.schema["v"].dataType.simpleString()
    made = rows.select("dim", "rep", "least", "v").mapInPandas(run, f"dim int, cells array<int>, rep long, least long, v {kind}, code binary, bound double")
    return made.select("dim", F.explode("cells").alias("cell"), "rep", "least", "v", "code", "bound")


def search_cells(batches: Iterator[pd.DataFrame], indexes, keep: int, whole: bool) -> Iterator[pd.DataFrame]:
    """Nearest of each part's vectors to each query, from rows sorted by part, vectors before queries."""
    name, vectors, queries = None, [], []
    index = there = base = rep = least = None

    def answered() -> Iterator[pd.DataFrame]:
        nonlocal queries
        rows = pd.concat(queries)
        queries = []
        asking = np.stack(rows["v"].to_numpy()).astype(np.float64)
        out_q, out_v, out_s = [], [], []
        for q, code, bound, own in zip(asking, rows["code"], rows["bound"].to_numpy(), rows["rep"].to_numpy()):
            if index is None or whole:
                near = np.arange(len(rep))
            else:
                near = np.flatnonzero(footrule(there, np.frombuffer(code, np.uint16), index.places) <= index.limit)
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.einsum("ij,j->i", base[near], q)
            some = np.flatnonzero((score >= bound) | np.isnan(score) | (bound == -np.inf))
            if len(some) > keep:
                some = some[np.lexsort((least[near[some]], -score[some]))[:keep]]
            out_q.append(np.full(len(some), own))
            out_v.append(rep[near[some]])
            out_s.append(score[some])
        yield pd.DataFrame({"q": np.concatenate(out_q), "c": np.concatenate(out_v), "score": np.concatenate(out_s)})

    for pdf in batches:
        parts = list(zip(pdf["dim"], pdf["cell"], pdf["part"], pdf["query"]))
        cuts = [0, *(k for k in range(1, len(parts)) if parts[k] != parts[k - 1]), len(parts)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            own = pdf.iloc[a:b]
            if name != parts[a][:3]:
                if queries:
                    yield from answered()
                name, vectors, base = parts[a][:3], [], None
            if not parts[a][3]:
                vectors.append(own)
                continue
            if base is None:
                if not vectors:
                    continue  # a file without vectors
                held = pd.concat(vectors)
                index, rep, least = indexes.value.get(name[0]), held["rep"].to_numpy(), held["least"].to_numpy()
                base = np.stack(held["v"].to_numpy()).astype(np.float64)
                if index is not None and not whole:
                    orders = np.stack([np.frombuffer(c, np.uint16) for c in held["code"]]).astype(np.int64)
                    there = places_of(orders, len(index.pivots), index.places)
            for i in range(0, len(own), AT_ONCE):
                queries.append(own.iloc[i:i + AT_ONCE])
                if sum(map(len, queries)) >= AT_ONCE:
                    yield from answered()
    if queries:
        yield from answered()


def found_in_cells(files: DataFrame, queries: DataFrame, indexes, keep: int, whole: bool = False) -> DataFrame:
    """(q, c, score) of pairs met in the cells, at most ``keep`` a query and part. ``files``, ``queries``: of posted()."""
    parts = files.groupBy("dim", "cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # a row a cell, of which the pivots bound the number
    parts = F.broadcast(parts)
    dealt = files.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("query", F.lit(0))
    asked = queries.join(parts, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("query", F.lit(1))
    columns = ["dim", "cell", "part", "query", "rep", "least", "v", "code", "bound"]
    both = dealt.select(columns).union(asked.select(columns)).repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "query")
    return both.mapInPandas(lambda b: search_cells(b, indexes, keep, whole), "q long, c long, score double")


def nearest_neighbours(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, nearest: int = NEAREST, recall: float = RECALL) -> DataFrame:
    """query_id, rank, key, score: the nearest rows found of each row whose key ``every`` divides.

    Nearness is the largest inner product in double precision, ties to the smaller key; the row
    itself is no candidate, rows of another length neither. Vectors that are null, empty, zero, or
    hold null or non-finite components take no part, nor do rows of null keys; an empty table gives
    no rows. Equal vectors are searched once and each counts with its own key; repeated rows ask again
    but are one candidate, and a key with several vectors asks with each and is no candidate of its own. If there are fewer candidates than
    wanted, all are returned: a query that has met too few is compared with all rows, part by part.
    Inner products that overflow count as the infinities they become, undefined ones as the least.
    """
    own_columns(key, ["query_id", "rank", "score"])
    spark = df.sparkSession
    s = Scratch(spark, "neighbours")
    bounded_batches(df)
    # a row more than is wanted, as the query's own may be among them
    keep = nearest + 1
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & sound(F.col(vector).cast("array<double>")))
    rows = s.table(rows.withColumns({"h": F.xxhash64("v"), "dim": F.size("v")}), "rows")
    # of equal vectors only the first keys can be among the nearest, and the window has each task pass on no more
    first = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= keep)
    classes = first.groupBy("h", "v", "dim").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes = s.table(classes.withColumns({"rep": F.monotonically_increasing_id(), "least": F.col("ids")[0]}), "classes")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    if not sizes:
        return df.sparkSession.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    indexes = spark.sparkContext.broadcast(fitted(classes, sizes, recall, nearest))
    asking = s.table(rows.where(F.col("id") % every == 0).join(classes.select("h", "v", "rep"), ["h", "v"]).select("id", "rep"), "asking")
    queries = classes.join(asking.select("rep").distinct(), "rep", "left_semi")
    files = s.table(posted(classes, indexes, nearest), "files")
    met = found_in_cells(files, posted(queries, indexes, nearest, "near"), indexes, keep)
    # a query's own vector is compared with itself whatever it visits
    own = queries.select(F.col("rep").alias("q"), F.col("rep").alias("c"), F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x).alias("score"))
    best = s.table(_best(met.union(own), classes, keep), "best")
    there = rows.groupBy("dim").agg(F.least(F.count("*"), F.lit(keep)).alias("there"))
    short = queries.join(best.select(F.col("q").alias("rep"), F.size("found").alias("n")), "rep").join(F.broadcast(there), "dim").where("n < there").select(*classes.columns)
    short = s.table(short, "short")
    if not short.isEmpty():
        more = found_in_cells(files, posted(short, indexes, nearest, "all"), indexes, keep, True)
        best = best.join(short.select(F.col("rep").alias("q")), "q", "left_anti").unionByName(_best(more, classes, keep))
    answers = asking.join(best.withColumnRenamed("q", "rep"), "rep").select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, nearest).alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(key), F.col("x.score").alias("score"))


def _best(met: DataFrame, classes: DataFrame, keep: int) -> DataFrame:
    """(q, found): of each query class the ``keep`` first rows (id, score) by score, then key. ``met``: (q, c, score), pairs may come again."""
    value = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    pairs = met.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("o", value)
    by = Window.partitionBy("q").orderBy(F.desc("o"), F.col("least"))
    ids = classes.select(F.col("rep").alias("c"), "ids", "least")
    some = pairs.join(ids, "c").withColumn("r", F.row_number().over(by)).where(F.col("r") <= keep)
    each = some.select("q", "score", "o", F.explode("ids").alias("id"))
    rank = Window.partitionBy("q").orderBy(F.desc("o"), F.col("id"))
    rows = each.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= keep)
    listed = F.array_sort(F.collect_list(F.struct("r", "id", "score")))
    return rows.groupBy("q").agg(F.transform(listed, lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("found"))


def oracle(every: int = EVERY, nearest: int = NEAREST) -> str:
    """DuckDB SQL of the nearest rows of ``embeddings`` by all pairs; the index finds what it was fitted for, on few rows all of them."""
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) AS score FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % {every} = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p) WHERE r <= {nearest}"""
