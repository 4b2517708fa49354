"""Best-fit packing into bins of several permitted capacities.

The histogram of piece lengths has at most as many entries as the largest capacity
has tokens, whatever the corpus, so best-fit decreasing runs on it once: bins
with the same room form a class that is filled as one. A new bin takes the capacity
whose cost per token is least, room that shorter pieces can fill counting as
filled; in the end each bin shrinks to the smallest capacity that holds
its contents. The plan says which ranks of each length go where; every piece then
finds its place from its rank within its length, which needs no global order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import Scratch
from .common import bounded_batches, own_columns

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Tokens that a bin costs beside its capacity.
OVERHEAD = 8
#: Pieces of one length that are ranked in one task, about.
RUN = 200_000


@dataclass
class Plan:
    """Placements (length, first rank, ranks, pieces a bin, first bin, offset) and bin classes (first bin, capacity)."""

    places: np.ndarray
    bins: np.ndarray


def fill(room: int, lengths: list[int], below: int) -> int:
    """Tokens of ``room`` that pieces shorter than ``below`` fill when the longest that fits is taken again and again."""
    got = 0
    top = bisect_left(lengths, below)
    while room > got:
        i = min(top, bisect_right(lengths, room - got)) - 1
        if i < 0:
            break
        got += (room - got) // lengths[i] * lengths[i]
    return got


def solve(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD) -> Plan:
    """Best-fit decreasing over lengths with counts; every length is between 1 and the largest capacity."""
    caps = sorted(capacities)
    lengths = sorted(histogram)
    rooms: list[int] = []  # with an open class, ascending
    classes: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, used)
    places: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(room: int, first: int, many: int, used: int) -> None:
        if many:
            if room not in classes:
                classes[room] = []
                insort(rooms, room)
            classes[room].append((first, many, used))

    for length in reversed(lengths):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many, used = classes[room].pop()
                if not classes[room]:
                    del classes[room]
                    rooms.pop(at)
            else:
                def cost(c: int) -> tuple[float, int]:
                    held = min(left, c // length) * length
                    held += fill(c - held, lengths, length)
                    return (next(x for x in caps if x >= held) + overhead) / held, -c

                room = min((c for c in caps if c >= length), key=cost)
                first, many, used = bins, -(-left // (room // length)), 0
                bins += many
            each = room // length
            full = min(many, left // each)
            if full:
                places.append((length, rank, full * each, each, first, used))
                put(room - each * length, first, full, used + each * length)
                rank, left = rank + full * each, left - full * each
            rest = min(left, each) if full < many else 0
            if rest:
                places.append((length, rank, rest, rest, first + full, used))
                put(room - rest * length, first + full, 1, used + rest * length)
                rank, left = rank + rest, left - rest
            done = full + bool(rest)
            put(room, first + done, many - done, used)
    sized = sorted((first, next(c for c in caps if c >= used)) for own in classes.values() for first, _, used in own)
    return Plan(np.array(places, np.int64).reshape(-1, 6), np.array(sized, np.int64).reshape(-1, 2))


def words(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0))


def pack(df: DataFrame, key: str = "doc_id", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD) -> DataFrame:
    """key, piece, n_tokens, bin_id, capacity, offset: one row per piece of every input row.

    ``length`` is a row's tokens, by default the words of ``text`` and one for the
    end of the document; null or less than 1 counts as 1. A row longer than the
    largest capacity is cut into full pieces and a rest, numbered from 0. Rows of
    null or repeated keys are packed like any others. Equal lengths take ranks by
    key and piece, so ties are settled alike in every run. No bin holds more than
    its capacity and nothing is dropped; an empty table gives an empty result.
    """
    own_columns(key, ["piece", "n_tokens", "bin_id", "capacity", "offset"])
    spark = df.sparkSession
    s = Scratch(spark, "packing")
    bounded_batches(df)
    largest = max(capacities)
    length = words(F.col("text")) + 1 if length is None else length
    rows = df.select(F.col(key).alias("k"), F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long").alias("n"))
    cuts = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / largest).cast("long"))
    pieces = rows.select("k", "n", F.explode(cuts).alias("piece")).select(
        "k", "piece", F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).cast("int").alias("len"))
    pieces = s.table(pieces, "pieces")
    counts = {r["len"]: r["count"] for r in pieces.groupBy("len").count().collect()}  # at most ``largest`` rows
    plan = solve(counts, capacities, overhead)
    runs = max(16, -(-max(counts.values(), default=0) // RUN))
    pieces = pieces.withColumn("run", F.pmod(F.xxhash64("k", "piece"), F.lit(runs)).cast("int"))
    before = Window.partitionBy("len").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("len", "run").count().select("len", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    ranked = pieces.withColumn("i", F.row_number().over(Window.partitionBy("len", "run").orderBy("k", "piece"))).join(
        starts, ["len", "run"]).select("k", "piece", "len", (F.col("start") + F.col("i") - 1).alias("rank"))
    places = plan.places[np.lexsort((plan.places[:, 1], plan.places[:, 0]))]
    where = (places[:, 0] << 44) + places[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            own, rank = pdf["len"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            p = places[np.searchsorted(where, (own << 44) + rank, "right") - 1]
            i = rank - p[:, 1]
            bin_id = p[:, 4] + i // p[:, 3]
            room = plan.bins[np.searchsorted(plan.bins[:, 0], bin_id, "right") - 1, 1]
            yield pd.DataFrame({key: pdf["k"], "piece": pdf["piece"], "n_tokens": own, "bin_id": bin_id, "capacity": room, "offset": p[:, 5] + i % p[:, 3] * own})

    kind = df.schema[key].dataType.simpleString()
    return ranked.mapInPandas(place, f"`{key}` {kind}, piece long, n_tokens long, bin_id long, capacity long, offset long")
