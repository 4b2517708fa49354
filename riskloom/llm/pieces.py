"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into segments between which no piece can reach. Distinct segments
are exploded into their substrings of bounded length and equi-joined to the piece
table; the matches of a segment are its lattice, and a higher-order ``aggregate``
folds it into the best path: Viterbi for a unigram table, whose piece scores add up.
For a BPE table the sum of scores is not what the library minimises (its scores are
merge ranks), so there the same lattice is folded by rank: edges come best first,
leftmost first, and an edge is taken if the text under it is just two symbols now. The
state of that fold is one long, a bit for each cut. Where a merge opens the way for
an edge that has gone by, the segment is folded again outside, exactly; so are segments
of more than LONGEST characters.

Documents are never shuffled. A first pass notes the distinct segments of each of its
tasks; every distinct segment is folded once; a join hands each task's segments back,
with their ids, in a file of its own; and the second pass, task by task over the same
documents, reads that file alone. So a task holds the segments of its own documents,
whatever the corpus, and neither the driver nor a broadcast holds any.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import Scratch
from .common import bounded_batches, own_columns

SPACE = "▁"
#: Longer segments are folded outside the relational part, by the same rule.
LONGEST = 48
#: Segments that a task has noted, or keeps with their ids.
CACHE = 1_000_000
#: Bytes of text that are cut into words at once.
SLICE = 2 << 20
#: Bytes of words that are cut into segments at once.
BLOCK = 1 << 17
#: Notes of a task's segments that one task of the second step takes; a quarter of them, about, are lattices to fold.
TASK = 30_000
NORMAL, CONTROL, USER, BYTE = 1, 3, 4, 6


def fields(data: bytes):
    """(number, value) of a protocol buffer message; numbers, or bytes where a length is given."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at:at + size]
        at += size


@dataclass
class Table:
    """Pieces by id, of a model file with identity normalisation."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    unigram: bool
    prefix: bool

    @classmethod
    def read(cls, path: str) -> Table:
        pieces, scores, kinds, unigram, prefix = [], [], [], True, True
        with open(path, "rb") as f:
            for n, v in fields(f.read()):
                if n == 1:
                    x = dict(fields(v))
                    pieces.append(x[1].decode())
                    scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                    kinds.append(x.get(3, NORMAL))
                elif n == 2:
                    unigram = dict(fields(v)).get(3, 1) == 1
                elif n == 3:
                    x = dict(fields(v))
                    prefix = bool(x.get(3, 1))
                    if x.get(2) or x.get(4, 1):
                        raise ValueError("only models that keep text and white space as they are")
        return cls(pieces, scores, kinds, unigram, prefix)

    def normal(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds)) if k in (NORMAL, USER)}

    def bytes_at(self) -> int | None:
        """Id of the piece for byte 0, where all 256 are there in order."""
        return next((i for i, k in enumerate(self.kinds) if k == BYTE), None)


class Coder:
    """Cuts texts into segments, folds long segments, decodes ids."""

    def __init__(self, table: Table):
        self.table, self.known, self.byte0 = table, table.normal(), table.bytes_at()
        self.joined = {p[i:i + 2] for p in self.known for i in range(len(p) - 1)}
        self.longest = max(map(len, self.known))
        self.byte_ids = {i for i, k in enumerate(table.kinds) if k == BYTE}
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    @cached_property
    def beside(self) -> tuple[np.ndarray, int, np.ndarray]:
        """A number for each character, how many numbers there are, and which pairs of them a piece has side by side: as a table, or sorted where that is too large."""
        chars = sorted({c for pair in self.joined for c in pair})
        number = np.zeros(0x110000, "u4")
        number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        many = len(chars) + 1
        pairs = np.array(sorted(int(number[ord(a)]) * many + int(number[ord(b)]) for a, b in self.joined), "i8")
        if many <= 1 << 13:
            table = np.zeros(many * many, bool)
            table[pairs] = True
            return number, many, table
        return number, many, pairs

    @cached_property
    def spelling(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The pieces by id, the bytes of each, and which are bytes."""
        pieces = pa.array(self.table.pieces, pa.large_string())
        return pieces, np.diff(layout(pieces)[0]), np.array(self.table.kinds) == BYTE

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words of some texts, each with the spaces before it; of every word in turn which it is; and where each text's words begin, and the last one's end."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), SPACE, " ")
        if self.table.prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        at, data = layout(texts)
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(begins)
        found = laid_out(np.append(starts, len(data)), data).dictionary_encode()
        return pc.replace_substring(found.dictionary, " ", SPACE), found.indices.to_numpy(), np.searchsorted(starts, at)

    def surface(self, text: str) -> str:
        return (SPACE if self.table.prefix and text else "") + text.replace(" ", SPACE)

    def segments(self, word: str) -> list[str]:
        return self.cut(pa.array([word], pa.large_string()))[0].to_pylist()

    def cut(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words cut wherever no piece has the two characters side by side; and where each word's segments begin, and the last one's end."""
        at, data = layout(words)
        number, many, pairs = self.beside
        found = []
        for part in np.split(at[:-1], np.flatnonzero(np.diff(at[:-1] // BLOCK)) + 1) if len(words) else []:
            end = at[np.searchsorted(at, part[-1]) + 1]
            own = data[part[0]:end]
            chars = number[np.frombuffer(own.tobytes().decode().encode("utf-32-le"), "<u4")]
            pair = chars[:-1].astype("i8") * many + chars[1:]
            begins = np.ones(len(chars), bool)
            if pairs.dtype == bool:
                begins[1:] = ~pairs[pair]
            else:
                begins[1:] = pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] != pair
            first = np.zeros(len(own), bool)
            first[part - part[0]] = True
            place = np.flatnonzero((own & 0xC0) != 0x80)  # of every character
            found.append(place[begins | first[place]] + part[0])
        ends = np.concatenate([*found, [len(data)]]).astype("i8")
        return laid_out(ends, data), np.searchsorted(ends, at)

    def lone(self, c: str) -> list[int]:
        if c in self.known:
            return [self.known[c][0]]
        return [0] if self.byte0 is None else [self.byte0 + b for b in c.encode()]

    def fold(self, segment: str) -> list[int]:
        """Ids of one segment."""
        if self.table.unigram:
            best: list[tuple[float, int, str]] = [(0.0, 0, "")]
            floor = min(s for _, s in self.known.values()) - 10
            for j in range(1, len(segment) + 1):
                options = []
                for i in range(max(0, j - self.longest), j):
                    p = segment[i:j]
                    if p in self.known:
                        options.append((best[i][0] + self.known[p][1], -i, p))
                    elif j == i + 1:
                        options.append((best[i][0] + floor, -i, p))
                best.append(max(options))
            out, j = [], len(segment)
            while j:
                out.append(best[j][2])
                j = -best[j][1]
            parts = out[::-1]
        else:
            import heapq

            parts = list(segment)
            after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
            heap: list[tuple[float, int, str]] = []

            def offer(i: int) -> None:
                if i >= 0 and after[i] < len(parts):
                    p = parts[i] + parts[after[i]]
                    if p in self.known:
                        heapq.heappush(heap, (-self.known[p][1], i, p))

            for i in range(len(parts) - 1):
                offer(i)
            while heap:
                _, i, p = heapq.heappop(heap)
                j = after[i]
                if not parts[i] or j >= len(parts) or parts[i] + parts[j] != p:
                    continue
                parts[i], parts[j], after[i] = p, "", after[j]
                if after[j] < len(parts):
                    before[after[j]] = i
                offer(before[i])
                offer(i)
            parts = [p for p in parts if p]
        return [x for p in parts for x in ([self.known[p][0]] if p in self.known else self.lone(p))]

    def surface_of(self, ids: bytes) -> str:
        """A word from its ids, as it stood among the segments."""
        at = struct.unpack(f"<{len(ids) // 4}i", ids)
        if self.byte0 is None or not self.byte_ids.intersection(at):
            return "".join([self.table.pieces[i] for i in at])
        return b"".join([bytes([i - self.byte0]) if self.table.kinds[i] == BYTE else self.table.pieces[i].encode() for i in at]).decode("utf-8", "replace")

    def decode(self, ids) -> str:
        """Text of ids: pieces and runs of bytes, spaces back, without the added prefix."""
        out, run = [], bytearray()
        for i in ids:
            if self.table.kinds[i] == BYTE:
                run.append(i - self.byte0)
                continue
            out.append(run.decode("utf-8", "replace"))
            run.clear()
            out.append("" if self.table.kinds[i] == CONTROL else self.table.pieces[i])
        text = "".join([*out, run.decode("utf-8", "replace")]).replace(SPACE, " ")
        return text[1:] if self.table.prefix and text[:1] == " " else text


def layout(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of some large strings begins, and the last one's end, and their bytes."""
    at = np.frombuffer(values.buffers()[1], "<i8")[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, "<i8")
    data = np.frombuffer(values.buffers()[2], "u1") if at[-1] else np.zeros(0, "u1")
    return at - at[0], data[at[0]:at[-1]]


def laid_out(at: np.ndarray, data: np.ndarray, kind: pa.DataType = pa.large_string()) -> pa.Array:
    """The reverse of layout()."""
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype("<i8", copy=False)), pa.py_buffer(data)])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of some batches by some SLICE bytes of text, their last column."""
    pa.set_memory_pool(pa.system_memory_pool())  # which hands back what a slice took
    held, size = [], 0

    def dealt() -> Iterator[pa.RecordBatch]:
        whole = pa.concat_batches(held)
        part = np.cumsum(pc.binary_length(whole.column(whole.num_columns - 1)).fill_null(0).to_numpy().astype("i8")) // SLICE
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(whole)]
        return (whole[a:b] for a, b in zip(edges, edges[1:]) if a < b)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE:
            yield from dealt()
            held, size = [], 0
    if held:
        yield from dealt()


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def viterbi(table: Table, size: Column, scores: Column) -> Column:
    """Ends of the pieces on the path of greatest sum, from 0 to ``size``; ``scores`` maps begin * 64 + end to an edge's score."""
    least = F.lit(float("-inf"))
    floor = float(min(s for s, k in zip(table.scores, table.kinds) if k in (NORMAL, USER)) - 10)
    longest = max(map(len, table.pieces))

    def ahead(best: Column, j: Column) -> Column:
        options = F.transform(F.sequence(F.greatest(j - longest, F.lit(0)), j - 1), lambda i: F.named_struct(
            F.lit("score"), F.get(best, i)["score"] + F.coalesce(F.try_element_at(scores, i * 64 + j).cast("double"), F.when(i == j - 1, F.lit(floor)), least),
            F.lit("back"), -i))
        return F.concat(best, F.array(F.array_max(options)))

    start = F.array(F.named_struct(F.lit("score"), F.lit(0.0), F.lit("back"), F.lit(0)))
    return let(F.aggregate(F.sequence(F.lit(1), size), start, ahead), lambda best: F.aggregate(
        F.sequence(F.lit(1), size), F.array(size), lambda cuts, _: F.when(
            F.get(cuts, F.lit(0)) > 0, F.concat(F.array(-F.get(best, F.get(cuts, F.lit(0)))["back"]), cuts)).otherwise(cuts)))


def merged(size: Column, edges: Column, late: Column) -> Column:
    """Cuts left by merging in rank order, as bits of a long; -1 where an edge that has gone by became possible.

    ``edges``: structs sorted by ``key`` (rank, then place), with the bits of all places
    from end to end as ``every``, of the two ends as ``ends``, and all but the places between as ``rest``.
    An edge is opened by the merge of one of its two halves; it has gone by then only if it
    begins or ends with a piece of a later rank, which ``late`` tells.
    """
    one = F.lit(1).cast("long")

    def fits(cuts: Column, e: Column) -> Column:
        # its ends are cuts and just one place between them is
        return (F.bit_count(cuts.bitwiseAND(e["every"])) == 3) & (cuts.bitwiseAND(e["ends"]) == e["ends"])

    def step(cuts: Column, e: Column) -> Column:
        after = cuts.bitwiseAND(e["rest"])
        missed = let(after, lambda now: F.exists(late, lambda f: (f["key"] < e["key"]) & fits(now, f)))
        return F.when((cuts >= 0) & fits(cuts, e), F.when(missed, F.lit(-1).cast("long")).otherwise(after)).otherwise(cuts)

    return F.aggregate(edges, F.call_function("shiftleft", one, size + 1) - 1, step)


def ids_along(table: Table, seg: Column, cuts: Column, ids: Column) -> Column:
    """Ids of the pieces between cut points; a character that is no piece gives its bytes' pieces."""
    byte0 = table.bytes_at()

    def lone(a: Column) -> Column:
        if byte0 is None:
            return F.array(F.lit(0))
        return let(F.hex(F.encode(F.substring(seg, a + 1, F.lit(1)), "UTF-8")), lambda digits: F.transform(
            F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int")),
            lambda k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("int") + byte0))

    def piece(i: Column) -> Column:
        return let(F.try_element_at(ids, F.get(cuts, i) * 64 + F.get(cuts, i + 1)), lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(lone(F.get(cuts, i))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), piece))


def best_sums(table: Table, lattice: DataFrame) -> DataFrame:
    """seg and ids on the path of greatest sum, from seg and the edges of its lattice: structs of span, id and score."""
    maps = lattice.select("seg", "edges", F.map_from_entries(F.transform("edges", lambda e: F.struct(e["span"], e["id"]))).alias("found"))
    scores = F.map_from_entries(F.transform("edges", lambda e: F.struct(e["span"], e["score"])))
    cuts = maps.withColumn("scores", scores).select("seg", "found", viterbi(table, F.length("seg"), F.col("scores")).alias("cuts"))
    return cuts.select("seg", ids_along(table, F.col("seg"), F.col("cuts"), F.col("found")).alias("ids"))


def by_rank(table: Table, lattice: DataFrame) -> DataFrame:
    """seg and ids (null where the fold must be done again), from seg, ``edges`` of two characters or more as merged() takes them, and the edges of one as ``single``."""
    one = F.lit(1).cast("long")
    # sort_array compares natively, where array_sort has a lambda of its own
    state = lattice.withColumns({"edges": F.sort_array("edges"), "late": F.filter("edges", lambda e: e["late"])}).withColumn("state", merged(F.length("seg"), F.col("edges"), F.col("late")))
    whole = F.col("state")
    on = lambda e: (F.bit_count(whole.bitwiseAND(e["every"])) == 2) & (whole.bitwiseAND(e["ends"]) == e["ends"])
    left = F.filter(F.concat("edges", "single"), on)
    # in the order of their places; where a character is no piece, pieces are fewer than the stretches between cuts
    path = F.transform(F.sort_array(F.transform(left, lambda e: F.struct(e["span"], e["id"]))), lambda e: e["id"])
    cuts = F.filter(F.sequence(F.lit(0), F.length("seg")), lambda i: whole.bitwiseAND(F.call_function("shiftleft", one, i)) != 0)
    found = F.map_from_entries(F.transform(left, lambda e: F.struct(e["span"], e["id"])))
    state = state.withColumn("path", path)
    bytewise = let(cuts, lambda c: let(found, lambda f: ids_along(table, F.col("seg"), c, f)))
    return state.select("seg", F.when(whole >= 0, F.when(F.size("path") == F.bit_count(whole) - 1, F.col("path")).otherwise(bytewise)).alias("ids"))


def plain_scan(df: DataFrame) -> bool:
    """Whether the rows come from files, filtered and projected at most, so that two passes have the same tasks."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lines = [x.strip(" +-:!") for x in plan.strip().split("\n")]
    return bool(lines) and lines[-1].startswith("Relation") and all(x.startswith(("Project", "Filter", "Relation")) for x in lines)


def folded(segs: DataFrame, table: Table, longest: int) -> DataFrame:
    """seg and ids (null where the fold must be done again) of distinct segments: their substrings joined to the pieces, grouped and folded."""
    spark = segs.sparkSession
    known = sorted(table.normal().items(), key=lambda x: -x[1][1])
    ranks = {p: rank for rank, (p, _) in enumerate(known)}
    late = [any(ranks.get(x, -1) > rank for n in range(2, len(p)) for x in (p[:n], p[-n:])) for p, rank in ranks.items()]
    rows = pd.DataFrame([(p, i, x, rank, later) for (rank, (p, (i, x))), later in zip(enumerate(known), late)], columns=["known", "id", "score", "rank", "late"])
    pieces = spark.createDataFrame(rows, "known string, id int, score double, rank long, late boolean").withColumn("h", F.xxhash64("known"))
    begins = segs.select("seg", F.explode(F.sequence(F.lit(0), F.length("seg") - 1)).alias("a"))
    edges = begins.select("seg", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("seg") - F.col("a")))).alias("n")).withColumn("piece", F.substring("seg", F.col("a") + 1, F.col("n")))
    # the piece table's size is fixed by the model file; a long is looked up sooner than a string, which is compared only on a hit
    found = edges.withColumn("h", F.xxhash64("piece")).join(F.broadcast(pieces), "h", "left").where("known = piece or n = 1")
    hit, end = F.col("known") == F.col("piece"), F.col("a") + F.col("n")
    span = (F.col("a") * 64 + end).alias("span")
    if table.unigram:
        return best_sums(table, found.groupBy("seg").agg(F.collect_list(F.when(hit, F.struct(span, "id", "score"))).alias("edges")))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    found = found.withColumns({"ends": bit(F.col("a")).bitwiseOR(bit(end)), "inner": bit(end) - bit(F.col("a") + 1)})
    edge = F.struct((F.col("rank") * 4096 + F.col("a") * 64 + end).alias("key"), F.col("ends").bitwiseOR(F.col("inner")).alias("every"), "ends", F.bitwise_not("inner").alias("rest"), span, "id", "late")
    long = F.col("n") > 1
    return by_rank(table, found.groupBy("seg").agg(F.collect_list(F.when(hit & long, edge)).alias("edges"), F.collect_list(F.when(hit & ~long, edge)).alias("single")))


def width(table: Table) -> int:
    """Bytes of a packed id."""
    return 2 if len(table.pieces) <= 1 << 16 else 4


def packed(ids: Column, table: Table) -> Column:
    """Ids as bytes, the highest of each first; null stays null."""
    digits = 2 * width(table)
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), digits, "0")), ""))


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """key, n_tokens, ids (or ids_crc32 and round_trip): one row per input row.

    Null and empty texts have no ids. Repeated rows give equal rows; texts of any
    length are encoded whole; other columns are not read. round_trip tells that the
    ids decode to the text again. Should the second pass be dealt out otherwise than the
    first (executors may have come or gone between them), a segment that a task lacks is
    folded by the task itself, to the same ids.
    """
    own_columns(key, ["n_tokens", "ids", "ids_crc32", "round_trip"])
    bounded_batches(df)
    spark, table = df.sparkSession, Table.read(model)
    coder = Coder(table)
    s = Scratch(spark, "pieces")
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    docs = docs if plain_scan(docs) else s.table(docs, "docs")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, " + ("ids_crc32 long, round_trip boolean" if digest else "ids array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        noted = pa.array([""], pa.large_string())
        for batch in slices(batches):
            segs = coder.cut(coder.words(batch.column(0))[0])[0].unique()
            segs = segs.filter(pc.less_equal(pc.utf8_length(segs), LONGEST))
            segs = segs.filter(pc.invert(pc.is_in(segs, value_set=noted)))
            if len(noted) < CACHE:
                noted = pa.concat_arrays([noted, segs])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(segs), task, "i4")), segs.cast(pa.string())], ["p", "seg"])

    docs.select("t").mapInArrow(cut, "p int, seg string").write.mode("overwrite").option("compression", "zstd").parquet(s.path("met"))
    met = spark.read.schema("p int, seg string").parquet(s.path("met"))
    # dealt out by segment: counting, exploding, joining, grouping and handing back then need no further exchange
    told = met.agg(F.count("*").alias("n"), (F.max("p") + 1).alias("tasks")).first()
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-told["n"] // TASK))
    dealt = met.where("seg is not null").repartition(many, "seg")
    # with p, though only to tell it is there, so that counting and handing back read one and the same exchange
    segs = dealt.groupBy("seg").agg(F.min("p").alias("least")).where("least >= 0")
    made = folded(segs, table, min(coder.longest, LONGEST)).select("seg", packed(F.col("ids"), table).alias("ids"))
    path = s.path("tasks")
    # a task groups and looks up by hashing, without sorting: it has fewer than TASK segments
    limit = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(TASK))
    try:
        dealt.join(made.hint("shuffle_hash"), "seg").select("p", "seg", "ids").repartition(told["tasks"] or 1, "p").sortWithinPartitions("p", "seg").write.mode("overwrite").option("compression", "zstd").partitionBy("p").parquet(path)
    finally:
        spark.conf.set(limit, before)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in slices(batches):
            kept = kept or Kept(coder, task_segments(path, TaskContext.get().partitionId(), width(table)))
            words, which, text_at = coder.words(batch.column(1))
            segs, word_at = coder.cut(words)
            segs = segs.dictionary_encode()
            known, wrong, place = kept.ids(segs.dictionary)
            place = place[segs.indices.to_numpy()]
            at, data = layout(known.take(pa.array(place)))
            at, data = layout(laid_out(at[word_at], data, pa.large_binary()).take(pa.array(which)))
            at = at[text_at] // 4
            out = [batch.column(0), pa.array(np.diff(at))]
            if digest:
                ids = memoryview(data)
                bad = np.append(0, np.cumsum(np.diff(np.append(0, np.cumsum(wrong[place]))[word_at])[which]))[text_at]
                out += [pa.array([zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())], pa.int64()), pa.array(np.diff(bad) == 0)]
            else:
                out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(data.view("<i4"))))
            yield pa.RecordBatch.from_arrays(out, [key, "n_tokens", *(["ids_crc32", "round_trip"] if digest else ["ids"])])

    return docs.mapInArrow(put, schema)


class Kept:
    """The segments of a task with their ids as 32-bit integers, and whether these decode to something else."""

    def __init__(self, coder: Coder, found: Iterator[tuple[pa.Array, pa.Array]]):
        self.coder, names, known, wrong = coder, [pa.array([], pa.large_string())], [pa.array([], pa.large_binary())], [np.zeros(0, bool)]
        for segs, ids in found:
            names.append(segs)
            known.append(ids)
            wrong.append(mistaken(coder, segs, ids))
        self.names, self.known, self.wrong = pa.concat_arrays(names), pa.concat_arrays(known), np.concatenate(wrong)

    def ids(self, segs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids and wrongness by place, and the places of some distinct segments; what is not there is folded, and kept while there is room."""
        place = pc.index_in(segs, value_set=self.names)
        names, known, wrong = segs.filter(place.is_null()), self.known, self.wrong
        place = place.fill_null(-1).to_numpy().astype("i8")
        if len(names):
            more = pa.array([np.array(self.coder.fold(x), "<i4").tobytes() for x in names.to_pylist()], pa.large_binary())
            place[place < 0] = np.arange(len(known), len(known) + len(more))
            known, wrong = pa.concat_arrays([known, more]), np.concatenate([wrong, mistaken(self.coder, names, more)])
            if len(self.names) < CACHE:
                self.names, self.known, self.wrong = pa.concat_arrays([self.names, names]), known, wrong
        return known, wrong, place


def mistaken(coder: Coder, segs: pa.Array, ids: pa.Array) -> np.ndarray:
    """Of each segment whether its ids decode to something else."""
    pieces, sizes, is_byte = coder.spelling
    (ends, _), (at, data) = layout(segs), layout(ids)
    at, flat = at // 4, data.view("<i4")
    sums = lambda x: np.diff(np.append(0, np.cumsum(x))[at])
    wrong = sums(sizes[flat]) != np.diff(ends)
    odd = wrong | (sums(is_byte[flat]) > 0)
    # the others all at once: as many bytes in each, and the same bytes in all
    if layout(pieces.take(pa.array(flat[np.repeat(~odd, np.diff(at))])))[1].tobytes() != layout(segs.filter(pa.array(~odd)))[1].tobytes():
        odd[:] = True
    for i in np.flatnonzero(odd).tolist():
        wrong[i] = coder.surface_of(ids[i].as_py()) != segs[i].as_py()
    return wrong


def task_segments(path: str, task: int, width: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The segments of one task and their ids as 32-bit integers, some at a time; what the fold left open is not there."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    files, folder = fs.FileSystem.from_uri(path)
    at = f"{folder}/p={task}"
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return
    for batch in ds.dataset(at, filesystem=files, format="parquet").to_batches(columns=["seg", "ids"], batch_size=50_000, batch_readahead=1, fragment_readahead=1, use_threads=False):
        batch = batch.filter(pc.greater(pc.binary_length(batch.column("ids")), 0))
        ends, data = layout(batch.column("ids").cast(pa.large_binary()))
        yield batch.column("seg").cast(pa.large_string()), laid_out(ends // width * 4, data.view(f">u{width}").astype("<i4"), pa.large_binary())


def decode(df: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text: one row per input row; null ids give a null text. Ids outside the table raise."""
    own_columns(key, ["text"])
    coder = Coder(Table.read(model))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "text": [None if x is None else coder.decode(list(x)) for x in pdf[ids]]})

    bounded_batches(df)
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInPandas(run, f"`{key}` {kind}, text string")
