"""Token ids in binary shards with Elias-Fano document boundaries.

A shard is one file: a 16-byte header, the concatenated ids (16-bit where the
vocabulary allows, else 32-bit, little-endian), the document boundaries and the
document ids as Elias-Fano sequences, and a fixed trailer that locates them.
Boundaries cost about 2 + log2(ids per document) bits each; every ``STEP``-th one bit of the
high part has its position in a 32-bit directory, so ``select`` reads a bounded
stretch of bits and no 64-bit offset table exists.

Documents are range-partitioned and sorted by key; each task streams its ids to a
temporary name and renames it when complete, so a task that runs again replaces the
file with equal bytes. The manifest (one row a shard) is a table in shared storage.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..scratch import Scratch
from .common import bounded_batches, own_columns

MAGIC, STEP = b"IDSHARD1", 256
HEADER, TRAILER = "<8sII", "<QQQQQqQ8s"
#: Values of a sequence whose bits are spread out at once; a multiple of 8.
CHUNK = 1 << 16
#: Bytes of text in a shard, about. A directory entry of 32 bits bounds a shard at some 10^9 documents; this one is far below.
SHARD_BYTES = 256 << 20
#: Distinct words whose ids a worker keeps, and marks that may follow a word.
CACHE, MARKS = 1_000_000, ".,;:!?"


class EliasFano:
    """A non-decreasing sequence of unsigned integers; ``select(i)`` is its i-th value."""

    HEAD = "<QBQQQ"

    def __init__(self, n: int, l: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.l, self.low, self.high, self.marks = n, l, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """Built a stretch of CHUNK values at a time, so that no more than their bits are spread out at once."""
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        l = max(0, (top // n).bit_length() - 1) if n else 0
        low, shifts = [], np.arange(l, dtype=np.uint64)
        high = np.zeros(((top >> l) + n + 8) // 8, np.uint8)
        for i in range(0, n, CHUNK):
            own = v[i:i + CHUNK]
            if l:
                # CHUNK is a multiple of 8, so stretches end on whole bytes
                low.append(np.packbits(((own[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
            ones = (own >> np.uint64(l)).astype(np.int64) + np.arange(i, i + len(own))
            np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        marks = (v[::STEP] >> np.uint64(l)).astype(np.int64) + np.arange(0, n, STEP)
        return cls(n, l, np.concatenate(low) if low else np.zeros(0, np.uint8), high, marks.astype("<u4"))

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Values begin..end-1, reading only their stretch of bits."""
        if begin >= end:
            return np.zeros(0, np.uint64)
        first = begin // STEP
        start = int(self.marks[first]) // 8
        stop_mark = -(-end // STEP)
        stop = int(self.marks[stop_mark]) // 8 + 1 if stop_mark < len(self.marks) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start:stop], bitorder="little")) + start * 8
        ones = ones[np.searchsorted(ones, int(self.marks[first])):]
        at = np.arange(begin, end)
        high = (ones[at - first * STEP] - at).astype(np.uint64) << np.uint64(self.l)
        if not self.l:
            return high
        a, b = begin * self.l, end * self.l
        bits = np.unpackbits(self.low[a // 8:-(-b // 8)], bitorder="little")[a % 8:a % 8 + b - a].reshape(-1, self.l)
        return high | (bits.astype(np.uint64) << np.arange(self.l, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def dump(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.marks.tobytes()]
        return struct.pack(self.HEAD, self.n, self.l, *map(len, parts)) + b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        n, l, a, b, c = struct.unpack_from(cls.HEAD, data)
        at = struct.calcsize(cls.HEAD)
        return cls(n, l, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u4", c // 4, at + a + b))


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian bytes.

    Byte-level pre-tokenisation starts a new piece at a single space or line end
    between other characters and after a run of letters, so such texts are encoded
    word by word: words of letters, the marks after them, and anything else between
    spaces. What a batch has and the cache lacks goes to the library once. Texts with
    other white space side by side, and texts that hold one of the tokenizer's added
    tokens, go to it whole.
    """

    #: Library tokenizer and ids of words, by tokenizer; a worker keeps them from one task to the next.
    kept: dict[int, tuple] = {}
    #: White space that may stand side by side, apart from plain spaces and line ends, which splitting shows.
    RARE = ("\t\r\v\f\x1c\x1d\x1e\x1f", "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

    def __init__(self, spec: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        known = zlib.crc32(f"{width}{spec}".encode())
        if known not in self.kept:
            self.kept[known] = (Tokenizer.from_str(spec), {})
        self.tokenizer, self.cache = self.kept[known]
        self.kind = "H" if width == 2 else "I"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = lambda text: any(x in text for x in added)
        # a search for each sign runs over memory, a class of signs over signs
        few, all_ = self.RARE[0], self.RARE[0] + self.RARE[1]
        self.rare = lambda text: any([x in text for x in (few if text.isascii() else all_)])
        self.odd = re.compile(r"\A | \Z|\s |\s\n| \s|\n\s").search
        self.end = self.whole(["\n"])[0]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        rows: list[list] = []
        other: list[tuple[list, str]] = []
        lacking: dict[str, list] = {}
        get = self.cache.get
        for text in texts:
            row: list = []
            rows.append(row)
            if self.rare(text) and self.odd(text) or self.added(text):
                other.append((row, text))
                continue
            for n, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if "" in words and (n or line):
                    rows[-1] = row = []
                    other.append((row, text))
                    break
                if n:
                    row.append(self.end)
                # a word at the start of a line is another key than the same word after a space
                words[0] = "\n" + words[0]
                found = list(map(get, words))
                if None in found:
                    base = len(row)
                    for i, x in enumerate(found):
                        if x is None:
                            w = words[i]
                            body = w.rstrip(MARKS)
                            if len(body) < len(w) and (body[1:] if i == 0 else body).isalpha():
                                tail = get("\n" + w[len(body):])
                                if tail is not None and (x := get(body)) is not None:
                                    found[i] = x + tail
                                else:
                                    lacking.setdefault(body, []).append((row, base + i, w[len(body):]))
                            else:
                                lacking.setdefault(w, []).append((row, base + i, ""))
                row += found
        if lacking:
            tails = {"\n" + t for places in lacking.values() for _, _, t in places if t}.difference(self.cache, lacking)
            new = [*lacking, *tails]
            ids = dict(zip(new, self.whole([w[1:] if w[:1] == "\n" else " " + w for w in new])))
            for w, places in lacking.items():
                for row, i, t in places:
                    row[i] = ids[w] + (ids.get("\n" + t) or get("\n" + t)) if t else ids[w]
            if len(self.cache) < CACHE:
                self.cache.update((w, x) for w, x in ids.items() if len(w) < 40)
        for (row, _), ids in zip(other, self.whole([t for _, t in other])):
            row.append(ids)
        return list(map(b"".join, rows))


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(df: DataFrame, path: str, key: str, text: str, tokenizer: str, end_id: int, shards: int) -> DataFrame:
    """Encode, order by key and write ``shards`` files below ``path`` (or one for every SHARD_BYTES of text, if more); returns the manifest.

    Null texts count as empty and give the end id alone. Null keys come first; equal
    keys are ordered by text. Empty shards are written too, so an empty table works.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    bounded_batches(df)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # many short lists and no cycles
        try:
            yield from written(batches)
        finally:
            gc.enable()

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        encode, tail = Encoder(spec, width), end_id.to_bytes(width, "little")
        files, folder = _files(path)
        files.create_dir(folder, recursive=True)
        temp, name = f"{folder}/.{shard}-{uuid.uuid4().hex}", f"{folder}/shard-{shard:06d}.ids"
        bounds, keys, nulls, total = array("q", [0]), [], 0, 0
        with files.open_output_stream(temp) as out:
            out.write(struct.pack(HEADER, MAGIC, width, 0))
            for pdf in batches:
                found = []
                for ids in encode([t or "" for t in pdf["t"]]):
                    found += (ids, tail)
                    total += len(ids) // width + 1
                    bounds.append(total)
                out.write(b"".join(found))
                own = pdf["k"].dropna().to_numpy(np.int64)
                nulls += len(pdf) - len(own)
                keys.append(own)
            keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            base = int(keys[0]) if len(keys) else 0
            boundaries = EliasFano.of(np.frombuffer(bounds, np.int64)).dump()
            names = EliasFano.of((keys - base).astype(np.uint64)).dump()
            out.write(boundaries)
            out.write(names)
            out.write(struct.pack(TRAILER, len(bounds) - 1, total, len(boundaries), len(names), nulls, base, 0, MAGIC))
        files.move(temp, name)
        yield pd.DataFrame({"shard": [shard], "file": [name], "docs": [len(bounds) - 1], "ids": [total]})

    held = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    shards = max(shards, -(-held // SHARD_BYTES))
    ordered = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(
        shards, "k", F.xxhash64("t")).sortWithinPartitions("k", "t")
    made = ordered.mapInPandas(write, "shard long, file string, docs long, ids long")
    made.write.mode("overwrite").parquet(f"{path}/manifest")
    return df.sparkSession.read.schema(made.schema).parquet(f"{path}/manifest")


class Shard:
    """Random access to one file."""

    def __init__(self, files, name: str):
        self.file = files.open_input_file(name)
        size = self.file.size()
        self.docs, self.ids, a, b, self.nulls, self.base, _, magic = struct.unpack(TRAILER, self.file.read_at(struct.calcsize(TRAILER), size - struct.calcsize(TRAILER)))
        first, self.width, _ = struct.unpack(HEADER, self.file.read_at(struct.calcsize(HEADER), 0))
        if (first, magic) != (MAGIC, MAGIC):
            raise ValueError(f"not a shard: {name}")
        at = struct.calcsize(HEADER) + self.ids * self.width
        self.bounds = EliasFano.load(self.file.read_at(a, at))
        self.keys = EliasFano.load(self.file.read_at(b, at + a))

    def read(self, begin: int, end: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """Keys, boundaries (one more than documents) and the ids between them."""
        bounds = self.bounds.slice(begin, end + 1).astype(np.int64)
        a, b = int(bounds[0]), int(bounds[-1])
        raw = self.file.read_at((b - a) * self.width, struct.calcsize(HEADER) + a * self.width)
        null = [None] * max(0, min(end, self.nulls) - begin)
        keys = self.keys.slice(max(begin, self.nulls) - self.nulls, max(end, self.nulls) - self.nulls)
        return null + [int(k) + self.base for k in keys], bounds, np.frombuffer(raw, f"<u{self.width}")


def read_shards(spark: SparkSession, path: str, key: str, digest: bool = False) -> DataFrame:
    """One row per document: key, start (ids of all documents before it), n_tokens, then ids, or only their crc32."""
    manifest = spark.read.schema("shard long, file string, docs long, ids long").parquet(f"{path}/manifest")
    # one row a shard: the running sum is over the files, not over the documents
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).where("docs > 0")
    many = max(1, manifest.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, base in zip(pdf["file"], pdf["base"]):
                shard = Shard(_files(path)[0], name)
                for begin in range(0, shard.docs, 500):
                    keys, bounds, ids = shard.read(begin, min(shard.docs, begin + 500))
                    cut = bounds - bounds[0]
                    out = {key: pd.array(keys, "Int64"), "start": base + bounds[:-1], "n_tokens": np.diff(bounds)}
                    wide = ids.astype("<u4")
                    spans = [wide[a:b] for a, b in zip(cut[:-1], cut[1:])]
                    out["ids_crc32" if digest else "ids"] = [zlib.crc32(x.tobytes()) for x in spans] if digest else spans
                    yield pd.DataFrame(out)

    last = "ids_crc32 long" if digest else "ids array<long>"
    return placed.select("file", "base").repartition(many).mapInPandas(read, f"`{key}` long, start long, n_tokens long, {last}")


def token_shards(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Write shards below the session's shared folder and read every document back.

    One row per input row, repeated rows included; equal texts have equal ids. There
    are as many shards as ``spark.sql.shuffle.partitions`` or, if more, one for every
    SHARD_BYTES of text. Extra columns are not read. Keys must be integers.
    """
    own_columns(key, ["start", "n_tokens", "ids_crc32"])
    spark = df.sparkSession
    path = Scratch(spark, "tokens").base
    write_shards(df, path, key, text, tokenizer, end_id, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_shards(spark, path, key, digest=True)
