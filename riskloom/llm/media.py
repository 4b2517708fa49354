"""Media columns for ISO base media files.

``walk`` reads the nested boxes of a file and ``describe`` decodes the sample
tables (stsd, stts, stss, stsz/stz2, stsc, stco/co64) into codec, duration and
keyframe byte ranges; payload bytes are never decoded. ``wrap`` stores a payload
losslessly as a raw 8-bit grey video track of 16 x 12 pixels, 192 bytes a frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import map_rows, own_columns

FRAME, WIDTH, HEIGHT = 192, 16, 12
TIMESCALE, TICKS = 1000, 40
GROUP = 25  # frames from one sync sample to the next
CHUNK = 64  # frames in a chunk
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
HDLR = full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 12, b"grey\0")
VMHD = box(b"vmhd", b"\0\0\0\1", b"\0" * 8)
DINF = box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1")))
STSD = full(b"stsd", struct.pack(">I", 1), box(
    b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1),
    b"\0" * 32, struct.pack(">Hh", 8 + 32, -1)))


def pad(text: bytes) -> bytes:
    """Spaces up to a positive multiple of the frame size."""
    return text + b" " * (-len(text) % FRAME if text else FRAME)


def wrap(payload: bytes) -> bytes:
    """A file whose frames are the payload's 192-byte units, in order."""
    n = len(payload) // FRAME
    span = n * TICKS
    firsts = range(0, n, CHUNK)
    last = n - firsts[-1]
    runs = [(1, CHUNK)] if len(firsts) > 1 else []
    if not runs or last != CHUNK:
        runs.append((len(firsts), last))
    keys = np.arange(1, n + 1, GROUP)
    wide = len(payload) > 0xF0000000

    def moov(base: int) -> bytes:
        spots = base + np.arange(0, n, CHUNK, dtype=np.int64) * FRAME
        offsets = full(b"co64", struct.pack(">I", len(spots)), spots.astype(">u8").tobytes()) if wide else full(
            b"stco", struct.pack(">I", len(spots)), spots.astype(">u4").tobytes())
        stbl = box(
            b"stbl", STSD, full(b"stts", struct.pack(">III", 1, n, TICKS)),
            full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, k, 1) for c, k in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)), offsets)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, span, 0x55C4, 0)), HDLR, box(b"minf", VMHD, DINF, stbl))
        tkhd = box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 1, 0, span), b"\0" * 8, struct.pack(">hhhh", 0, 0, 0, 0), UNITY, struct.pack(">II", WIDTH << 16, HEIGHT << 16))
        mvhd = full(b"mvhd", struct.pack(">IIIIIh", 0, 0, TIMESCALE, span, 0x10000, 0x100), b"\0" * 10, UNITY, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + len(payload)) if wide else struct.pack(">I", 8 + len(payload)) + b"mdat"
    base = len(FTYP) + len(moov(0)) + len(head)
    return b"".join((FTYP, moov(base), head, payload))


def walk(data: bytes, begin: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body begin, body end) of every box, parents first; sizes of 0 and 64-bit sizes are understood."""
    end = len(data) if end is None else end
    while begin + 8 <= end:
        size, kind, head = int.from_bytes(data[begin:begin + 4], "big"), data[begin + 4:begin + 8], 8
        if size == 1:
            if begin + 16 > end:
                raise ValueError("cut box header")
            size, head = int.from_bytes(data[begin + 8:begin + 16], "big"), 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield path + (kind,), begin + head, begin + size
        if kind in NESTED:
            yield from walk(data, begin + head, begin + size, path + (kind,))
        begin += size


class Track:
    """Sample tables of one track."""

    def __init__(self, data: bytes, boxes: dict[bytes, tuple[int, int]]):
        self.data, self.boxes = data, boxes
        a, _ = boxes[b"stsd"]
        self.codec = data[a + 12:a + 16].decode("latin-1")
        a, _ = boxes[b"mdhd"]
        at = a + (20 if data[a] else 12)
        self.timescale = int.from_bytes(data[at:at + 4], "big")
        self.duration = int.from_bytes(data[at + 4:at + (12 if data[a] else 8)], "big")

    def table(self, kind: bytes, width: int, skip: int = 4, of: str = ">u4") -> np.ndarray:
        a, b = self.boxes[kind]
        n = int.from_bytes(self.data[a + skip:a + skip + 4], "big")
        step = np.dtype(of).itemsize * width
        if a + skip + 4 + n * step > b:
            raise ValueError(f"table {kind!r} is longer than its box")
        return np.frombuffer(self.data, of, n * width, a + skip + 4).astype(np.int64).reshape(n, width)

    def sizes(self) -> np.ndarray:
        if b"stz2" in self.boxes:
            a, _ = self.boxes[b"stz2"]
            bits, n = self.data[a + 7], int.from_bytes(self.data[a + 8:a + 12], "big")
            if bits == 4:
                raw = np.frombuffer(self.data, np.uint8, (n + 1) // 2, a + 12)
                return np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
            return np.frombuffer(self.data, f">u{bits // 8}", n, a + 12).astype(np.int64)
        a, _ = self.boxes[b"stsz"]
        same, n = struct.unpack_from(">II", self.data, a + 4)
        return np.full(n, same, np.int64) if same else self.table(b"stsz", 1, 8)[:, 0]

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Offset and size of every sample."""
        sizes = self.sizes()
        chunks = (self.table(b"co64", 1, of=">u8") if b"co64" in self.boxes else self.table(b"stco", 1))[:, 0]
        runs = self.table(b"stsc", 3)
        many = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
        chunk = np.repeat(np.arange(len(chunks)), many)
        if len(chunk) != len(sizes):
            raise ValueError("chunks and sizes disagree")
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(many) - many
        return chunks[chunk] + before - before[first[chunk]], sizes

    def keys(self) -> np.ndarray:
        """Indexes of the sync samples; without the table every sample is one."""
        return self.table(b"stss", 1)[:, 0] - 1 if b"stss" in self.boxes else np.arange(len(self.sizes()))


def tracks(data: bytes) -> list[Track]:
    found: list[dict] = []
    for path, a, b in walk(data):
        if path == (b"moov", b"trak"):
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (a, b))
    return [Track(data, boxes) for boxes in found if b"stsd" in boxes and b"mdhd" in boxes]


def describe(data: bytes) -> dict:
    """codec, duration_s, samples, key_offsets and key_sizes of the first track that has samples."""
    for t in tracks(data):
        spots, sizes = t.samples()
        keys = t.keys()
        return {"codec": t.codec, "duration_s": t.duration / t.timescale if t.timescale else None, "samples": len(sizes), "key_offsets": spots[keys], "key_sizes": sizes[keys]}
    raise ValueError("no track")


def unwrap(data: bytes) -> bytes:
    """The samples of the first track, in order, found through its tables."""
    spots, sizes = tracks(data)[0].samples()
    if len(sizes) and (np.diff(spots) == sizes[:-1]).all():
        return data[spots[0]:spots[-1] + sizes[-1]]
    return b"".join(data[a:a + n] for a, n in zip(spots, sizes))


def media_columns(df: DataFrame, key: str, media: str) -> DataFrame:
    """key, codec, duration_s, samples, keyframes array<struct<offset,size>>, error: one row per input row.

    Null, empty, cut or foreign bytes give nulls and a reason in ``error``. Repeated
    rows are described alike; other columns are not read; nothing is shuffled.
    """
    own_columns(key, ["codec", "duration_s", "samples", "keyframes", "error"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for data in pdf[media]:
            try:
                d = describe(bytes(data or b""))
                rows.append((d["codec"], d["duration_s"], d["samples"], [{"offset": int(o), "size": int(n)} for o, n in zip(d["key_offsets"], d["key_sizes"])], None))
            except (ValueError, KeyError, IndexError, struct.error) as e:
                rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
        out = pd.DataFrame(rows, columns=["codec", "duration_s", "samples", "keyframes", "error"]).astype({"samples": "Int64"})
        out.insert(0, key, pdf[key].to_numpy())
        return out

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, media), f"`{key}` {kind}, codec string, duration_s double, samples long, keyframes array<struct<offset:long,size:long>>, error string", run)


def digest(text: str | None) -> tuple:
    """Wrap a text, read it back through the tables, describe it."""
    raw = (text or "").encode()
    stored = wrap(pad(raw))
    back, d = unwrap(stored), describe(stored)
    ranges = np.stack([d["key_offsets"], d["key_sizes"]], 1).astype("<i8").tobytes()
    feature = f"codec={d['codec'].strip()};ms={round(d['duration_s'] * 1000)};samples={d['samples']};keyframes={len(d['key_sizes'])};ranges={zlib.crc32(ranges):08x};levels={len(set(back))}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as an ISO media file and report what is read back.

    Null texts count as empty and are stored as one frame of spaces; equal texts
    give equal values. One row per input row, in no order; an empty table gives an
    empty result; other columns are not read; nothing is shuffled.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    own_columns(key, names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([digest(t) for t in pdf[text]], columns=names)
        out.insert(0, key, pdf[key].to_numpy())
        return out

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, text), f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", run)
