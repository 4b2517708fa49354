"""MD5 over columns of short texts, as the hash-seeded draws need it: all draws of a block of rows, without a row each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Rows hashed at once; their words stay in a core's cache.
BLOCK = 16384
#: Rows below which hashing them one by one is faster.
FEW = 512

SHIFTS = np.array([7, 12, 17, 22, 5, 9, 14, 20, 4, 11, 16, 23, 6, 10, 15, 21]).reshape(4, 4)
SINES = [int(abs(np.sin(i + 1)) * 2 ** 32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def first_word(words: list) -> np.ndarray:
    """The first four bytes of MD5, as a big-endian number, of one block of sixteen words: each a column of numbers or one for all."""
    n = max(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    # the last three steps leave this word alone
    for i in range(61):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = (7 * i) % 16
        f += a
        w = words[g]
        if isinstance(w, np.ndarray):
            f += w
            f += np.uint32(SINES[i])
        else:
            f += np.uint32((w + SINES[i]) & 0xFFFFFFFF)
        s = int(SHIFTS[kind, i % 4])
        np.left_shift(f, np.uint32(s), out=t)
        f >>= np.uint32(32 - s)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    # after that many steps the word is in b
    return (b + np.uint32(START[0])).byteswap()


def hashes(texts: list[bytes], tails: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the tail, places, hashes): the first eight hex digits of md5(text + tail), as numbers, for every text and tail."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        for low in range(0, len(at), BLOCK):
            places = at[low:low + BLOCK]
            own = [texts[i] for i in places]
            raw = np.zeros((len(places), 64), np.uint8)
            if 0 < size < 56:
                raw[:, :size] = np.frombuffer(b"".join(own), np.uint8).reshape(len(places), size)
            columns = np.ascontiguousarray(raw.view("<u4").T)
            for k, tail in enumerate(tails):
                whole = int(size) + len(tail)
                if whole > 55 or len(places) < FEW:  # two blocks, or too few
                    yield k, places, np.array([int.from_bytes(hashlib.md5(x + tail).digest()[:4], "big") for x in own], np.uint32)
                    continue
                rest = np.zeros(64, np.uint8)
                rest[size:whole + 1] = np.frombuffer(tail + b"\x80", np.uint8)
                rest[56:] = np.frombuffer((8 * whole).to_bytes(8, "little"), np.uint8)
                rest = rest.view("<u4")
                words = [columns[j] | rest[j] if 4 * j < size else int(rest[j]) for j in range(16)]
                if size == 0:
                    words[0] = np.full(len(places), rest[0], np.uint32)
                yield k, places, first_word(words)
