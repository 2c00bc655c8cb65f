"""numeric.draw for arrays inside tasks: md5 of many short texts at once in numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_PLACES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def _first_words(words: list, n: int) -> np.ndarray:
    """The first four bytes, as a number, of the md5 of n messages of one block; a word is an array, or an int if all have it."""
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, x, np.uint32) for x in start)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        word, more = words[_PLACES[i]], _ADDED[i]
        f += a
        if isinstance(word, int):
            more = (more + word) % 2**32
        else:
            f += word
        f += np.uint32(more)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=t)
        f <<= np.uint32(_TURNS[i])
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    a += np.uint32(start[0])
    return a.byteswap()


class Texts:
    """The texts that rows of whole numbers add to a seed, ':' before each number; none where one is missing."""

    def __init__(self, *numbers: pa.Array):
        text = pc.fill_null(pc.binary_join_element_wise("", *(pc.cast(n, pa.string()) for n in numbers), ":"), "")
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        self.n, lengths = len(text), np.diff(ends)
        self.groups = []
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            self.groups.append((rows, data[ends[rows][:, None] + np.arange(length)] if length else np.zeros((len(rows), 0), np.uint8)))

    def draws(self, seed: str) -> np.ndarray:
        """draw(seed, number) for every number."""
        head, out = np.frombuffer(seed.encode(), np.uint8), np.empty(self.n, np.int64)
        for rows, tail in self.groups:
            size = len(head) + tail.shape[1]
            if size > 55:  # more than a block
                out[rows] = [int.from_bytes(hashlib.md5(head.tobytes() + t.tobytes()).digest()[:4], "big") for t in tail]
                continue
            message = np.zeros((len(rows), 4 * (size // 4 + 1)), np.uint8)
            message[:, : len(head)] = head
            message[:, len(head) : size] = tail
            message[:, size] = 0x80
            words = list(np.ascontiguousarray(message.view("<u4").T))
            words += [0] * (16 - len(words))
            words[14] = 8 * size
            out[rows] = _first_words(words, len(rows))
        return out
