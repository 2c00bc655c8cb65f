"""Vectorised word and shingle hashing over Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.  Hashes are
64-bit and computed for all words of a batch at once, so no Python code runs per word.  Equality of
words and shingles rests on `word_hashes`; `span_hashes`, a polynomial evaluated from one running sum,
is for features of models, where a collision does no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijection of 64-bit numbers whose output bits look independent."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit numbers."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(_BASE))


_BYTE = seeded(256, 7)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_GRAM = seeded(64, 11) | np.uint64(1)
_SHORT = seeded(64, 13)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(m, _BASE, np.uint64), np.full(m, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def text_chunks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column: (first row, end row, bytes, row offsets into the bytes).

    A slice holds at most max_bytes unless one text alone is longer; a null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets_buf, data_buf = column.buffers()
    offsets = np.frombuffer(offsets_buf, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        end = min(max(end, row + 1), n)
        base = offsets[row]
        yield row, end, data[base : offsets[end]], offsets[row : end + 1] - base
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (rows + 1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | fresh[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """64-bit hashes of byte spans (starts, ends); equal bytes, but for A-Z as a-z, give equal hashes."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return [mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)) for starts, ends in spans]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, of its length and its blocks of eight bytes.

    A block is mixed with a key of its place before blocks are added, so no pattern in a word's bytes
    carries over into the hash; words of up to eight bytes and of one length never collide.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    low = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=low[: len(data)])
    blocks = np.lib.stride_tricks.as_strided(low, (len(data) + 1, 8), (1, 1))

    def mixed(at, left, key):
        x = blocks[at].view("<u8").ravel() & _FIRST_BYTES[np.minimum(left, 8)]
        return mix64(x ^ key)

    length = ends - starts
    total = mixed(starts, length, np.uint64(_BASE))
    long = np.flatnonzero(length > 8)
    if len(long):
        more = (length[long] - 1) // 8
        first = np.cumsum(more) - more
        word = np.repeat(np.arange(len(long)), more)
        place = np.arange(len(word)) - first[word] + 1
        at = starts[long][word] + 8 * place
        key = mix64((place.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
        total[long] += np.add.reduceat(mixed(at, ends[long][word] - at, key), first)
    return mix64(total + length.astype(np.uint64) * np.uint64(_BASE_INV))


_SLICE = 4 << 20


def _all_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each row's first word.

    One text of more than some MB is read in slices that end where a word ends, so that beside the text
    only its words' hashes are held.
    """
    if len(offsets) > 2 or len(data) <= _SLICE:
        starts, ends, index = word_spans(data, offsets)
        return word_hashes(data, starts, ends), index
    parts, at = [], 0
    while at < len(data):
        end = min(at + _SLICE, len(data))
        while end < len(data) and not SPACE[data[end]]:  # to the next blank, in strides
            stop = np.flatnonzero(SPACE[data[end : end + _SLICE]])
            end = end + int(stop[0]) if len(stop) else min(end + _SLICE, len(data))
        starts, ends, _ = word_spans(data[at:end], np.array([0, end - at]))
        parts.append(word_hashes(data[at:end], starts, ends))
        at = end
    hashes = np.concatenate(parts)
    return hashes, np.array([0, len(hashes)])


def shingle_arrays(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text.

    Shingles are runs of `words` words; a text with fewer words gives its whole sequence as one,
    a text without words gives none.
    """
    for first, end, data, offsets in text_chunks(column):
        hashes, index = _all_hashes(data, offsets)
        n = len(hashes)
        if n >= words:
            grams = np.zeros(n - words + 1, np.uint64)
            for j in range(words):
                grams += hashes[j : n - words + 1 + j] * _GRAM[j]
            grams = mix64(grams)
        for row in range(end - first):
            a, b = int(index[row]), int(index[row + 1])
            if b - a >= words:
                yield first + row, np.unique(grams[a : b - words + 1])
            elif b > a:
                short = np.sum(hashes[a:b] * _GRAM[: b - a], dtype=np.uint64, keepdims=True) + _SHORT[b - a : b - a + 1]
                yield first + row, mix64(short)
            else:
                yield first + row, np.zeros(0, np.uint64)
