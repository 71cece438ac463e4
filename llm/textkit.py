"""Vectorised text helpers shared by the corpus operators.

Everything here works on Arrow batches inside a task: a batch of texts is one
byte buffer plus offsets, and words, word hashes and shingles are found with
numpy over that buffer.  Working memory is bounded by ``BLOCK`` bytes of text
at a time (or one document, when that is longer); eight bytes a letter are only needed for ``PIECE`` bytes (or one word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK, PIECE = 2 << 20, 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLDED = _BYTE[_LOWER]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, PIECE + 1)
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more offset than texts); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first and last row, bytes, offsets."""
    data, at = buffers(texts)
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text (bytes between 0x20, 0x09-0x0D), and the first word of each text."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(at), np.int64)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z folded to a-z."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + PIECE, "right")))
        base = starts[low]
        piece = _FOLDED[data[base : ends[high - 1]]]
        up, down = _power_tables(len(piece) + 1)
        piece *= up[: len(piece)]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece, out=sums[1:])
        s, e = starts[low:high] - base, ends[low:high] - base
        out[low:high] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        low = high
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text in order, and the first shingle of each text.

    A text of 1 to n-1 words has its whole sequence as its only shingle; a text without words has none.
    """
    counts = np.diff(first)
    shingles = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate(([0], np.cumsum(shingles)))
    total = int(begin[-1])
    lead = np.arange(total) - np.repeat(begin[:-1] - first[:-1], shingles)
    sums = np.zeros(total, np.uint64)
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    limit = np.repeat(first[1:], shingles)
    for k in range(n):
        factor = _U((2 * k + 3) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
        part = padded[lead + k] * factor
        if (counts < n).any():
            part[lead + k >= limit] = _U(k + 1)
        sums += part
        sums = mix(sums)
    return sums, begin


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    one = np.sort(hashes)
    return one[np.concatenate(([True], one[1:] != one[:-1]))] if len(one) > 1 else one


def shingle_blocks(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with their word hashes and first words, and their shingle hashes and first shingles."""
    for low, high, data, at in blocks(texts):
        starts, ends, first = word_spans(data, at)
        words = word_hashes(data, starts, ends)
        yield low, high, words, first, *shingle_hashes(words, first, n)


def distinct_shingles(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, one array for each row, in order."""
    for _, _, _, _, hashes, begin in shingle_blocks(texts, n):
        for k in range(len(begin) - 1):
            yield distinct(hashes[begin[k] : begin[k + 1]])
