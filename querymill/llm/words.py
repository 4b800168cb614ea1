"""Words of UTF-8 text as numpy arrays: where they lie, and a 64-bit hash of each.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
All work is on the buffers of Arrow arrays, a few megabytes at a time, so a batch of any size needs bounded
memory beside its own.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20  # bytes of text worked on at once; a longer text is a chunk of its own
BLOCK = 1 << 16
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _spread(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2 * seed + 1))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _powers(base: int) -> np.ndarray:
    steps = np.full(BLOCK, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
VALUE = _spread(0x5DEECE66D, 256)
FOLDED = VALUE.copy()
FOLDED[65:91] = VALUE[97:123]
POWER, INVERSE = _powers(BASE), _powers(BASE_INVERSE)


class Chunk(NamedTuple):
    """Whole texts: rows ``low`` to ``high`` of the batch, their bytes, and where each begins and ends in them."""

    low: int
    high: int
    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """``first[i]`` to ``first[i + 1]`` are the words of text i of the chunk."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[Chunk]:
    """Null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1)
        yield Chunk(low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        low = high


def words_of(chunk: Chunk, fold: bool = False) -> Words:
    """``fold``: hash A-Z as a-z."""
    data, bounds = chunk.data, chunk.bounds
    inside = IS_WORD[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(data)]
    opens[firsts] = inside[firsts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    lasts = bounds[1:][bounds[1:] > 0] - 1
    closes[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(starts, ends, np.searchsorted(starts, bounds), _hashes(data, starts, ends, FOLDED if fold else VALUE))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Polynomial of each word's byte values, from running sums; block by block, so temporaries stay small."""
    before, after = np.empty(len(starts), np.uint64), np.empty(len(ends), np.uint64)
    carry, i, j = np.uint64(0), 0, 0
    for low in range(0, len(data), BLOCK):
        terms = value[data[low:low + BLOCK]] * POWER[:len(data) - low]
        terms *= np.uint64(pow(BASE, low, 1 << 64))
        sums = np.cumsum(terms, dtype=np.uint64)
        sums += carry
        k = int(np.searchsorted(starts, low + len(terms)))
        at = starts[i:k] - low
        before[i:k] = sums[at] - terms[at]
        i = k
        k = int(np.searchsorted(ends, low + len(terms), side="right"))
        after[j:k] = sums[ends[j:k] - 1 - low]
        j = k
        carry = sums[-1]
    h = after - before
    blocks = starts // BLOCK
    h *= INVERSE[starts - blocks * BLOCK]
    if len(blocks) and blocks[-1]:
        step = pow(BASE_INVERSE, BLOCK, 1 << 64)
        scale = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(blocks[-1]), step, np.uint64)]))
        h *= scale[blocks]
    return mix(h + (ends - starts).astype(np.uint64))


FACTOR = _spread(0x2545F4914F6CDD1D, 64) | np.uint64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, at its first word; runs across texts are the caller's to leave out."""
    count = max(0, len(hashes) - n + 1)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h += hashes[i:i + count] * FACTOR[i]
    return mix(h)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct runs of ``n`` words of one text, sorted; a shorter text is one run; none without words."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    if len(hashes) < n:
        return mix(grams(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(grams(hashes, n))
