"""Vectorised work on the words of many texts: spans in UTF-8 bytes and 64-bit hashes.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, so multi-byte characters
never split.  Hashes of words mix every eight bytes before they are combined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
# Masks for the first n of eight bytes.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_BLOCK = 1_000_000

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed public finalizer)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to at most ``most``, or of one item."""
    ends = np.cumsum(sizes)
    s = 0
    while s < len(sizes):
        base = ends[s - 1] if s else 0
        e = max(s + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield s, e
        s = e


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each non-empty span of bytes.

    Each eight bytes are mixed together with their place before they are added up, so that no regular
    pattern of letters makes different spans agree.
    """
    out = np.empty(len(starts), np.uint64)
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    sizes = ends - starts
    lanes = (sizes + 7) >> 3
    for s, e in blocks(lanes, _BLOCK):
        n, size = lanes[s:e], sizes[s:e]
        at = np.cumsum(n) - n
        if len(at) == int(n.sum()):
            place, value, left = np.uint64(0), eight[starts[s:e]], size
        else:
            place = np.arange(int(n.sum())) - np.repeat(at, n)
            value = eight[np.repeat(starts[s:e], n) + 8 * place]
            left = np.minimum(np.repeat(size, n) - 8 * place, 8)
            place = place.astype(np.uint64)
        value = value & FIRST_BYTES[np.minimum(left, 8)]
        value = mix(value + (place + np.uint64(1)) * _BASE)
        if value.shape != n.shape:
            value = np.add.reduceat(value, at)
        out[s:e] = mix(value + size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total) for texts at data[offsets[i]:offsets[i+1]]."""
    inside = IS_WORD[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    opens[borders] = inside[borders]
    closes[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def text_blocks(batches: Iterable[pa.RecordBatch], key: str | None, text: str, most: int = 2_000_000) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(keys, bytes, offsets) of bounded groups of rows; null texts are empty; without a key column, keys are None."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        keys = [None] * len(column) if key is None else batch.column(batch.schema.get_field_index(key)).to_pylist()
        column = column.fill_null("").cast(pa.large_binary())
        if not len(column):
            continue
        kinds = column.buffers()
        offsets = np.frombuffer(kinds[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(kinds[2], np.uint8) if kinds[2] is not None else np.zeros(0, np.uint8)
        for s, e in blocks(np.diff(offsets), most):
            yield keys[s:e], data[offsets[s]:offsets[e]], offsets[s:e + 1] - offsets[s]


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first shingle of each text and the total) of all runs of ``width`` words.

    A text with fewer words has one shingle, the whole; without words it has none.
    """
    counts = np.diff(first)
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.append(0, np.cumsum(number))
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], number) + np.repeat(first[:-1], number)
    size = np.repeat(np.minimum(counts, width), number)
    total = np.zeros(len(at), np.uint64)
    padded = np.append(hashes, np.zeros(width, np.uint64))
    for k in range(width):
        total = total * _BASE + np.where(k < size, padded[at + k], np.uint64(0))
    return mix(total + size.astype(np.uint64)), begin
