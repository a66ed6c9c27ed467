"""Vectorised word boundaries and 64-bit word hashes over Arrow text buffers.

All helpers work on the raw UTF-8 buffer of a string column, so no Python string is made
per row or per word.  segments() keeps rows whole; pieces() also cuts long rows between words
into about a megabyte each, so that what is made of a piece does not grow with the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 1 << 20
#: Longest word, in bytes, that is hashed by eight bytes at a time.
LONG_WORD = 64
#: An odd number to start from and the constants of the mixing.
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null row is an empty one."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        # rows marked null hold no bytes in Spark's writers; anything else is made so
        lengths = np.diff(at)
        gone = np.asarray(column.is_null())
        if lengths[gone].any():
            column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
            return text_buffer(column)
    return raw[at[0] : at[-1]], at - at[0]


def segments(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about SEGMENT_BYTES bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SEGMENT_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def cut_at(data: np.ndarray, flags: np.ndarray, low: int, high: int) -> int:
    """The first place from low on whose byte is flagged, or high."""
    while low < high:
        found = np.flatnonzero(flags[data[low : min(low + SEGMENT_BYTES, high)]])
        if len(found):
            return low + int(found[0])
        low += SEGMENT_BYTES
    return high


def pieces(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, low, high): segments, and pieces of longer rows one after the other, each cut before a space."""
    for i, j in segments(offsets):
        low, high = int(offsets[i]), int(offsets[j])
        while high - low > 2 * SEGMENT_BYTES:
            cut = cut_at(data, is_space, low + SEGMENT_BYTES, high)
            yield i, j, low, cut
            low = cut
        yield i, j, low, high


def words(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that are no space; is_space is a table of 256 flags."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~is_space[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on as a little-endian integer; bytes beyond the end are zero."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def lane(view: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8 * k to 8 * k + 7 of words longer than 8 * k bytes, zero beyond their ends."""
    left = np.minimum(sizes - 8 * k, 8)
    return view[starts + 8 * k] & (np.uint64(_MASK) >> ((8 - left) * 8).astype(np.uint64))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end].

    The bytes are taken in by eight, with a bijective mixing after each eight, so words of at
    most eight bytes and one length never share a hash, and no rule makes longer ones do so;
    words of more than LONG_WORD bytes are digested by blake2b.
    """
    sizes = ends - starts
    view = lanes(data)
    out = mix(sizes.astype(np.uint64) * np.uint64(MIX_1) + np.uint64(BASE))
    at = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    k = 0
    while len(at):
        out[at] = mix(out[at] ^ lane(view, starts[at], sizes[at], k))
        k += 1
        at = at[sizes[at] > 8 * k]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        word = data[starts[i] : ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out
