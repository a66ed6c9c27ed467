"""Distinct word shingles of whole texts as 64-bit hashes, over Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from planwalk.llm import wordhash

#: Space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Hashes of a long row's pieces that are held before they are made distinct.
SEGMENT_SHINGLES = 1 << 20
#: A-Z lower-cased, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _chain(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive entries of h."""
    out = h[: len(h) - n + 1] + np.uint64(n)
    for k in range(1, n):
        out = wordhash.mix(out) + h[k : len(h) - n + 1 + k]
    return wordhash.mix(out)


def _long_set(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one row, a piece after the other; the last words of a piece lead on to the next."""
    carried = np.zeros(0, np.uint64)
    found = [carried]
    held = 0
    for _, _, low, high in wordhash.pieces(data, offsets, ASCII_SPACE):
        part = LOWER[data[low:high]]
        starts, ends, _ = wordhash.words(part, np.array([0, len(part)]), ASCII_SPACE)
        h = np.concatenate((carried, wordhash.hashes(part, starts, ends)))
        if len(h) >= size:
            found.append(np.unique(_chain(h, size)))
            held += len(found[-1])
            if held > 4 * len(found[0]) + SEGMENT_SHINGLES:
                found = [np.unique(np.concatenate(found))]
                held = 0
        carried = h[len(h) - min(len(h), size - 1) :]
    if sum(map(len, found)):
        return np.unique(np.concatenate(found))
    return _chain(carried, len(carried)) if len(carried) else carried


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, counts): for a run of rows, the sorted distinct shingle hashes of each row one after the other.

    Words are runs of bytes that are no ASCII white space, A-Z lower-cased.  A row with fewer
    than `size` words has its whole sequence as one shingle, one without words has none.  Of
    a long row no more is held than its distinct hashes and what a few pieces need.
    """
    for i, j in wordhash.segments(offsets):
        low = offsets[i]
        if offsets[j] - low > 2 * wordhash.SEGMENT_BYTES:
            own = _long_set(data, offsets[i : j + 1], size)
            yield i, j, own, np.array([len(own)])
            continue
        part = LOWER[data[low : offsets[j]]]
        starts, ends, rows = wordhash.words(part, offsets[i : j + 1] - low, ASCII_SPACE)
        h = wordhash.hashes(part, starts, ends)
        n_words = np.bincount(rows, minlength=j - i)
        first = np.concatenate(([0], np.cumsum(n_words)))
        chained = _chain(h, size) if len(h) >= size else np.zeros(0, np.uint64)
        found, counts = [], np.zeros(j - i, np.int64)
        for r in range(j - i):
            n = int(n_words[r])
            if not n:
                continue
            a = int(first[r])
            own = np.unique(chained[a : a + n - size + 1]) if n >= size else _chain(h[a : a + n], n)
            found.append(own)
            counts[r] = len(own)
        yield i, j, (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


def signatures(hashes: np.ndarray, counts: np.ndarray, multipliers: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """MinHash coordinates of the rows that have shingles, one row each."""
    counts = counts[counts > 0]
    at = np.concatenate(([0], np.cumsum(counts)))[:-1]
    out = np.empty((len(counts), len(multipliers)), dtype=np.uint64)
    for k, (a, b) in enumerate(zip(multipliers, shifts, strict=True)):
        out[:, k] = np.minimum.reduceat(hashes * a + b, at)
    return out


def family(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """n pairs of an odd multiplier and a shift."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)
