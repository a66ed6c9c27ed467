"""Tokenizer ids of whole texts through the tokenizers library, each distinct word encoded once.

Both public vocabularies used here split a text at white space before they merge bytes, so
the ids of a text are the ids of its words in order.  A batch is cut into words, the words it
has not seen are encoded by the library in a few long calls, and the ids of all rows are
gathered with numpy.  Every word is compared, byte by byte, with the one whose ids it takes.
Texts whose white space makes the cut differ from the library's own, and those with a word
that shares another one's hash, are encoded by the library alone.  A long text is cut before
spaces that follow a word, where both vocabularies begin a new piece.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pandas as pd

from planwalk.llm import wordhash

#: Words kept before the cache starts anew; an entry takes about 60 bytes.
CACHE_WORDS = 600_000
#: Bytes of a text that the library takes at once.
PIECE_BYTES = 1 << 16
#: Signs that may close a plain word, and the last letter of a plain word.
CLOSING = ".,;:!?"
LAST_LATIN = "\u00ff"

#: Byte patterns (in UTF-8) of white space other than space and line feed.
OTHER_SPACE = re.compile(rb"[\x09\x0b-\x0d\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SPACE_LEAD = np.zeros(256, dtype=bool)
SPACE_LEAD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
ONLY_SPACES = np.zeros(256, dtype=bool)
ONLY_SPACES[[0x0A, 0x20]] = True
BEFORE_NO_CUT = ONLY_SPACES.copy()
BEFORE_NO_CUT[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def cuts(data: np.ndarray, low: int, high: int, size: int) -> np.ndarray:
    """Places in data[low:high], about `size` bytes apart, of spaces that follow a word."""
    if high - low <= size:
        return np.zeros(0, np.int64)
    free = np.flatnonzero((data[low + 1 : high] == 0x20) & ~BEFORE_NO_CUT[data[low : high - 1]]) + low + 1
    at = np.searchsorted(free, np.arange(low + size, high, size))
    return free[np.unique(at[at < len(free)])]


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte (the public byte-to-unicode rule)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Encodes rows of a text column; keeps_space tells a byte-level vocabulary, whose words hold the space before them."""

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.keeps_space = len(self._ids("a b")) != len(self._ids("ab")) and self._ids("a\n") != self._ids("a")
        self.line = self._ids("\n")[0] if self.keeps_space else -1
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.closing: dict[str, list[int]] = {}
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # ascending
        self.slots = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.bytes = np.zeros(0, np.uint8)
        self.begins = np.zeros(1, np.int64)

    def _library(self, raw: np.ndarray) -> np.ndarray:
        """Ids of a whole text by the library, a piece at a time."""
        at = [0, *cuts(raw, 0, len(raw), PIECE_BYTES).tolist(), len(raw)]
        found = [self._ids(raw[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(at, at[1:])]
        return np.fromiter(chain.from_iterable(found), np.uint32)

    def _differ(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Which words are not the ones that the slots were learned from."""
        sizes, at = ends - starts, self.begins[slots]
        wrong = self.begins[slots + 1] - at != sizes
        here, kept = wordhash.lanes(data), wordhash.lanes(self.bytes)
        left = np.flatnonzero(~wrong & (sizes <= wordhash.LONG_WORD))
        k = 0
        while len(left):
            n = sizes[left]
            wrong[left] = wordhash.lane(here, starts[left], n, k) != wordhash.lane(kept, at[left], n, k)
            k += 1
            left = left[(n > 8 * k) & ~wrong[left]]
        for i in np.flatnonzero(~wrong & (sizes > wordhash.LONG_WORD)).tolist():
            wrong[i] = not np.array_equal(data[starts[i] : ends[i]], self.bytes[at[i] : at[i] + sizes[i]])
        return wrong

    def _word(self, text: str) -> list[int] | None:
        """Ids of a plain word (Latin letters, then full stops and the like) from the library's merge model.

        Such a word is one piece of the pre-tokenizer, its closing signs are another, and it
        is its own normal form; None for any other word.
        """
        core = text.rstrip(CLOSING)
        led = core[:1] == " "
        body = core[1:] if led else core
        if not body.isalpha() or (not body.isascii() and max(body) > LAST_LATIN):
            return None
        if not self.keeps_space:
            core = core.lower()
            if not core.isascii() and max(core) > LAST_LATIN:
                return None
        ids = [t.id for t in self.merge(core.encode().decode("latin-1").translate(self.letters))]
        if len(body) + led < len(text):
            end = text[len(body) + led :]
            if end not in self.closing:
                self.closing[end] = self._ids(end)
            ids += self.closing[end]
        return ids

    def _learn(self, keys: np.ndarray, texts: list[str], led: np.ndarray, words: list[bytes]) -> None:
        """Adds words, with their bytes; led marks those that follow a line feed, whose token stands before theirs."""
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        found = [self._word(t) for t in texts]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, encoded in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = encoded.ids
        line = [self.line] if self.keeps_space else []
        found = [line + ids if f else ids for ids, f in zip(found, led.tolist(), strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        slots = np.arange(len(self.at) - 1, len(self.at) - 1 + len(keys))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.slots = all_keys[order], np.concatenate([self.slots, slots])[order]

    def _slots_of(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        where = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[where] == keys, self.slots[where], -1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, count of each row)."""
        n_rows = len(offsets) - 1
        long = np.flatnonzero(np.diff(offsets) > wordhash.SEGMENT_BYTES).tolist()
        inner = np.concatenate([np.zeros(0, np.int64), *(cuts(data, offsets[r], offsets[r + 1], wordhash.SEGMENT_BYTES) for r in long)])
        where = np.searchsorted(offsets, inner)
        own = np.insert(np.ones(n_rows + 1, np.int64), where, 0)
        offsets = np.insert(offsets, where, inner)
        row = np.cumsum(own[:-1]) - 1  # of each part of a text
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i, j in wordhash.segments(offsets):
            low = offsets[i]
            a, b = self._segment(data[low : offsets[j]], offsets[i : j + 1] - low)
            ids.append(a)
            counts.append(b)
        return np.concatenate(ids), np.bincount(row, weights=np.concatenate(counts), minlength=n_rows).astype(np.int64)

    def _segment(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_rows = len(offsets) - 1
        starts, ends, rows = wordhash.words(data, offsets, ONLY_SPACES)
        whole = np.zeros(n_rows, dtype=bool)
        if self.keeps_space:
            whole = self._whole(data, offsets, starts, ends, rows)
            keep = ~whole[rows]
            starts, ends, rows = starts[keep], ends[keep], rows[keep]
        keys = wordhash.hashes(data, starts, ends)
        variant = np.zeros(len(starts), np.uint8)
        if self.keeps_space and len(starts):
            inner = starts > offsets[rows]
            previous = data[np.maximum(starts - 1, 0)]
            variant = np.where(inner, np.where(previous == 0x20, 1, 2), 0).astype(np.uint8)
            keys = keys ^ (variant.astype(np.uint64) * np.uint64(wordhash.MIX_2))
        codes, unique = pd.factorize(keys)
        slots = self._slots_of(unique)
        if (slots < 0).any():
            if len(self.keys) + len(unique) > CACHE_WORDS:
                self._forget()
                slots = np.full(len(unique), -1, np.int64)
            first = np.empty(len(unique), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            new = np.flatnonzero(slots < 0)
            at = first[new]
            raw = data.tobytes()
            space = (variant[at] == 1).tolist()
            words = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            texts = [(" " if sp else "") + w.decode("utf-8", "replace") for w, sp in zip(words, space, strict=True)]
            self._learn(unique[new], texts, (variant[at] == 2).astype(np.int64), words)
            slots = self._slots_of(unique)
        wrong = self._differ(data, starts, ends, slots[codes])
        if wrong.any():
            whole[rows[wrong]] = True
            keep = ~whole[rows]
            codes, rows = codes[keep], rows[keep]
        lows, sizes = self.at[slots], self.at[slots + 1] - self.at[slots]
        size = sizes[codes]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        gather = np.arange(total) + np.repeat(lows[codes] - (end - size), size)
        ids = self.flat[gather]
        counts = np.bincount(rows, weights=size, minlength=n_rows).astype(np.int64)
        if not whole.any():
            return ids, counts
        # rows encoded whole take their places among the others
        at = np.concatenate(([0], np.cumsum(counts)))
        parts = [ids[at[r] : at[r + 1]] for r in range(n_rows)]
        for r in np.flatnonzero(whole).tolist():
            parts[r] = self._library(data[offsets[r] : offsets[r + 1]])
            counts[r] = len(parts[r])
        return np.concatenate(parts), counts

    @staticmethod
    def _whole(data, offsets, starts, ends, rows) -> np.ndarray:
        """Rows whose white space is more than single spaces and line feeds between words."""
        n_rows = len(offsets) - 1
        n_space = np.add.reduceat(np.concatenate((ONLY_SPACES[data], [False])).astype(np.int64), np.minimum(offsets[:-1], len(data)))
        n_space[np.diff(offsets) == 0] = 0
        n_words = np.bincount(rows, minlength=n_rows)
        single = np.ones(n_rows, dtype=bool)
        if len(starts):
            led = (starts > offsets[rows]).astype(np.int64)
            single = np.bincount(rows, weights=led, minlength=n_rows).astype(np.int64) == n_space
        else:
            single = n_space == 0
        whole = ~single
        whole[n_words == 0] = n_space[n_words == 0] > 0
        if SPACE_LEAD[data].any():
            for r in np.unique(np.searchsorted(offsets, np.flatnonzero(SPACE_LEAD[data]), side="right") - 1).tolist():
                whole[r] = whole[r] or OTHER_SPACE.search(data[offsets[r] : offsets[r + 1]].tobytes()) is not None
        return whole


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
