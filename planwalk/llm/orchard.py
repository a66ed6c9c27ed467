"""Product codes of vectors, with Orchard search for the nearest codebook entry.

A vector in integer steps is cut into equal consecutive parts; each part is replaced by the
index of the nearest entry of its part's codebook.  Every entry keeps a list of all entries
sorted by their distance from it.  A search starts at some entry and walks its list: an entry
that is nearer to the point (or as near, with a lower index) takes over and the walk goes on
in its list; entries once looked at are marked and passed over; the walk ends at the first
entry of the list that is more than twice as far from the current entry as the point is, since
by the triangle inequality nothing behind it can be nearer.  Distances are squared integers, so
"more than twice" is exact: more than four times the square.  A batch of points walks in step.

Training is a few scans: each task adds up the parts of its rows by entry, Spark adds up the
tasks' sums, and what comes to the driver is one codebook (`entries` x length numbers for each
length of vectors).  Sums travel in 32-bit limbs, so they are exact for any finite components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwalk.llm.store import fresh, written

#: Codes have two hexadecimal digits a part.
MOST_ENTRIES = 256
#: Components of the codebooks that one scan takes along; vectors of further lengths have scans of their own.
BLOCK_COMPONENTS = 1 << 21
#: Below this, sums of squares are exact in 64 bits with room for the factor of four.
EXACT = 1 << 60
HIGHEST = (1 << 63) - 1


@dataclass
class Codebooks:
    """The codebooks of the vectors of one length: for each part a list of entries, each a list of integers."""

    width: int
    books: list[list[list[int]]]

    def digest(self) -> str:
        """SHA-256 of all components as decimals, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The vector, in integer steps, that a code stands for."""
        return [x for book, e in zip(self.books, bytes.fromhex(code), strict=True) for x in book[e]]

    def largest(self) -> int:
        return max((abs(x) for book in self.books for entry in book for x in entry), default=0)


def bounds(width: int, parts: int) -> list[tuple[int, int]]:
    """(from, to) of each part; where parts does not divide the length, the first ones are longer by one."""
    each, more = divmod(width, parts)
    ends = [each * (k + 1) + min(k + 1, more) for k in range(parts)]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit integers, or Python's where one of them does not fit."""
    with np.errstate(over="ignore"):
        scaled = values * float(scale)
    if not values.size or np.abs(scaled).max() < 2.0**62:
        return np.floor(scaled).astype(np.int64)
    flat = [math.floor(p) if math.isfinite(p := x * float(scale)) else int(x) * scale for x in values.ravel().tolist()]
    out = np.empty(len(flat), dtype=object)
    out[:] = flat
    return out.reshape(values.shape)


class Lists:
    """A part's codebook with, for every entry, all entries in the order of their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = entries[:, None, :] - entries[None, :, :]
        apart = (gaps * gaps).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        totals = entries.sum(axis=1)
        self.by_total = np.argsort(totals, kind="stable")
        self.totals = totals[self.by_total]

    def _squares(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        gaps = points - self.entries[at]
        return (gaps * gaps).sum(axis=1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of every point; ties go to the lower index."""
        n, k = len(points), len(self.entries)
        # any start is right; an entry with about the same total is seldom far
        now = self.by_total[np.minimum(np.searchsorted(self.totals, points.sum(axis=1)), k - 1)]
        best = self._squares(points, now)
        seen = np.zeros((n, k), dtype=bool)
        seen[np.arange(n), now] = True
        at = np.zeros(n, np.int64)
        walking = np.arange(n)
        while len(walking):
            current, place = now[walking], at[walking]
            goes_on = (place < k) & (self.apart[current, np.minimum(place, k - 1)] <= 4 * best[walking])
            walking, current, place = walking[goes_on], current[goes_on], place[goes_on]
            entry = self.order[current, place]
            at[walking] = place + 1
            new = ~seen[walking, entry]
            point, entry = walking[new], entry[new]
            seen[point, entry] = True
            squares = self._squares(points[point], entry)
            nearer = (squares < best[point]) | ((squares == best[point]) & (entry < now[point]))
            point = point[nearer]
            now[point], best[point], at[point] = entry[nearer], squares[nearer], 0
        return now, best


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, label, v, width): the rows whose vector is not null and holds neither nulls nor non-finite components."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return vectors.where(x.isNotNull() & finite).select(F.col(id_col).alias("id"), label.alias("label"), x.alias("v"), F.size(x).alias("width"))


def _first(rows: DataFrame, width: int, entries: int) -> list[list[float]]:
    """The vectors of the smallest distinct ids in ascending order; of rows that share an id, the smallest vector."""
    found: dict = {}
    rest = rows.where((F.col("width") == width) & F.col("id").isNotNull()).select("id", "v")
    while len(found) < entries:
        more = rest.orderBy("id", "v").limit(entries).collect()
        for row in more:
            found.setdefault(row["id"], row["v"])
        if len(more) < entries:
            break
        rest = rest.where(F.col("id") > F.lit(more[-1]["id"]))
    return list(found.values())[:entries]


def _blocks(sizes: list[Codebooks]) -> Iterator[list[Codebooks]]:
    block, held = [], 0
    for codebooks in sizes:
        size = codebooks.width * max(len(codebooks.books[0]), 1)
        if block and held + size > BLOCK_COMPONENTS:
            yield block
            block, held = [], 0
        block.append(codebooks)
        held += size
    if block:
        yield block


def _of(rows: DataFrame, block: list[Codebooks]) -> DataFrame:
    return rows.where(F.col("width").isin([c.width for c in block]))


class _Coder:
    """Assigns the parts of batches of vectors; the neighbour lists of a length are made once a task."""

    def __init__(self, block: list[Codebooks], scale: int):
        self.codebooks, self.scale = {c.width: c for c in block}, scale
        self.held: dict[tuple[int, bool], list[Lists]] = {}

    def _lists(self, width: int, exact: bool) -> list[Lists]:
        key = (width, exact)
        if key not in self.held:
            kind = np.int64 if exact else object
            # an array of Python's integers is filled by hand: numpy would not keep a part without components in shape
            spans = bounds(width, len(self.codebooks[width].books))
            self.held[key] = [Lists(np.array(book, dtype=kind).reshape(len(book), to - start)) for book, (start, to) in zip(self.codebooks[width].books, spans, strict=True)]
        return self.held[key]

    def batches(self, batch: pa.RecordBatch) -> Iterator[tuple[Codebooks, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(codebooks, places in the batch, steps, codes, squared distances) for each length of vectors in a batch of (.., v, width)."""
        v = batch.column("v")
        values, offsets = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
        widths = batch.column("width").to_numpy()
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            codebooks = self.codebooks[width]
            steps = whole(values[offsets[at][:, None] + np.arange(width)].reshape(len(at), width), self.scale)
            largest = max(int(np.abs(steps).max()) if steps.size else 0, codebooks.largest())
            exact = steps.dtype != object and max(width, 1) * (2 * largest) ** 2 < EXACT
            steps = steps if exact else steps.astype(object)
            found = [lists.nearest(steps[:, a:b]) for lists, (a, b) in zip(self._lists(width, exact), bounds(width, len(codebooks.books)), strict=True)]
            yield codebooks, at, steps, np.stack([now for now, _ in found], axis=1), np.stack([best for _, best in found], axis=1)


_SUMS = "width int, part int, entry int, pos int, pair int, low long, high long"


def _limbs(total: int) -> Iterator[tuple[int, int, int]]:
    """(k, low, high): the integer as a sum of (low + high * 2^32) * 2^(64 k), low in 32 bits and high signed in the last one."""
    k = 0
    while True:
        low, rest = total & 0xFFFFFFFF, total >> 32
        if -(1 << 31) <= rest < 1 << 31:
            yield k, low, rest
            return
        yield k, low, rest & 0xFFFFFFFF
        total, k = rest >> 32, k + 1


def _sums(block: list[Codebooks], scale: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(block, scale)
        counts: dict[int, np.ndarray] = {}
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for codebooks, _, steps, codes, _ in coder.batches(batch):
                width, spans, k = codebooks.width, bounds(codebooks.width, len(codebooks.books)), len(codebooks.books[0])
                if width not in counts:
                    counts[width] = np.zeros((len(spans), k), np.int64)
                    totals[width] = np.zeros((k, width), dtype=object)
                for p, (a, b) in enumerate(spans):
                    counts[width][p] += np.bincount(codes[:, p], minlength=k)
                    part = np.zeros((k, b - a), steps.dtype)
                    np.add.at(part, codes[:, p], steps[:, a:b])
                    totals[width][:, a:b] += part
        rows: list[tuple[int, ...]] = []
        for width, n in counts.items():
            spans = bounds(width, len(n))
            for p, e in np.argwhere(n > 0).tolist():
                rows.append((width, p, e, -1, 0, int(n[p, e]), 0))
                for pos, x in enumerate(totals[width][e, slice(*spans[p])].tolist()):
                    rows.extend((width, p, e, pos, *limb) for limb in _limbs(int(x)))
        names = [c.split()[0] for c in _SUMS.split(", ")]
        kinds = [pa.int32()] * 5 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return task


def _refined(rows: DataFrame, block: list[Codebooks], scale: int) -> list[Codebooks]:
    """One round: every entry becomes the componentwise floor of the mean of its parts; an entry without parts stays."""
    found = _of(rows, block).select("v", "width").mapInArrow(_sums(block, scale), _SUMS)
    keys = ["width", "part", "entry", "pos", "pair"]
    # as many rows as the block's codebooks have components, whatever the number of vectors
    sums: dict[tuple[int, ...], int] = {}
    for r in found.groupBy(*keys).agg(F.sum("low").alias("low"), F.sum("high").alias("high")).collect():
        key = tuple(r[k] for k in keys[:4])
        sums[key] = sums.get(key, 0) + ((r["low"] + (r["high"] << 32)) << (64 * r["pair"]))
    out = []
    for codebooks in block:
        books = []
        for p, book in enumerate(codebooks.books):
            n_of = [sums.get((codebooks.width, p, e, -1), 0) for e in range(len(book))]
            books.append([[sums[codebooks.width, p, e, pos] // n for pos in range(len(entry))] if (n := n_of[e]) else entry for e, entry in enumerate(book)])
        out.append(Codebooks(codebooks.width, books))
    return out


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> list[Codebooks]:
    """The codebooks after `rounds` rounds for every length of vectors, shortest first.

    They start as the parts of the vectors with the smallest distinct ids; null ids are none.
    Fewer ids than entries give fewer entries.  Lengths without a row that has an id have no
    codebooks.
    """
    if not 0 < entries <= MOST_ENTRIES:
        raise ValueError(f"entries must be between 1 and {MOST_ENTRIES}, not {entries}")
    rows = kept(vectors, id_col, vector_col, None)
    started = []
    for (width,) in rows.where(F.col("id").isNotNull()).select("width").distinct().orderBy("width").collect():
        first = _first(rows, width, entries)
        first = whole(np.array(first, dtype=float).reshape(len(first), width), scale).tolist()
        started.append(Codebooks(width, [[row[a:b] for row in first] for a, b in bounds(width, parts)]))
    out = []
    for block in _blocks(started):
        for _ in range(rounds):
            block = _refined(rows, block, scale)
        out += block
    return out


def encode(vectors: DataFrame, codebooks: list[Codebooks], scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(id, label, code, error, codebooks_sha256) of every kept vector.

    code has two hexadecimal digits a part, error is the sum of the parts' squared distances,
    cut to the range of a long.  Repeated rows are coded as often as they stand; vectors of a
    length without codebooks have nulls.  An empty vector has parts of no component and code 0s.
    """
    rows = kept(vectors, id_col, vector_col, label_col)
    schema = rows.select("id", "label").schema.add("code", "string").add("error", "long").add("codebooks_sha256", "string")
    out = rows.where(~F.col("width").isin([c.width for c in codebooks])).select(
        "id", "label", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[2:])
    )
    for block in _blocks(codebooks):

        def task(batches: Iterator[pa.RecordBatch], block: list[Codebooks] = block) -> Iterator[pa.RecordBatch]:
            coder = _Coder(block, scale)
            digests = {c.width: c.digest() for c in block}
            for batch in batches:
                for found, at, _, codes, squares in coder.batches(batch):
                    digits, n = codes.astype(np.uint8).tobytes().hex(), 2 * codes.shape[1]
                    errors = [min(int(x), HIGHEST) for x in squares.sum(axis=1).tolist()]
                    place = pa.array(at)
                    columns = [pa.array([digits[i : i + n] for i in range(0, len(digits), n)], pa.string()), pa.array(errors, pa.int64()), pa.array([digests[found.width]] * len(at), pa.string())]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(place), batch.column("label").take(place), *columns], names=schema.names)

        out = out.unionByName(_of(rows, block).mapInArrow(task, schema))
    return out


def _long(total: Column) -> Column:
    return F.when(total.isNotNull(), F.least(total, F.lit(HIGHEST).cast("decimal(38,0)"))).cast("long")


def quantize(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256): trains codebooks, codes all vectors and sums up the errors by label.

    Vectors that are null or hold a null or non-finite component are left out.  Equal labels
    share label_error, null labels together; it is cut to the range of a long.  Vectors are
    coded with others of their length.  Other columns, whatever their names, are not looked at;
    an empty table gives no rows.
    """
    codebooks = train(vectors, parts, entries, rounds, scale, id_col, vector_col)
    coded = written(encode(vectors, codebooks, scale, id_col, vector_col, label_col), "codes")
    # one row a label: Spark broadcasts the table if it is small and splits hot labels of the join if it is not
    totals = written(coded.groupBy("label").agg(_long(F.sum(F.col("error").cast("decimal(20,0)"))).alias("label_error")), "label-errors")
    (other,) = fresh(coded, "label")
    joined = coded.join(totals.withColumnRenamed("label", other), F.col("label").eqNullSafe(F.col(other)), "left")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
