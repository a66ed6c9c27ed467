"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most `room` tokens.  The plan works on counts: lengths are
taken from the longest to the shortest, and all pieces of one length are put at once into
the fullest open sequences that still have room for them.  A plan row covers a run of equal
slots, so the plan's size depends on `room` alone, never on the number of documents.  Then
each piece takes the slot whose rank, within its length, is its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planwalk.llm import store, wordhash
from planwalk.llm.bitpack import with_end
from planwalk.llm.encoder import encoder

PIECES = "{id} long, piece int, start long, length long, ids_crc32 long"
#: Most rows of a plan that is broadcast: about 10 MB.
MOST_SLOTS = 200_000
PLAN = "length long, first_rank long, n_slots long, per_sequence long, first_sequence long, first_offset long"


def cut(total: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` tokens; only the first may be short."""
    first = total % room or room
    return [(0, min(first, total)), *((s, room) for s in range(first, total, room))] if total > room else [(0, total)]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, room: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every row's whole text, end_id after it: id_col, piece, start, length, ids_crc32.

    A null or empty text is one piece, the end id alone.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            keys = batch.column(0)
            data, offsets = wordhash.text_buffer(batch.column(1))
            for i, j in wordhash.segments(offsets):
                low = offsets[i]
                ids, counts = with_end(*enc.encode(data[low : offsets[j]], offsets[i : j + 1] - low), end_id)
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                row, piece, start, length, crc = [], [], [], [], []
                for r, n in enumerate(counts.tolist()):
                    for k, (s, size) in enumerate(cut(n, room)):
                        row.append(r)
                        piece.append(k)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * (at + s) : 4 * (at + s + size)]))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return rows.mapInArrow(task, PIECES.format(id=id_col))


def plan(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over the counts of lengths 1..room; rows of PLAN.

    Open sequences are kept as runs of equal ones: (first number, how many, tokens used), by
    the room left.  A length goes to the run with the least room that still holds it, each
    sequence of it takes as many as fit, and sequences that got fewer become runs of their own.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    open_runs: dict[int, list[tuple[int, int]]] = {}
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        fits = [r for r in sorted(open_runs) if r >= length]
        changed: list[tuple[int, int, int]] = []  # room left, first, how many
        while left:
            if fits:
                space = fits[0]
                first, n = open_runs[space].pop()
                if not open_runs[space]:
                    del open_runs[space]
                    fits.pop(0)
            else:
                space, first = room, opened
                n = -(-left // (room // length))
                opened += n
            each = space // length
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, whole * each, each, first, room - space))
                changed.append((space - each * length, first, whole))
                rank += whole * each
                left -= whole * each
            if whole < n and left:
                rows.append((length, rank, left, left, first + whole, room - space))
                changed.append((space - left * length, first + whole, 1))
                rank, left, whole = rank + left, 0, whole + 1
            if whole < n:
                changed.append((space, first + whole, n - whole))
        for space, first, n in changed:
            if space:
                open_runs.setdefault(space, []).append((first, n))
    return rows


def pack(parts: DataFrame, room: int, id_col: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to the pieces; every sequence is gapless from 0 and holds at most `room` tokens.

    The histogram (at most `room` rows) and the plan are the only rows that reach the driver.
    A piece's rank within its length is counted in hash buckets and the buckets' counts are
    summed up, so that a length which most pieces share is never in one task.
    """
    spark = parts.sparkSession
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = parts.withColumn("_b", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    cells = store.written(parts.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_b").orderBy(id_col, "piece", "ids_crc32")
    rows = plan(counts, room)
    slots = spark.createDataFrame(rows, PLAN).withColumnRenamed("length", "_length")
    # a few times `room` rows for any number of documents; a plan beyond MOST_SLOTS would be joined by length instead
    slots = F.broadcast(slots) if len(rows) <= MOST_SLOTS else slots
    return (
        parts.withColumn("_in", F.row_number().over(within) - 1)
        .join(cells, ["length", "_b"])
        .withColumn("_rank", F.col("_before") + F.col("_in"))
        .join(slots, F.expr("length = _length and _rank >= first_rank and _rank < first_rank + n_slots"))
        .withColumn("_slot", F.col("_rank") - F.col("first_rank"))
        .select(
            id_col, "piece", "start", "length", "ids_crc32",
            F.expr("first_sequence + _slot div per_sequence").alias("sequence_id"),
            F.expr("first_offset + (_slot % per_sequence) * length").alias("offset"),
        )
    )


def best_fit(docs: DataFrame, tokenizer_path: str, end_id: int, room: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts, plans and places every document: one row per piece with its sequence and offset.

    Nulls and empty texts are the end id alone; repeated rows are packed as often as they
    stand; an empty table gives no rows.
    """
    with store.small_batches(docs.sparkSession):
        parts = store.written(pieces(docs, tokenizer_path, end_id, room, id_col, text_col), "pieces")
    return pack(parts, room, id_col)


def sequences(layout: DataFrame, docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids; id_col must be unique in docs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            data, offsets = wordhash.text_buffer(batch.column(1))
            for i, j in wordhash.segments(offsets):
                low = offsets[i]
                ids, counts = with_end(*enc.encode(data[low : offsets[j]], offsets[i : j + 1] - low), end_id)
                at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], names=[id_col, "_ids"])

    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("t")).mapInArrow(task, f"{id_col} long, _ids array<int>")
    part = layout.join(texts, id_col).select("sequence_id", F.struct("offset", F.expr("slice(_ids, int(start) + 1, int(length))").alias("ids")).alias("p"))
    return part.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["ids"])).alias("ids"))
