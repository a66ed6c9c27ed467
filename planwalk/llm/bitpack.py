"""Token-ID output: ids in the fewest bits that hold the vocabulary, in blocks with offsets.

A shard file holds, in order: the mark, the bit width and the block size (two unsigned
32-bit integers), the blocks, the footer and the tail.  Each block packs `block_ids` ids
(the last one fewer) and starts on a byte, so any id is found from the block offsets alone
and a block unpacks with a few numpy operations.  The footer has doc_id (signed 64-bit), a
byte that tells whether doc_id is there, the number of ids of each document (signed 64-bit)
and the byte offset of each block; the tail has the counts of documents, blocks and ids, the
footer's offset and the mark again.  All integers are little-endian.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwalk.llm import store, wordhash
from planwalk.llm.encoder import encoder

MARK = b"BITIDS01"
BLOCK_IDS = 1 << 16
#: Bytes of ids in one Arrow batch that a reader hands to Spark.
BATCH_BYTES = 4 << 20
MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"


def bit_width(vocab_size: int) -> int:
    """Fewest bits that hold every id below vocab_size, at least one."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as a little-endian bit stream of `bits` bits each; 8 ids fill `bits` bytes."""
    lanes = np.zeros((-len(ids) % 8 + len(ids)) // 8 * 8, dtype=np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, 8)
    out = np.zeros((len(lanes), bits), dtype=np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, byte + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[: (len(ids) * bits + 7) // 8]


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of a block written by pack."""
    groups = (n + 7) // 8
    buffer = np.zeros(groups * bits, dtype=np.uint8)
    buffer[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)[: len(buffer)]
    buffer = buffer.reshape(groups, bits)
    out = np.empty((groups, 8), dtype=np.uint32)
    low = np.uint64((1 << bits) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = np.zeros(groups, dtype=np.uint64)
        for k in range((shift + bits + 7) // 8):
            value |= buffer[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & low
    return out.reshape(-1)[:n]


class ShardWriter:
    """Writes one shard; add() takes rows in order, close() the footer."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.offsets: list[int] = []
        self.doc_ids: list[np.ndarray] = []
        self.present: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        head = MARK + np.array([bits, block_ids], dtype="<u4").tobytes()
        sink.write(head)
        self.at = len(head)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for i in range(0, end, self.block_ids):
            raw = pack(ids[i : min(i + self.block_ids, end)], self.bits)
            self.offsets.append(self.at)
            self.sink.write(raw)
            self.at += len(raw)
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def add(self, doc_ids: np.ndarray, present: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.present.append(present)
        self.counts.append(counts)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block_ids:
            self._blocks(last=False)

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes) written."""
        self._blocks(last=True)
        n_docs = sum(map(len, self.counts))
        footer = b"".join(
            [
                *(x.astype("<i8").tobytes() for x in self.doc_ids),
                *(x.astype("u1").tobytes() for x in self.present),
                *(x.astype("<i8").tobytes() for x in self.counts),
                np.array(self.offsets, dtype="<i8").tobytes(),
            ]
        )
        tail = np.array([n_docs, len(self.offsets), self.n_ids, self.at], dtype="<i8").tobytes() + MARK
        self.sink.write(footer + tail)
        return n_docs, self.n_ids, self.at + len(footer) + len(tail)


class ShardReader:
    """Random access to one shard over a seekable source."""

    TAIL = 4 * 8 + len(MARK)

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(0)
        head = source.read(len(MARK) + 8)
        source.seek(size - self.TAIL)
        tail = source.read(self.TAIL)
        if head[: len(MARK)] != MARK or tail[-len(MARK) :] != MARK:
            raise ValueError("not a shard of token ids")
        self.bits, self.block_ids = np.frombuffer(head, "<u4", 2, len(MARK)).tolist()
        n_docs, n_blocks, self.n_ids, self.footer_at = np.frombuffer(tail, "<i8", 4).tolist()
        source.seek(self.footer_at)
        footer = source.read(size - self.TAIL - self.footer_at)
        self.doc_ids = np.frombuffer(footer, "<i8", n_docs)
        self.present = np.frombuffer(footer, "u1", n_docs, 8 * n_docs).astype(bool)
        self.counts = np.frombuffer(footer, "<i8", n_docs, 9 * n_docs)
        self.offsets = np.frombuffer(footer, "<i8", n_blocks, 17 * n_docs)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] of the shard; reads only the blocks that hold them."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        low = int(self.offsets[first])
        high = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.footer_at
        self.source.seek(low)
        raw = self.source.read(high - low)
        parts = []
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            at = int(self.offsets[b]) - low
            parts.append(unpack(raw[at : at + (n * self.bits + 7) // 8], n, self.bits))
        shift = first * self.block_ids
        return np.concatenate(parts)[start - shift : stop - shift]

    def document(self, i: int) -> np.ndarray:
        """ids of the shard's i-th document."""
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """end_id put after each row's ids."""
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


def write_shards(docs: DataFrame, tokenizer_path: str, out: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every row's whole text and writes shards of packed ids under the URI `out`, in ascending order of id_col.

    Rows are dealt by ranges of id_col, so shard k holds smaller ids than shard k + 1; a task
    writes one file under a name of its own attempt, and the manifest (a Parquet table under
    `out`, one row per shard) names the files of the attempts that Spark committed.
    A null or empty text is the end id alone.  Rows that repeat an id keep their places, in
    the order of their texts; a null id comes first.  An empty table writes no shard.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        bits = bit_width(max(enc.vocab_size, end_id + 1))
        context = TaskContext.get()
        shard = context.partitionId()
        uri = f"{out}/ids-{shard:06d}-{context.taskAttemptId()}.bin"
        writer = sink = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, path = store.file_system(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                sink = fs.open_output_stream(path)
                writer = ShardWriter(sink, bits)
            key = batch.column(0)
            data, offsets = wordhash.text_buffer(batch.column(1))
            for i, j in wordhash.segments(offsets):
                low = offsets[i]
                ids, counts = with_end(*enc.encode(data[low : offsets[j]], offsets[i : j + 1] - low), end_id)
                part = key.slice(i, j - i)
                writer.add(part.fill_null(0).to_numpy(zero_copy_only=False), ~np.asarray(part.is_null()), counts, ids)
        if writer is not None:
            n_docs, n_ids, n_bytes = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [uri], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [n_bytes]})

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    rows.repartitionByRange("k").sortWithinPartitions("k", "t").mapInArrow(task, MANIFEST).write.parquet(f"{out}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{out}/manifest")


def read_shards(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the shards under `out`: id_col, start (ids before it in all shards), n_tokens, ids (little-endian unsigned 32-bit integers)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard file: a few thousand at most
    manifest = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(1, manifest.count())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = store.file_system(row["path"])
                with fs.open_input_file(path) as source:
                    yield from _documents(ShardReader(source), row["first"], id_col)

    return manifest.repartitionByRange(n, "shard").mapInArrow(task, f"{id_col} long, start long, n_tokens long, ids binary")


def _documents(reader: ShardReader, first: int, id_col: str) -> Iterator[pa.RecordBatch]:
    i, n = 0, len(reader.counts)
    while i < n:
        j = int(np.searchsorted(reader.starts, reader.starts[i] + BATCH_BYTES // 4, side="right")) - 1
        j = min(max(j, i + 1), n)
        raw = reader.ids(int(reader.starts[i]), int(reader.starts[j])).astype("<u4").tobytes()
        at = (reader.starts[i : j + 1] - reader.starts[i]) * 4
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at.astype("<i8").tobytes()), pa.py_buffer(raw)])
        doc_ids = pa.array(reader.doc_ids[i:j], mask=~reader.present[i:j])
        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(reader.starts[i:j] + first), pa.array(reader.counts[i:j]), ids.cast(pa.binary())], names=[id_col, "start", "n_tokens", "ids"])
        i = j
