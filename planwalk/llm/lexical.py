"""Ranked lexical search over an index that is stratified by document length.

The score of a term in a document depends on nothing but its weight, its frequency tf and the
document's length normaliser m.  So documents are grouped into strata of equal m, postings of
a term within a stratum are listed by tf, and the impact of a tf is computed once for the
stratum.  The largest tf of each term of a query bounds the scores of a stratum; strata are
visited in the order of their bounds, a few at first and twice as many each time, until the
next bound is below the k-th score.

The index is dealt into shards of bounded size, each in a file of its own in the shared
folder.  All queries first search one shard; the k-th score found there goes along to all
others as their first floor.  Queries are dealt into files of bounded size too, so that a task
reads one file of each and no query travels once per shard.

Terms are told apart by 64-bit hashes: V terms of queries and D terms of documents share one
by accident with a probability of V * D / 2^64, and never if they have up to eight bytes.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from planwalk.llm import shingles, wordhash
from planwalk.llm.store import file_system, scratch, small_batches, written

#: Bytes between terms: all of ASCII but digits and letters.
SEPARATOR = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: Postings and documents of a shard, and terms of the queries in a file.
SHARD_POSTINGS = 2_000_000
SHARD_DOCS = 65_536
BLOCK_TERMS = 200_000
#: Distinct terms of queries up to which only their postings are made; beyond, all terms are indexed.
MOST_TERMS = 1 << 21
MOST_TASKS = 4096
#: Fixed values of the score.
UNIT = 1_000_000_000
SLOPE = 12


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after the other, and how many each range has."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    n = int(total[-1]) if len(total) else 0
    return np.arange(n) + np.repeat(starts - (total - sizes), sizes), sizes


def counted(rows: DataFrame, text_col: str, vocabulary: np.ndarray | None) -> DataFrame:
    """The other columns of rows with n (terms of the whole text, with repeats), and the hashes and frequencies of the distinct terms that are in the vocabulary.

    `part` and `at`, the task and the row's place in it, number the rows; write the result to keep them.
    """
    kept = [c for c in rows.columns if c != text_col]
    added = StructType.fromDDL("part int, at long, n long, terms array<long>, tfs array<long>")
    schema = StructType(rows.select(*kept).schema.fields + added.fields)

    def of_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = np.zeros(len(offsets) - 1, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, j, low, high in wordhash.pieces(data, offsets, SEPARATOR):
            part = shingles.LOWER[data[low:high]]
            own = np.clip(offsets[i : j + 1], low, high) - low
            starts, ends, at = wordhash.words(part, own, SEPARATOR)
            n[i:j] += np.bincount(at, minlength=j - i)
            hashes = wordhash.hashes(part, starts, ends).view(np.int64)
            if vocabulary is not None:
                place = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                held = vocabulary[place] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                hashes, at = hashes[held], at[held]
            found.append(_tallied(at + i, hashes, np.ones(len(at), np.int64)))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return (n, *_tallied(*columns))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.num_rows
            n, rows_of, terms, tfs = of_rows(*wordhash.text_buffer(batch.column(text_col)))
            ends = pa.array(np.searchsorted(rows_of, np.arange(size + 1)).astype(np.int32))
            added = [pa.array(np.full(size, part, np.int32)), pa.array(np.arange(done, done + size)), pa.array(n)]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *added, *lists], names=schema.names)
            done += size

    with small_batches(rows.sparkSession):
        return written(rows.select(*kept, text_col).mapInArrow(task, schema), "term-counts")


def _tallied(rows: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) sorted by row and term, with equal ones added up."""
    order = np.lexsort((terms, rows))
    rows, terms, tfs = rows[order], terms[order], tfs[order]
    if not len(rows):
        return rows, terms, tfs
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1]))))
    return rows[first], terms[first], np.add.reduceat(tfs, first)


class Shard:
    """Documents sorted by m and id, and their postings by term, stratum and falling tf, in runs of equal tf."""

    NAMES = ("ids", "has_id", "stratum_of", "terms", "term_at", "group_stratum", "group_at", "impacts", "run_at", "docs")

    def __init__(self, *arrays: np.ndarray):
        for name, array in zip(self.NAMES, arrays, strict=True):
            setattr(self, name, array)
        self.n_strata = int(self.stratum_of[-1]) + 1 if len(self.stratum_of) else 0

    @classmethod
    def build(cls, ids: np.ndarray, has_id: np.ndarray, m: np.ndarray, lists_at: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> Shard:
        """lists_at are the bounds of the documents' terms and tfs."""
        order = np.lexsort((ids, ~has_id, m))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        normalisers, stratum_of = np.unique(m[order], return_inverse=True)
        doc = np.repeat(place, np.diff(lists_at))
        stratum = stratum_of[doc]
        by = np.lexsort((doc, -tfs, stratum, terms))
        doc, stratum, terms, tfs = doc[by], stratum[by], terms[by], tfs[by]
        new_term, new_group, new_run = (np.ones(len(by), bool) for _ in range(3))
        new_term[1:] = terms[1:] != terms[:-1]
        new_group[1:] = new_term[1:] | (stratum[1:] != stratum[:-1])
        new_run[1:] = new_group[1:] | (tfs[1:] != tfs[:-1])
        term_at, group_at, run_at = (np.flatnonzero(x) for x in (new_term, new_group, new_run))
        # a tf's impact is computed once in a stratum, whatever the number of terms that have it
        pairs, which = np.unique(np.stack((stratum[run_at], tfs[run_at]), axis=1), axis=0, return_inverse=True)
        impact = UNIT * pairs[:, 1] // (1000 * pairs[:, 1] + SLOPE * normalisers[pairs[:, 0]])
        ended = lambda x, n: np.append(x, n)
        return cls(
            ids[order], has_id[order], stratum_of, terms[term_at],
            ended(np.searchsorted(group_at, term_at), len(group_at)),
            stratum[group_at],
            ended(np.searchsorted(run_at, group_at), len(run_at)),
            impact[which.reshape(-1)],
            ended(run_at, len(doc)),
            doc,
        )

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.NAMES})
        return out.getvalue()

    @classmethod
    def load(cls, content: bytes) -> Shard:
        with np.load(io.BytesIO(content)) as z:
            return cls(*(z[name] for name in cls.NAMES))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best with a score of at least floor and above 0, best first; ties by id, null ids last."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        held = (self.terms[at] == terms) & (weights > 0) if len(self.terms) else np.zeros(len(terms), bool)
        groups, sizes = ranges(self.term_at[at[held]], self.term_at[at[held] + 1])
        weight, strata = np.repeat(weights[held], sizes), self.group_stratum[groups]
        bounds = np.zeros(self.n_strata, np.int64)
        # the first run of a group has the term's largest tf in the stratum
        np.add.at(bounds, strata, weight * self.impacts[self.group_at[groups]])
        order = np.argsort(-bounds, kind="stable")
        floor, done, wave = max(floor, 1), 0, 4
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while done < len(order):
            visit = order[done : done + wave]
            visit = visit[bounds[visit] >= floor]
            if not len(visit):
                break
            done, wave = done + len(visit), 2 * wave
            chosen = np.zeros(self.n_strata, bool)
            chosen[visit] = True
            mine = chosen[strata]
            runs, n_runs = ranges(self.group_at[groups[mine]], self.group_at[groups[mine] + 1])
            gains = np.repeat(weight[mine], n_runs) * self.impacts[runs]
            places, n_docs = ranges(self.run_at[runs], self.run_at[runs + 1])
            total = np.zeros(len(self.ids), np.int64)
            np.add.at(total, self.docs[places], np.repeat(gains, n_docs))
            found = np.flatnonzero(total >= floor)
            best, scores = self._best(np.concatenate((best, found)), np.concatenate((scores, total[found])), k)
            if len(best) == k:
                floor = max(floor, int(scores[-1]))
        return best, scores

    def _best(self, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(docs) > k:
            may = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            docs, scores = docs[may], scores[may]
        order = np.lexsort((self.ids[docs], ~self.has_id[docs], -scores))[:k]
        return docs[order], scores[order]


def _file(folder: str, name: str, content: bytes) -> str:
    """Writes a file under a name of this attempt's own; those of the attempts that Spark commits are listed."""
    uri = f"{folder}/{name}-{TaskContext.get().taskAttemptId()}.npz"
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as sink:
        sink.write(content)
    return uri


def _content(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_stream(path, compression=None) as source:
        return source.read()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _lists(table: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    """Bounds of the rows' lists and the values of each column, which have lists of equal lengths and no nulls."""
    columns = [table.column(n).combine_chunks() for n in names]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    at = columns[0].offsets.to_numpy()
    return (at - at[0], *(c.flatten().to_numpy(zero_copy_only=False) for c in columns))


def _listed(out: DataFrame, key: str, build, name: str) -> DataFrame:
    """(key, path) of the files that build(table) makes of each group of out."""
    folder = scratch(out.sparkSession, name)

    def task(table: pa.Table) -> pa.Table:
        which = table.column(key)[0].as_py()
        return pa.table({key: pa.array([which], pa.int32()), "path": [_file(folder, str(which), build(table))]})

    return written(out.groupBy(key).applyInArrow(task, f"{key} int, path string"), name)


def _shard(table: pa.Table) -> bytes:
    at, terms, tfs = _lists(table, "terms", "tfs")
    ids = table.column("id").combine_chunks()
    has_id = np.asarray(ids.is_valid())
    return Shard.build(ids.fill_null(0).to_numpy(zero_copy_only=False), has_id, _numbers(table, "m"), at, terms, tfs).dump()


class Index:
    """The shards' files and the weight of every indexed term."""

    def __init__(self, shards: DataFrame, n_shards: int, weights: DataFrame):
        self.shards, self.n_shards, self.weights = shards, n_shards, weights


def build(docs: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Indexes whole texts; with a vocabulary (sorted term hashes) only its postings, though lengths and counts are of all terms.

    Documents without a term, nulls among them, are not in the index and do not count.
    """
    rows = counted(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), "t", vocabulary).where("n > 0")
    size = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length"), F.sum(F.size("terms")).alias("postings")).first()
    n_docs, length = size["docs"], size["length"] or 1
    # double division and logarithm, as the weight is defined
    share = F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = written(df.select("term", F.floor(1000 * F.log(share)).cast("long").alias("w")), "weights")
    n_shards = max(-(-(size["postings"] or 0) // SHARD_POSTINGS), -(-n_docs // SHARD_DOCS), 1)
    dealt = rows.where(F.size("terms") > 0).select(
        F.pmod(F.xxhash64("part", "at"), F.lit(n_shards)).cast("int").alias("shard"), "id",
        (75 + F.expr(f"(25 * n * {n_docs}L) div {length}L")).cast("long").alias("m"), "terms", "tfs",
    )
    return Index(_listed(dealt, "shard", _shard, "shards"), n_shards, weights)


def _block(table: pa.Table) -> bytes:
    at, terms, weights = _lists(table, "terms", "weights")
    out = io.BytesIO()
    np.savez(out, qid=_numbers(table, "qid"), floor=_numbers(table, "floor"), at=at, terms=terms, weights=weights)
    return out.getvalue()


def _found(k: int):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held = None, None
        for batch in batches:
            for path, block in zip(batch["path"], batch["block_path"], strict=True):
                if path != held:
                    shard, held = Shard.load(_content(path)), path
                out: list[tuple[np.ndarray, ...]] = []
                with np.load(io.BytesIO(_content(block))) as z:
                    qids, floors, at, terms, weights = (z[n] for n in ("qid", "floor", "at", "terms", "weights"))
                for q, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    docs, scores = shard.search(terms[a:b], weights[a:b], k, int(floors[q]))
                    out.append((np.full(len(docs), qids[q]), shard.ids[docs], shard.has_id[docs], scores))
                qid, ids, has_id, score = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"qid": qid, "id": pd.Series(ids, dtype="Int64").where(has_id), "score": score})

    return task


_FOUND = "qid long, id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, score): the k best documents for each row of queries (qid, terms, tfs), with a score above 0."""
    spark: SparkSession = queries.sparkSession
    terms = queries.select("qid", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("qid", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    # a term that many queries share meets one row of weights; Spark broadcasts them or splits it
    weighed = terms.join(index.weights, "term").withColumn("weight", F.col("tf") * F.col("w")).where("weight > 0")
    asked = weighed.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("x"))
    asked = written(asked.select("qid", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights")), "weighed-queries")
    n_blocks = max(-(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS), 1)
    block: Column = F.pmod(F.xxhash64("qid"), F.lit(n_blocks)).cast("int").alias("block")

    def look(shards: DataFrame, floors: DataFrame | None, n_shards: int) -> DataFrame:
        floor = F.coalesce("floor", F.lit(1).cast("long")).alias("floor") if floors is not None else F.lit(1).cast("long").alias("floor")
        rows = (asked.join(floors, "qid", "left") if floors is not None else asked).select(block, "qid", floor, "terms", "weights")
        files = _listed(rows, "block", _block, "queries").withColumnRenamed("path", "block_path")
        pairs = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(files, "block").select("shard", "path", "block", "block_path")
        pairs = pairs.repartition(max(1, min(n_shards * n_blocks, MOST_TASKS)), "shard", "block").sortWithinPartitions("shard", "block")
        return pairs.mapInPandas(_found(k), _FOUND)

    near = written(_best(look(index.shards.where("shard = 0"), None, 1), k).drop("rank"), "near")
    if index.n_shards == 1:
        return _best(near, k).select("qid", "rank", "id", "score")
    floors = near.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    rest = written(look(index.shards.where("shard > 0"), floors, index.n_shards - 1), "rest")
    return _best(near.unionByName(rest), k).select("qid", "rank", "id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): the k best documents for each item, equal scores by ascending id, null ids last.

    An item is a row: rows that repeat id and text have their list once each, and rows that
    share an id have lists of their own.  Documents that share an id are ranked each for
    itself.  Items without a term, nulls among them, and items whose terms score nothing have
    no rows; neither have empty tables.  Texts may be of any length; other columns, whatever
    their names, are not looked at.
    """
    rows = items.groupBy(F.col(item_col).alias("item"), F.col(item_text_col).alias("t")).agg(F.count(F.lit(1)).alias("copies"))
    queries = counted(rows, "t", None).withColumn("qid", F.shiftleft(F.col("part").cast("long"), 40).bitwiseOR(F.col("at")))
    terms = queries.select(F.explode("terms").alias("term")).distinct().limit(MOST_TERMS + 1)
    vocabulary = np.sort(terms.toPandas()["term"].to_numpy(np.int64))
    index = build(docs, vocabulary if len(vocabulary) <= MOST_TERMS else None, id_col, text_col)
    found = search(index, queries.select("qid", "terms", "tfs"), k).join(queries.select("qid", "item", "copies"), "qid")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
