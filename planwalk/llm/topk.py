"""Exact top-k by inner product over vectors in integer steps, with one KD-tree per shard.

A shard's tree splits at the median of the widest axis and keeps a tight box at every node.
The inner product of a query with any vector of a box is at most the sum over the axes of
the larger of query x low and query x high, so a best-first walk may stop at the first box
whose bound is below the k-th score.  Every tree is built once and written to the shared
folder; queries are dealt by shard and stream past the tree of theirs.

Shards are dealt by space: median splits of a bounded sample cut it into at most REGIONS
regions, and a region of many vectors has several shards.  Every region has a tight box over
all its vectors.  A query first searches one shard of the region with the highest bound; a
shard of any other region is visited only if the region's bound reaches the k-th score found
there, which is decided before any vector is sent to it, and the score goes along as a floor.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from planwalk.llm.store import file_system, fresh, scratch, written

LEAF = 64
#: Vectors in a shard, and queries that one task takes to a shard.
SHARD_ROWS = 16_384
PART_QUERIES = 65_536
#: Most vector lengths whose shard counts are broadcast, and most tasks of a search.
MANY_WIDTHS = 100_000
MOST_TASKS = 4096
#: Regions of space, of all lengths of vectors, and vectors of the sample that is split into them.
REGIONS = 1024
SAMPLE = 65_536
#: Components of region boxes that one scan of the queries takes along.
BOXES = 1 << 21
#: Steps below this are exact in floating point; scores are cut to the range of a long.
EXACT = 2.0**53
HIGHEST = (1 << 63) - 1


def whole_steps(row: np.ndarray, steps: int) -> list[int]:
    """floor(steps * x) of finite doubles of any size."""
    return [math.floor(p) if math.isfinite(p := float(x) * steps) else int(x) * steps for x in row.tolist()]


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query (row) and box (column) a number that no score of a vector in the box exceeds."""
    with np.errstate(all="ignore"):
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        largest = np.maximum(np.abs(low), np.abs(high))
        whole = np.abs(queries).max(axis=1) * largest.max(initial=0) * queries.shape[1] < EXACT
        # sums that are not exact may be off by so much
        off = np.abs(queries) @ largest.T * (queries.shape[1] * 2.0**-51)
        bounds = np.where(whole[:, None], bounds, bounds + off)
    bounds[~np.isfinite(bounds)] = np.inf
    return bounds


class Splits:
    """Median splits of a sample, the widest axis first, into about equal regions; node k is a region or has two children."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.axis: list[int] = []
        self.value: list[float] = []
        self.child: list[int] = []
        self.n = 0
        self._cut(sample, max(regions, 1))

    def _cut(self, part: np.ndarray, regions: int) -> None:
        node = len(self.axis)
        self.axis.append(-1)
        self.value.append(0.0)
        self.child.append(self.n)
        spread = part.max(axis=0) / 2 - part.min(axis=0) / 2 if len(part) and part.shape[1] else np.zeros(0)
        if regions > 1 and len(spread) and spread.max() > 0:
            axis = int(spread.argmax())
            middle = float(np.median(part[:, axis]))
            left = part[:, axis] < middle
            if not left.any():
                # at least half of the sample has the lowest value
                middle = float(part[part[:, axis] > part[:, axis].min(), axis].min())
                left = part[:, axis] < middle
            self.axis[node], self.value[node] = axis, middle
            self._cut(part[left], regions // 2)
            self.child[node] = len(self.axis)
            self._cut(part[~left], regions - regions // 2)
        else:
            self.n += 1

    def regions(self, rows: np.ndarray) -> np.ndarray:
        """The region of each row."""
        out = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.axis[node] < 0:
                out[at] = self.child[node]
            elif len(at):
                left = rows[at, self.axis[node]] < self.value[node]
                todo += [(node + 1, at[left]), (self.child[node], at[~left])]
        return out


class Tree:
    """KD-tree in arrays; node k is a leaf of rows[low:high] or has two children."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, steps: int):
        vectors = np.floor(self._scaled(raw, steps))
        self.rows = np.lexsort((ids,))
        self.low, self.high, self.box_low, self.box_high = [], [], [], []
        self.left: list[int] = []
        self._build(vectors, 0, len(ids))
        self._hold(ids[self.rows], raw[self.rows], steps, *map(np.array, (self.low, self.high, self.box_low, self.box_high, self.left)))

    @staticmethod
    def _scaled(raw: np.ndarray, steps: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return raw * float(steps)

    def _hold(self, ids, raw, steps, low, high, box_low, box_high, left) -> None:
        self.ids, self.raw, self.steps = ids, raw, int(steps)
        self.low, self.high, self.box_low, self.box_high, self.left = low, high, box_low, box_high, left.tolist()
        self.vectors = np.floor(self._scaled(raw, self.steps))
        self.largest = float(np.abs(self.vectors).max())

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, raw=self.raw, steps=self.steps, low=self.low, high=self.high, box_low=self.box_low, box_high=self.box_high, left=np.array(self.left))
        return out.getvalue()

    @classmethod
    def load(cls, content: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(content)) as z:
            tree._hold(*(z[k] for k in ("ids", "raw", "steps", "low", "high", "box_low", "box_high", "left")))
        return tree

    def _build(self, vectors: np.ndarray, low: int, high: int) -> int:
        node = len(self.low)
        part = vectors[self.rows[low:high]]
        self.low.append(low)
        self.high.append(high)
        self.box_low.append(part.min(axis=0))
        self.box_high.append(part.max(axis=0))
        self.left.append(-1)
        spread = self.box_high[node] - self.box_low[node]
        if high - low > LEAF and spread.max() > 0:
            axis = int(spread.argmax())
            middle = (high - low) // 2
            self.rows[low:high] = self.rows[low:high][np.argpartition(part[:, axis], middle)]
            self.left[node] = self._build(vectors, low, low + middle)
            right = self._build(vectors, low + middle, high)
            self.left[node] = self.left[node] * (1 << 32) + right
        return node

    def _scores(self, low: int, high: int, q: np.ndarray, exact_q: list[int], whole: bool, floor: float) -> Iterator[tuple[int, int]]:
        """(place, exact score) of the vectors of a leaf that may reach the floor."""
        part = self.vectors[low:high]
        with np.errstate(all="ignore"):
            scores = part @ q
            if whole:
                for at in np.flatnonzero(scores >= floor).tolist():
                    yield low + at, int(scores[at])
                return
            scores += np.abs(part) @ np.abs(q) * (len(q) * 2.0**-51)
        for at in np.flatnonzero(~np.isfinite(scores) | (scores >= floor)).tolist():
            yield low + at, sum(a * b for a, b in zip(exact_q, whole_steps(self.raw[low + at], self.steps), strict=True))

    def search(self, query_ids: np.ndarray, raw: np.ndarray, k: int, floors: list[int | None]) -> list[list[tuple[int, int]]]:
        """For each query its best (score, -id), at most k, of those that may reach the floor; a row of the query's own id is left out."""
        queries = np.floor(self._scaled(raw, self.steps))
        bounds = box_bounds(queries, self.box_low, self.box_high)
        with np.errstate(all="ignore"):
            whole = np.abs(queries).max(axis=1) * self.largest * queries.shape[1] < EXACT
        out = []
        for i in range(len(queries)):
            best: list[tuple[int, int]] = []
            floor = -math.inf if floors[i] is None else floors[i]
            exact_q = [] if whole[i] else whole_steps(raw[i], self.steps)
            open_nodes = [(-bounds[i, 0], 0)]
            while open_nodes:
                bound, node = heapq.heappop(open_nodes)
                if -bound < floor:
                    break
                children = self.left[node]
                if children >= 0:
                    for child in divmod(children, 1 << 32):
                        if bounds[i, child] >= floor:
                            heapq.heappush(open_nodes, (-bounds[i, child], child))
                    continue
                for at, score in self._scores(self.low[node], self.high[node], queries[i], exact_q, whole[i], floor):
                    found = (score, -int(self.ids[at]))
                    if -found[1] == int(query_ids[i]):
                        continue
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
                    if len(best) == k:
                        floor = max(floor, best[0][0])
            out.append(best)
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of doubles; those null, empty, or with a null or non-finite component are left out, and so are rows without an id."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.col(id_col).isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


def _trees(rows: DataFrame, steps: int) -> DataFrame:
    """(width, region, shard, path, low, high) of the trees of rows (width, region, shard, id, v), each in a file of its own, with their boxes; those of the attempts that Spark commits are listed."""
    out = scratch(rows.sparkSession, "trees")

    def task(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(shard["id"].to_numpy(), np.stack(shard["v"].to_list()), steps)
        uri = f"{out}/{'-'.join(map(str, key))}-{TaskContext.get().taskAttemptId()}.npz"
        fs, path = file_system(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as sink:
            sink.write(tree.dump())
        low, high = tree.raw.min(axis=0), tree.raw.max(axis=0)
        return pd.DataFrame({"width": [key[0]], "region": [key[1]], "shard": [key[2]], "path": [uri], "low": [low], "high": [high]})

    return written(rows.groupBy("width", "region", "shard").applyInPandas(task, "width int, region int, shard int, path string, low array<double>, high array<double>"), "tree-list")


def _regions(rows: DataFrame, splits: dict[int, Splits]) -> DataFrame:
    """rows (width, v, ..) with `region`, numbered within the length of vectors."""
    schema = StructType([*rows.schema.fields, StructField("region", IntegerType())])
    v, width = rows.columns.index("v"), rows.columns.index("width")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(width).to_numpy()
            values, at = batch.column(v).values.to_numpy(), batch.column(v).offsets.to_numpy()
            region = np.zeros(len(widths), np.int32)
            for w in np.unique(widths).tolist():
                if w in splits:
                    mine = np.flatnonzero(widths == w)
                    region[mine] = splits[w].regions(values[at[mine][:, None] + np.arange(w)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=schema.names)

    return rows.mapInArrow(task, schema)


def _splits(rows: DataFrame) -> dict[int, Splits]:
    """Splits for every length of vectors that has more than a shard of them, for the most frequent ones if there are very many."""
    sizes = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_ROWS).orderBy(F.desc("n"), "width").limit(REGIONS).collect()
    out = {}
    for r in sizes:
        share = min(1.0, SAMPLE / max(1, len(sizes)) / r["n"])
        # a bounded sample says where to cut; every vector is then dealt, and boxes are those of all vectors
        sample = rows.where(F.col("width") == r["width"]).sample(share, seed=7).select("v").limit(SAMPLE).collect()
        regions = min(max(1, REGIONS // len(sizes)), -(-r["n"] // SHARD_ROWS))
        out[r["width"]] = Splits(np.array([x["v"] for x in sample], dtype=float).reshape(len(sample), r["width"]), regions)
    return out


def _reached(queries: DataFrame, boxes: DataFrame, steps: int, home: bool) -> DataFrame:
    """(qid, region, last, bound): the regions of their length whose bound reaches the floor of queries (qid, width, v, floor), or for `home` the one with the highest bound.

    At most BOXES components of boxes are sent along with a scan; further boxes have scans of
    their own, and each of these has its own best region.
    """
    schema = "qid long, region int, last int, bound double"

    def scan(sides: dict[int, tuple[np.ndarray, ...]]):
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for width, part in batch.groupby("width", sort=False):
                    region, last, low, high = sides[width]
                    with np.errstate(over="ignore"):
                        bounds = box_bounds(np.floor(np.stack(part["v"].to_list()) * float(steps)), *(np.floor(x * float(steps)) for x in (low, high)))
                    if home:
                        pairs = np.zeros(bounds.shape, dtype=bool)
                        pairs[np.arange(len(part)), bounds.argmax(axis=1)] = True
                    else:
                        # the floor as a double, and a hair less, so that no rounding hides a region
                        floor = part["floor"].to_numpy(np.float64, na_value=np.nan)
                        pairs = np.isnan(floor)[:, None] | (bounds >= (floor - np.abs(floor) * 2.0**-51)[:, None])
                    q, r = np.nonzero(pairs)
                    yield pd.DataFrame({"qid": part["qid"].to_numpy()[q], "region": region[r], "last": last[r], "bound": bounds[q, r]})

        return task

    total = boxes.agg(F.sum(F.col("width").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // BOXES))
    out = queries.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        sides = {}
        for r in boxes.where(F.pmod(F.xxhash64("width", "region"), F.lit(blocks)) == b).collect():
            sides.setdefault(r["width"], []).append((r["region"], r["last"], r["low"], r["high"]))
        sides = {w: tuple(map(np.array, zip(*own, strict=True))) for w, own in sides.items()}
        asked = queries.where(F.col("width").isin(list(sides))).select("qid", "width", "v", "floor")
        out = out.unionByName(asked.mapInPandas(scan(sides), schema))
    return out


def _search(k: int):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tree = None, None
        for batch in batches:
            columns: dict[str, list[int]] = {"qid": [], "vec_id": [], "score": []}
            for uri, part in batch.groupby("path", sort=False):
                if uri != held:
                    fs, path = file_system(uri)
                    with fs.open_input_stream(path) as source:
                        held, tree = uri, Tree.load(source.read())
                floors = [None if pd.isna(x) else int(x) for x in part["floor"].tolist()]
                found = tree.search(part["id"].to_numpy(), np.stack(part["v"].to_list()), k, floors)
                for qid, best in zip(part["qid"].tolist(), found, strict=True):
                    for score, minus in best:
                        columns["qid"].append(qid)
                        columns["vec_id"].append(-minus)
                        columns["score"].append(max(-HIGHEST - 1, min(HIGHEST, score)))
            yield pd.DataFrame(columns, dtype="int64")

    return task


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, steps: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which is_query holds, the k rows of any other id with the largest inner product.

    A query is a row: rows that repeat id and vector have their list once each, and rows that
    share an id but not the vector have lists of their own.  Candidates that repeat an id count
    each for itself, and a query never meets rows of its own id.  Ties go to the smaller id;
    fewer rows are returned where there are fewer.  Vectors are compared with those of the same
    length; empty ones take no part.  Components of any finite size are taken and scores are
    added up exactly; a score beyond a long is cut to its range, where ties again go to the
    smaller id.  Other columns, whatever their names, are not looked at.
    """
    (flag,) = fresh(vectors, "q")
    marked = vectors.withColumn(flag, F.coalesce(is_query, F.lit(False)))
    width = F.size("v").alias("width")
    rows = written(usable(marked, id_col, vector_col).select("*", width), "vectors")
    rows = written(_regions(rows, _splits(rows)).withColumn("at", F.monotonically_increasing_id()), "regions")
    # equal queries are one until the end; rows of a written table keep their numbers
    asked = usable(marked.where(flag), id_col, vector_col).groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))
    asked = written(asked.select("id", "v", width, "copies", F.monotonically_increasing_id().alias("qid")), "queries")
    large = F.exists("v", lambda x: F.abs(x) * steps >= float(1 << 20))
    # one row per region; large vectors have shards of their own, after the others
    n_of = lambda c: F.ceil(F.count(F.when(c, 1)) / SHARD_ROWS).cast("int")
    sizes = written(rows.groupBy("width", "region").agg(n_of(~large).alias("small"), n_of(large).alias("more")), "shard-counts")
    n_shards = sizes.agg(F.sum(F.col("small") + F.col("more"))).first()[0] or 0
    sizes = F.broadcast(sizes) if sizes.count() <= MANY_WIDTHS else sizes
    bucket = lambda n: F.pmod(F.xxhash64("at"), F.greatest(n, F.lit(1))).cast("int")
    dealt = rows.join(sizes, ["width", "region"]).withColumn("shard", F.when(large, F.col("small") + bucket(F.col("more"))).otherwise(bucket(F.col("small"))))
    trees = _trees(dealt.select("width", "region", "shard", "id", "v"), steps)
    # by axis first, so that a region of many shards is no group of many arrays
    axes = trees.select("width", "region", "shard", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "side"))
    axes = axes.groupBy("width", "region", "axis").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"), F.max("shard").alias("last"))
    box = axes.groupBy("width", "region").agg(F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("axis", "low", "high"))).alias("side"))
    boxes = written(box.select("width", "region", "last", F.col("side.low").alias("low"), F.col("side.high").alias("high")), "boxes")
    parts = -(-asked.count() // PART_QUERIES) or 1
    key = ["width", "region", "shard", "part"]
    of_parts = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(*key, "path")
    part = F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part")

    def search(pairs: DataFrame) -> DataFrame:
        """Pairs are (qid, region, shard, floor); a query's vector is sent to the shards of its pairs alone."""
        sent = pairs.join(asked.select("qid", "width", "id", "v", part), "qid").join(of_parts, key).select(*key, "path", "qid", "id", "v", "floor")
        sent = sent.repartition(max(1, min(n_shards * parts, MOST_TASKS)), *key).sortWithinPartitions(*key)
        return sent.mapInPandas(_search(k), "qid long, vec_id long, score long")

    none = F.lit(None).cast("long").alias("floor")
    first = _reached(asked.withColumn("floor", none), boxes, steps, home=True).groupBy("qid").agg(F.max(F.struct("bound", "region", "last")).alias("b"))
    home = first.select("qid", F.col("b.region").alias("region"), F.pmod(F.xxhash64("qid", F.lit(3)), F.col("b.last") + 1).cast("int").alias("shard"))
    home = written(home, "homes")
    near = written(_best(search(home.select("*", none)), k).drop("rank"), "near")
    # a score that was cut to the range of a long is no floor
    inside = (F.col("floor") < HIGHEST) & (F.col("floor") > -HIGHEST - 1)
    floors = near.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor")).withColumn("floor", F.when(inside, F.col("floor")))
    left = _reached(asked.join(floors, "qid", "left"), boxes, steps, home=False).join(floors, "qid", "left")
    left = left.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).select("qid", "region", "shard", "floor")
    rest = left.join(home, ["qid", "region", "shard"], "left_anti")
    found = _best(near.unionByName(search(rest)), k).join(asked.select("qid", F.col("id").alias("query_id"), "copies"), "qid")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
