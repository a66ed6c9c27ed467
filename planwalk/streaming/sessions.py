"""Stateful streams: the walk of each session, its lifecycle, and windowed counts of readings.

Each has a batch twin in planwalk.operators; run to the end of what is there, a stream gives
the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwalk.operators.sessions import TRANSITIONS
from planwalk.sources.scratch import scratch, written

_NEXT = {(name, source): target for name, sources, target in TRANSITIONS for source in sources}


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files: the part files of a folder, or the single file of that name."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def walk_batch(calls: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (session_id, event_id, call_no) of one batch of calls, and what to keep: (session_id, held), the calls so far."""
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    before = kept.select(F.col("session_id").alias("_id"), "held")
    numbered = calls.withColumn("nth", F.row_number().over(order)).join(before, F.col("session_id").eqNullSafe(F.col("_id")), "left")
    rows = numbered.select("session_id", "event_id", (F.col("nth") + F.coalesce("held", F.lit(0))).cast("long").alias("call_no"))
    return rows, calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("held")).unionByName(kept).groupBy("session_id").agg(F.sum("held").alias("held"))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States after each action; sessions come one after another, each in order, in as many batches as it takes."""
    session, now = object(), "CREATED"
    for batch in batches:
        states, accepted = [], []
        for own, action, held in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            if own != session:
                session, now = own, held or "CREATED"
            after = _NEXT.get((action, now))
            accepted.append(after is not None)
            now = after or now
            states.append(now)
        columns = [batch.column(0), batch.column(1), pa.array(states, pa.string()), pa.array(accepted, pa.bool_()), batch.column(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["session_id", "event_id", "state", "accepted", "ts"])


def lifecycle_batch(calls: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (session_id, event_id, state, accepted) of one batch of calls, and what to keep: (session_id, held), the state reached."""
    before = kept.select(F.col("session_id").alias("_id"), "held")
    known = calls.join(before, F.col("session_id").eqNullSafe(F.col("_id")), "left").select("session_id", "event_id", "action", "held", "ts")
    kind = calls.schema["ts"].dataType.simpleString()
    followed = known.repartition("session_id").sortWithinPartitions("session_id", "ts", "event_id").mapInArrow(_follow, f"session_id long, event_id long, state string, accepted boolean, ts {kind}")
    followed = written(followed.withColumn("nth", F.monotonically_increasing_id()), "followed")
    # a session is in one partition, so its rows are numbered in their order
    reached = followed.groupBy("session_id").agg(F.max_by("state", "nth").alias("held"))
    others = kept.join(reached.select(F.col("session_id").alias("_id")), F.col("session_id").eqNullSafe(F.col("_id")), "left_anti")
    return followed.select("session_id", "event_id", "state", "accepted"), reached.unionByName(others)


#: Buckets of sessions by which kept state is written: a batch rewrites those alone in which it has calls.
BUCKETS = 64


def _there(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern matches, by the file system of the folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return [f.getPath().toString() for f in found or []]


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Kept:
    """State of sessions under a folder, in buckets by a hash of the session; for each batch a table tells which batch last wrote each bucket.

    A batch reads and rewrites only the buckets in which it has calls.  Its table of versions is
    written last, so a batch that was cut off is run again from the versions before it.  At
    most one row per bucket comes to the driver.
    """

    def __init__(self, spark: SparkSession, folder: str, held: str, buckets: int):
        self.spark, self.folder, self.schema, self.buckets = spark, folder, f"session_id long, held {held}", buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int")

    def versions(self, batch_id: int) -> dict[int, int]:
        """Bucket to the batch that wrote it last, as of the end of a batch."""
        if batch_id < 0:
            return {}
        return dict(self.spark.read.schema("bucket int, version long").parquet(f"{self.folder}/versions-{batch_id}").collect())

    def of(self, calls: DataFrame, batch_id: int) -> tuple[DataFrame, list[int]]:
        """What is kept of the sessions in the buckets of a batch's calls, and those buckets."""
        touched = sorted(r[0] for r in calls.select(self.bucket().alias("b")).distinct().collect())
        known = self.versions(batch_id - 1)
        paths = [f"{self.folder}/kept-{known[b]}/bucket={b}" for b in touched if b in known]
        return (self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)), touched

    def put(self, keep: DataFrame, touched: list[int], batch_id: int) -> None:
        """Writes the buckets of a batch, then its versions; then drops what no later run of a batch can ask for."""
        keep.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/kept-{batch_id}")
        before = self.versions(batch_id - 1)
        now = before | dict.fromkeys(touched, batch_id)
        self.spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions-{batch_id}")
        # this batch may still be run again, from the versions before it; the one before may not
        for b, version in self.versions(batch_id - 2).items() if batch_id >= 2 else ():
            if before[b] != version:
                _remove(self.spark, f"{self.folder}/kept-{version}/bucket={b}")

    def rows(self) -> list[str]:
        """Folders of the rows of all batches that were finished."""
        return [f"{self.folder}/rows-{v.rsplit('-', 1)[1].split('/')[0]}" for v in _there(self.spark, f"{self.folder}/versions-*/_SUCCESS")]


def drained_calls(calls: DataFrame, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], held: str, columns: str, name: str, folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Runs a stream of calls over all that is there: step(batch, kept) gives the rows of a batch and what is kept of each session.

    Within a batch, calls count in the order of (ts, event_id) whatever files and splits they
    come from; all that is there at the start is one batch.  Later batches carry on from what is kept.
    A batch that is run again replaces its own folders.  `folder`, in storage that all executors
    share, holds checkpoint, state and rows: a stream that is started again with the same folder
    takes what is new, and all rows so far come back.  Without one, each call has its own.
    """
    spark = calls.sparkSession
    out = folder or scratch(spark, name)

    def put(batch: DataFrame, batch_id: int) -> None:
        state, new = Kept(batch.sparkSession, out, held, buckets), written(batch, "calls")
        kept, touched = state.of(new, batch_id)
        rows, keep = step(new, kept)
        rows.write.mode("overwrite").parquet(f"{out}/rows-{batch_id}")
        state.put(keep, touched, batch_id)

    calls.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = Kept(spark, out, held, buckets).rows()
    return spark.read.schema(columns).parquet(*done) if done else spark.createDataFrame([], columns)


def walk(calls: DataFrame, folder: str | None = None) -> DataFrame:
    """(session_id, event_id, call_no): a stream of calls (session_id, event_id, ts) numbered per session, run over all that is there; with a folder it carries on from there."""
    return drained_calls(calls, walk_batch, "long", "session_id long, event_id long, call_no long", "walk", folder)


def lifecycle(calls: DataFrame, folder: str | None = None) -> DataFrame:
    """(session_id, event_id, state, accepted): every action of a stream (session_id, event_id, ts, action) with the state it leads to, run over all that is there; with a folder it carries on from there."""
    return drained_calls(calls, lifecycle_batch, "string", "session_id long, event_id long, state string, accepted boolean", "lifecycle", folder)


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Readings per source and tumbling window; readings later than `late` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("event_type").alias("source"), "n")


def drained_updates(stream: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Runs an aggregating stream over all that is there; the last value of each key."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(f"{out}/rows")

    stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in key]
    last = F.max_by(F.struct(*rest), "_batch")
    return spark.read.parquet(f"{out}/rows").groupBy(*key).agg(last.alias("v")).select(*key, "v.*").select(stream.columns)
