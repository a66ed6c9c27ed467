"""Files that tasks write themselves, in the shared scratch folders of planwalk.sources.scratch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwalk.sources.scratch import scratch, shared_dir, written

__all__ = ["ROW", "file_system", "fresh", "in_sieve", "row_key", "scratch", "shared_dir", "sieve", "small_batches", "written"]

#: Columns by which a row of documents is known: two hashes of its id and text.
ROW = ["dk", "dk2"]
#: Bits of a sieve: 4 MB whatever the number of keys.
SIEVE_BITS = 1 << 25
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside hand texts to Python in batches of at most `rows` rows; the session's setting comes back afterwards."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI, usable inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that df does not have, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        found = f"_{name}"
        while found.lower() in taken:
            found = f"_{found}"
        taken.add(found.lower())
        out.append(found)
    return out


def row_key(id_col: str, text_col: str) -> list[Column]:
    """The columns ROW: 128 bits that rows share only if they repeat id and text."""
    return [F.xxhash64(id_col, text_col, F.lit(7)).alias("dk"), F.xxhash64(F.lit(11), text_col, id_col).alias("dk2")]


def _bit(key: str) -> Column:
    # Spark's bitmap functions number the bits from 1
    return F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS)) + 1


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the hashes of a column, in at most 1024 rows of 4 KB."""
    return keys.select(_bit(key).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))


def in_sieve(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """rows with `held`: false only if no key of the sieve equals the row's."""
    bit = _bit(key)
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(bit) == F.col("bucket"), "left").withColumn("held", held).drop("bucket", "bits")
