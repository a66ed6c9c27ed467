"""Repository shapes as table operations: append, look up, update, delete with children, nested reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered(rows: DataFrame, order: str, **equal: object) -> DataFrame:
    """Rows with the given values (None is no filter), in ascending order of a column."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(order)


def by_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the keys."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def update(rows: DataFrame, where: Column, values: dict[str, Column], revision: str | None = None) -> DataFrame:
    """All rows, those that `where` selects with new values and, if named, the revision raised by one."""
    hit = F.coalesce(where, F.lit(False))
    new = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}
    if revision:
        new[revision] = F.when(hit, F.col(revision) + 1).otherwise(F.col(revision))
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in rows.columns))


def cascade(children: DataFrame, gone: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent has not been deleted."""
    return children.join(gone.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def unique_violations(rows: DataFrame, *key: str) -> DataFrame:
    """(key, n): keys that stand in more than one row."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: Bits of the bitmap of a table's keys: 4 MB whatever the number of rows.
KEY_BITS = 1 << 25


def _new_keys(rows: DataFrame, existing: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """rows with `_has`: whether the table has their key.  Only rows whose bit is set in a bitmap of the table's keys take part in the join."""
    bit = F.pmod(F.xxhash64(*key), F.lit(KEY_BITS)) + 1
    bits = existing.select(bit.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("_k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("_bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    marked = rows.join(F.broadcast(bits), F.bitmap_bucket_number(bit) == F.col("_k"), "left").withColumn("_may", may).drop("_k", "_bits")
    held = existing.select(*(F.col(c).alias(f"_e{n}") for n, c in enumerate(key))).distinct().withColumn("_there", F.lit(True))
    same = F.lit(True)
    for n, c in enumerate(key):
        same &= F.col(c).eqNullSafe(F.col(f"_e{n}"))
    asked = marked.where("_may").join(held, same, "left").withColumn("_has", F.coalesce("_there", F.lit(False))).drop("_there", *(f"_e{n}" for n in range(len(key))))
    return asked.unionByName(marked.where("NOT _may").withColumn("_has", F.lit(False))).drop("_may")


def insert_unique(rows: DataFrame, new: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of the new rows: rejected ones repeat a key of the table or of an earlier new row in the order of all columns.

    Equal keys are compared with nulls equal.  Rows are counted and reduced to the first of
    their key before anything is ordered, so a key that most rows share is in no one task.
    """
    columns = list(new.columns)
    whole = F.struct(*columns)
    counted = new.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    first = counted.groupBy(*(F.col(c).alias(f"_f{n}") for n, c in enumerate(key))).agg(F.min(whole).alias("_first"))
    same = F.lit(True)
    for n, c in enumerate(key):
        same &= F.col(c).eqNullSafe(F.col(f"_f{n}"))
    marked = _new_keys(counted.join(first, same), rows, key).withColumn("_ok", ~F.col("_has") & whole.eqNullSafe(F.col("_first")))
    left = F.col("_n") - F.col("_ok").cast("long")
    rejected = marked.where(left > 0).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    return marked.where("_ok").select(columns), rejected.select(columns)


def import_versions(files: DataFrame, floor: str, order: str, content: str) -> DataFrame:
    """Files with the SHA-256 of their content and a version that counts up within each floor."""
    version = F.row_number().over(Window.partitionBy(floor).orderBy(order))
    return files.withColumn("checksum", F.sha2(content, 256)).withColumn("version", version)


def nest(children: DataFrame, parent: str, order: str, *columns: str) -> DataFrame:
    """(parent, items): each parent's children as an array in ascending order."""
    return children.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("items"))


def upload_reasons(files: DataFrame, kinds: tuple[str, ...], most_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """Uploads (mime, length) with the reason why each is refused, null if it is taken: no_file without a length, unsupported_type, too_large."""
    reason = F.when(F.col("length").isNull(), "no_file").when(~F.coalesce(F.col("mime").isin(*kinds), F.lit(False)), "unsupported_type").when(F.col("length") > most_bytes, "too_large")
    return files.withColumn("reason", reason)


def accepted_files(files: DataFrame, kinds: tuple[str, ...], most_bytes: int = 20 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) uploads (mime, length): only the given kinds, and no larger than the limit; rejected ones with their reason."""
    judged = upload_reasons(files, kinds, most_bytes)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")
