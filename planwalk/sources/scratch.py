"""Shared scratch folders for tables that cut lineage and files that tasks write themselves.

Everything goes under spark.checkpoint.dir, the folder that a cluster shares between driver
and executors.  It is read from the session and set here only where it is unset.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; where a session on one machine names none, a new local folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = _own[0]
    return found if "://" in found or found.startswith("file:") else "file://" + found


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a folder of this call's own, not yet made."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, read back by whoever needs it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
