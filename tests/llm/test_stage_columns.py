"""Pipeline stages over tables with columns of other types and names, and without some of the usual ones."""

from pyspark.sql import functions as F

import corpus_pipeline

TEXT = "the first long line of this text stands here\nand another line of more than twenty characters"


def odd(spark):
    rows = [(1, TEXT), (1, TEXT), (2, TEXT), (3, "something else is told in this document, and it is long enough"), (None, "a short one"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", F.create_map(F.lit("k"), F.monotonically_increasing_id()).alias("m"), F.array(F.lit(1.5)).alias("key"), *(F.lit(c).alias(c) for c in ("rest", "component_id", "c0", "dk", "spans")))


def test_near_dedup_of_map_columns(spark):
    docs = odd(spark)
    found = corpus_pipeline.near_dedup(spark, docs, "")
    assert found.columns == docs.columns
    got = found.collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] in (1, 2, 3)) == [(1, TEXT), (3, odd(spark).where("doc_id = 3").first()["text"])]
    assert all(r[c] == c for r in got for c in ("rest", "component_id", "c0", "dk", "spans")) and all(r["key"] == [1.5] and "k" in r["m"] for r in got)
    few = corpus_pipeline.near_dedup(spark, docs.select("doc_id", "text"), "").collect()
    assert sorted(map(str, few)) == sorted(str(r) for r in found.select("doc_id", "text").collect())


def test_line_dedup_without_n_chars(spark):
    docs = odd(spark)
    found = corpus_pipeline.line_dedup(spark, docs, "")
    got = found.collect()
    assert found.columns == docs.columns and sorted(str(r["doc_id"]) for r in got) == ["1", "1", "3", "5", "6", "None"]
    counted = corpus_pipeline.line_dedup(spark, docs.withColumn("n_chars", F.lit(0)), "").collect()
    assert {r["n_chars"] for r in counted if r["doc_id"] == 1} == {len(TEXT)}


def test_decontamination_of_odd_columns(spark, tmp_path):
    spark.createDataFrame([(1, TEXT)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd(spark)
    found = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert found.columns == docs.columns and sorted(str(r["doc_id"]) for r in found.collect()) == ["3", "5", "6", "None"]
